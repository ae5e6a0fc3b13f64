"""Named queries over the driver's test tables (one per operator)."""

from segstats.plans import (  # noqa: F401
    feature_queries,
    geometry_queries,
    label_queries,
    metric_queries,
    model_queries,
    report_queries,
    spatial_queries,
)
from segstats.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
