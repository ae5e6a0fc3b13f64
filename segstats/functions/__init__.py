"""Column-expression helpers (all JVM-side, codegen friendly)."""

from segstats.functions.expressions import (  # noqa: F401
    bounded_round,
    broadcast_if_small,
    half_even_round,
    normal_sf,
    portable_hash,
    relevel,
    round_doubles,
    row_sum,
    sig_level,
)
