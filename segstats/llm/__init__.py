"""Operators for preparing large text corpora (one module per operator)."""

import sys

from pyspark import cloudpickle

# task functions travel with the query, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
