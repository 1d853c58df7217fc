"""Compressed-vector analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to executors by value, so that a worker needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
