"""Spark-native complex event processing: patterns over typed, timestamped events compiled to DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
