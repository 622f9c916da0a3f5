"""Spark-native hybrid analytics: vector, graph, text, relational and stream operators as DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: a cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
