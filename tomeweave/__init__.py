"""Tomeweave: a Spark-first retrieval and corpus engine for Markdown collections."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
