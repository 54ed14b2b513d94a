"""Operators and queries of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
