"""Helpers on columns, names and patterns."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so that executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
