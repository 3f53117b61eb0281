"""Tagloom: co-occurrence and market-profile analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers are sent by value, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
