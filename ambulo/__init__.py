"""Mobility analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package with the plan, so that a
# cluster needs no copy of it on the executors' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
