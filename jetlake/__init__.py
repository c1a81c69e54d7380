"""Collision-event processing and benchmark-table analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
