"""Change-history analytics and corpus building on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
