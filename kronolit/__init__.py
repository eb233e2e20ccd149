"""kronolit: point-in-time event analytics and data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so an executor needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
