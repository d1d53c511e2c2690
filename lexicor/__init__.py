"""lexicor: text analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are shipped by value, so workers need not
# find this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
