"""Table-in, table-out analytics operators for PySpark."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
