"""Market-research analytics as DataFrame-to-DataFrame functions on Spark."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
