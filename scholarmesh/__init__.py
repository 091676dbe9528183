"""scholarmesh: match funding calls to researchers, and keep calls, profiles and pages current, on Spark.

Operators take and return DataFrames; column functions take and return Columns.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with the task, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
