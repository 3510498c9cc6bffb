"""Documentation-corpus operators on Spark DataFrames.

Functions take and return DataFrames or Columns and hold no state. The few
Python functions that run inside tasks are pickled by value, so that workers
need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
