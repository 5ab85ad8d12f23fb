"""Operators for preparing training text at scale, and their queries.

Nothing else in the library imports this package. Its functions travel to tasks by value, so the
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
