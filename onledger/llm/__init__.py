"""Operators for preparing training text at scale.

Nothing else in the library imports this package. Functions that run inside Spark's Python workers travel by value, so
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
