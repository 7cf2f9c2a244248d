"""rankloom: text-catalog search, recommendation and evaluation as Spark jobs."""

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside tasks travel by value, so executors need no
# installed copy of this package.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
