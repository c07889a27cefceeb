"""turnscope: session-log analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

from turnscope.session import get_session

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
