"""spindle: time-frequency analytics for long sampled recordings on Spark."""

import sys

from pyspark import cloudpickle

from spindle.config import DEFAULT, JobConfig

# Functions shipped to Python workers (grouped maps) are pickled by value, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULT", "JobConfig"]
