"""Code-migration review on Spark: load changes, match functions, compare, report."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks get this package's helpers with the job, so workers need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
