"""Spark-native analysis of multi-channel time series."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Kernels travel with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
