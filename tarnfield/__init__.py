"""Gridded hazard and rainfall analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
