"""Spark-native analytics for subsurface surveys and voxel models."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that workers need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
