"""A Spark-native engine for point clouds and the rasters derived from them."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code, so these needn't have the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
