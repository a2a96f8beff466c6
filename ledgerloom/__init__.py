"""Spark-native record comparison engine: every operator maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in executors travel with the job: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
