"""Spark-native document analytics and hybrid retrieval.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing here collects row-level data to the driver.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions handed to Python workers travel with their code, so executors do not
# need this package on their own path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
