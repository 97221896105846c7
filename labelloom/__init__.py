"""Spark-first analytics over packaged-goods labels, listings and scan stores."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
