"""Spark-native analytics for timed, scored and linked records."""

import sys

from pyspark import cloudpickle

# Worker-side helpers travel inside the task closures, so executors do not need
# this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
