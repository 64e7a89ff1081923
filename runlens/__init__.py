"""Execution analytics for workflow-automation logs, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run inside tasks travel with the query, so
# executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
