"""Code-security analytics over source corpora, as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so the executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
