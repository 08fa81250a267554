"""Course listings, accounts, uploads and retrieval as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that executors need
# not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
