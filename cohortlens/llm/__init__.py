"""Training-data operators. Nothing outside this folder imports it.

Functions that run in Python workers are pickled by value. Broadcast models are pickled by reference, so a cluster's
executors need this package too, as with any library (spark.submit.pyFiles).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
