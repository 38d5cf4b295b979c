"""Callscope: call-transcript, document and image-metadata analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the task, so that the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
