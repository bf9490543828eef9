"""Operators for training-data pipelines, and the queries over them."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions with the job, so executors need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
