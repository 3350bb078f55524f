"""Spark-first analytics over collections of documents and the triplets drawn from them."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
