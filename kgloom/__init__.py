"""Spark jobs that build, merge and query a compliance graph, and clean text corpora.

Functions shipped to executors are pickled by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
