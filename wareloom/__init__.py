"""Spark-first toolkit for product-data curation, retrieval measurement and text preparation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
