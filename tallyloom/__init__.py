"""Catalog, offer-matching, vector-search and log analytics on Spark DataFrames.

Functions that run in Python workers travel with the query, so executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
