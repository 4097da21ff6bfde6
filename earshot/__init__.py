"""Earnings-call analytics on Spark: scans, text and risk features, panels, statistics, retrieval.

Every operator is a function of DataFrames (or Columns); nothing runs until a
caller asks for rows. Functions shipped to Python workers are pickled by value,
so executors need Spark's own Python environment but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
