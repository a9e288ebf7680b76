"""Tidemark: network time-series analytics on PySpark DataFrames.

Functions handed to Python workers are pickled by value, so executors need PySpark and NumPy
but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
