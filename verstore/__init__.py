"""Ordered, versioned key-value analytics on PySpark.

Functions that run in Python workers are pickled by value, so executors need not have this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
