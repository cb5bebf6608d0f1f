"""Nearest-neighbour graph analytics on PySpark.

Functions of this package are shipped to Python workers by value, so
executors need neither the package on their path nor ``--py-files``.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
