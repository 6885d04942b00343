"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions of this subpackage are pickled by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
