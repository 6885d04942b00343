"""quern: text retrieval, ranking, de-duplication and decision operators as PySpark DataFrame transforms.

Functions of this package are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
