"""A Spark-native engine for document collections: parse, chunk, embed, store and search.

Python functions of this package travel to the executors by value, so only the driver needs it installed.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
