"""Training-data operators: deduplication, packing, fingerprints, scans, classifiers and chat formatting.

Functions of this subpackage travel to the executors by value, so only the driver needs it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
