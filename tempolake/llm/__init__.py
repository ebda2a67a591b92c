"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Its modules travel to the
executors by value, so a cluster needs no copy of the library on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
