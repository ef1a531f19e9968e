"""Operators for building training corpora; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
