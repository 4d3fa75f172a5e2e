"""Operators for preparing training data, each by a stated method."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
