"""Operators for preparing training text; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers whole, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
