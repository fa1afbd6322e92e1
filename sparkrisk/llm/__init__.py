"""Operators for large text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions of this package travel to Python workers by value, so that a cluster whose
# workers do not have the package installed can run them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
