"""Inventory and supply-chain analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they call, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
