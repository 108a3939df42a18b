"""Operators for building training data, apart from the mail engine."""

import sys

from pyspark import cloudpickle

# Tasks get the functions they run with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
