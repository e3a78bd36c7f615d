"""Operators that prepare training data: one module per operator.

Functions that run in Python workers travel with the task (pickled by value),
so executors need the Python environment but not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
