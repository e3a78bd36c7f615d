"""basalt: an analytics engine of DataFrame and Spark SQL operators.

Every operator declares a logical plan; Catalyst, AQE and whole-stage codegen
choose how it runs.  ``basalt.registry`` lists the queries that the repository
offers and, side by side with each of them, the SQL that an independent engine
runs on the same tables.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their tasks, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
