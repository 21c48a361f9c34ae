"""Cohort analytics on Spark DataFrames.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame), ``plans`` (end-to-end
flows), ``streaming`` (the same operators on streams) and ``bindings`` (the
named queries over the test tables).
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that a cluster needs no installed copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
