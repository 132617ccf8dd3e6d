"""Tidewatch: threat-intelligence analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python functions in plans travel to the executors by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
