"""Incident analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task code travels with its definition, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
