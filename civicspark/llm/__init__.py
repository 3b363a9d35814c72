"""Operators of a training-data pipeline, each a set of Spark table jobs.

Nothing else in the library imports this subpackage. ``queries.py`` binds
the operators to the driver tables. Functions that run in Python workers are
sent by value, so workers need no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
