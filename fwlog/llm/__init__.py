"""Operators for building training data: filters, near duplicates, search, mixing, tokens.

Each module holds one operator with a general interface and the query that applies it.
Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the workers by value: no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
