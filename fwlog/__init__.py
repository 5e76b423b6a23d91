"""Firewall-log translation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel to the workers by value: no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
