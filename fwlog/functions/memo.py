"""Building a large expression takes thousands of calls into the JVM, so the
expressions that never change are built once per JVM."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext

_BUILT: dict = {}


def once(build):
    """Memoise a function that returns expressions; arguments must be hashable."""

    @wraps(build)
    def built(*args):
        gateway = SparkContext._gateway
        key = (id(gateway), build.__module__, build.__qualname__, args)
        if key not in _BUILT:
            # the gateway is kept with the entry so that its id stays taken
            _BUILT[key] = (gateway, build(*args))
        return _BUILT[key][1]

    return built
