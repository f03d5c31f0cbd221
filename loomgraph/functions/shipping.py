"""Functions that run in Python workers travel with the query.

Executors then need no copy of this package; on a cluster that has one the
effect is the same.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
