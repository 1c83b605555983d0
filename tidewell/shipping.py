"""Python functions that run in workers are sent by value, so executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send the functions of a module by value whenever one of them is used in a worker."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
