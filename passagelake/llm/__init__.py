"""Operators for training-data pipelines. Optional: nothing else in the library imports this subpackage."""

import importlib
import pkgutil

from .registry import QUERIES, SQL

for _m in pkgutil.iter_modules(__path__):
    if _m.name.startswith("queries_"):
        importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["QUERIES", "SQL"]
