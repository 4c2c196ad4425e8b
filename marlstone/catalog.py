"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .registry import ORACLE_SQL, QUERIES

for _m in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_m.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
