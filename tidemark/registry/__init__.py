"""All registered queries."""

import importlib.util

from .base import ORACLE, QUERIES

for _name in ("trade", "requests", "analysis", "inputs", "taxonomy", "text", "search", "grounding", "logs"):
    if importlib.util.find_spec(f"{__name__}.{_name}"):
        importlib.import_module(f"{__name__}.{_name}")

__all__ = ["ORACLE", "QUERIES"]
