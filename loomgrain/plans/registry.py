"""Named queries, gathered from the modules of this folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name → callable) and ORACLES (name → SQL).
MODULES: tuple[str, ...] = ("problems", "history", "timings", "graph", "search", "ledger", "streams", "facts", "graph_load")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"loomgrain.plans.{name}"), attribute).items():
            if key in out:
                raise ValueError(f"two queries are named {key}")
            out[key] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracles() -> dict[str, str]:
    return _gather("ORACLES")
