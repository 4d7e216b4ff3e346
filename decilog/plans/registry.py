"""All registered queries and their oracle SQL; plan modules add to them when imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ranked_clusters"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load() -> None:
    """Import every plan module."""
    from importlib import import_module

    for name in ("stats", "ranking", "lookups", "vectors", "decisions", "features", "state", "files", "streams", "grids"):
        import_module(f"decilog.plans.{name}")
