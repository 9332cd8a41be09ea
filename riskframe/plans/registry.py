"""Registry of checked queries: ``name -> (spark_fn(spark, sf_dir), sql)``.

``sql`` is an independent DuckDB statement over the driver's parquet views,
or ``None`` for operators whose result is a fitted model (rows-only check,
backed by invariant tests).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalogue module so that its queries register."""
    import importlib
    for mod in ("catalog_stats", "catalog_metrics", "catalog_models", "catalog_cluster", "catalog_logs"):
        try:
            importlib.import_module(f"riskframe.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"riskframe.plans.{mod}":
                raise
