"""The registry that cases add themselves to."""

from __future__ import annotations

from collections.abc import Callable

from .prelude import sql as with_prelude
from .tables import Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register a query ``(Tables) -> DataFrame`` and the SQL that gives the same rows."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate case {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_prelude(sql)
        return fn

    return register
