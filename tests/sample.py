"""A hand-made clickstream of eight days with known results."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidemark.schemas import EVENT_SCHEMA

FIRST, LAST = "2019-10-01", "2019-10-08"


def at(day: int, hour: int) -> datetime:
    return datetime(2019, 10, 1) + timedelta(days=day, hours=hour)


def event(day, hour, kind, product, brand, user, price=10.0, session=None, code="electronics", category=10):
    return (at(day, hour), kind, product, category, code, brand, price, user, session or f"s-{day}-{user}")


def sample_events() -> list[tuple]:
    """User 1 views and buys 1001 daily, user 3 views 1002 daily, user 2 views and buys 1001 on even day numbers.

    Two copies of one purchase and three dirty rows are added.
    """
    rows = []
    for day in range(8):
        brand = "alpha" if day < 4 else "beta"
        rows += [event(day, 10, "view", 1001, brand, 1), event(day, 11, "purchase", 1001, brand, 1)]
        rows += [event(day, 12, "view", 1002, "gamma", 3)]
        if day % 2 == 0:
            rows += [event(day, 13, "view", 1001, brand, 2), event(day, 14, "purchase", 1001, brand, 2)]
    rows += [event(0, 11, "purchase", 1001, "alpha", 1), event(0, 11, "purchase", 1001, "z-conflicting", 1)]
    rows += [
        event(1, 15, "invalid", 1001, "alpha", 1, session="dirty"),
        event(1, 15, "view", 1001, "alpha", 1, price=-1.0, session="dirty"),
        event(1, 15, "view", 1001, "alpha", None, session="dirty"),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)
