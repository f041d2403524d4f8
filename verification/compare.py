"""Run a query and its SQL side by side and compare the rows, regardless of order."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from decimal import Decimal


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    data = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return names, [(n, t) for n, t in sorted(df.dtypes)], data


def rows_of_sql(con, text):
    cur = con.execute(text)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    data = [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]
    return [cols[i] for i in order], [(cols[i], types[cols[i]]) for i in order], data


_SAME = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "date": {"DATE"},
         "tinyint": {"TINYINT"}, "boolean": {"BOOLEAN"}}


def differences(left, right) -> list[str]:
    """Empty when names, types and rows agree."""
    out = []
    if left[0] != right[0]:
        return [f"columns {left[0]} != {right[0]}"]
    for (n, a), (_, b) in zip(left[1], right[1]):
        if b not in _SAME.get(a, {b}):
            out.append(f"type of {n}: {a} / {b}")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(left[2], key=key), sorted(right[2], key=key)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out
