"""The values of a table as one number, computed alike by Spark and by SQL.

A row becomes text: doubles as whole ten-thousandths (noise around an exact half falls on one
side), times as microseconds. The digest is the sum of the first eight hex digits of the rows' md5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import TABLES


def _columns(name: str, leave: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in TABLES[name].schema.fields if f.name not in leave]


def of_frame(name: str, df: DataFrame, leave: tuple[str, ...] = ()) -> DataFrame:
    def text(column: str, kind: str):
        c = F.col(column)
        if kind == "double":
            c = F.floor(c * 10_000 + 0.5001)
        elif kind == "timestamp":
            c = F.unix_micros(c)
        return F.coalesce(c.cast("string"), F.lit("~"))

    row = F.concat_ws("|", *(text(c, k) for c, k in _columns(name, leave)))
    return df.agg(F.count("*").alias("row_cnt"), F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias(
        "digest")).select(F.lit(name).alias("table_name"), "row_cnt", "digest")


def of_sql(name: str, relation: str, leave: tuple[str, ...] = ()) -> str:
    def text(column: str, kind: str) -> str:
        value = {"double": f"CAST(floor({column} * 10000 + 0.5001) AS BIGINT)", "timestamp": f"epoch_us({column})",
                 "date": f"strftime({column}, '%Y-%m-%d')"}.get(kind, column)
        return f"coalesce(CAST({value} AS VARCHAR), '~')"

    row = " || '|' || ".join(text(c, k) for c, k in _columns(name, leave))
    return (f"SELECT '{name}' AS table_name, COUNT(*) AS row_cnt, "
            f"CAST(coalesce(SUM(CAST(('0x' || substr(md5({row}), 1, 8)) AS BIGINT)), 0) AS BIGINT) AS digest FROM {relation}")
