"""Consecutive numbers over a large table without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within the partition in the low 33 bits


def number_rows(df: DataFrame, order: list[str], name: str, after=None) -> DataFrame:
    """``name`` = 1, 2, ... in the order of ``order``, plus ``after`` (a column, e.g. a scalar subquery).

    Rows are range-partitioned and sorted, then written once to the checkpoint
    folder, since range bounds are sampled and a second evaluation could place
    rows differently. Each partition then only needs the number of rows before
    it: one row per partition, a number set by configuration and not by the data,
    so that table is broadcast.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _ROW_BITS)
    row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    number = F.col("_before") + row + 1
    if after is not None:
        number = number + after
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, number)
        .drop("_at", "_part", "_before")
    )
