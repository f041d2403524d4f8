"""Connected components of a table of edges by alternating stars; no component ever sits in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _smallest(e: DataFrame) -> DataFrame:
    """Smallest neighbour per node; partial minima before the shuffle, so a hub does not gather."""
    return e.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge except those that are the smallest of their component.

    Nulls and loops are dropped. Every round links each node to the smallest of
    its neighbours; rounds grow with the logarithm of the diameter.
    """
    e = scratch.keep(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star0"
    )
    before, turn = None, 0
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, turn = state, turn + 1
        both = _both_ways(e)
        large = (
            both.join(_smallest(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        large = scratch.keep(large, f"large{turn}")
        small = (
            large.join(_smallest(large), "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                     F.struct(F.col("u").alias("u"), F.col("m").alias("v")))))
            .filter("u != v").distinct()
        )
        e = scratch.keep(small, f"star{turn}")
        scratch.drop(f"star{turn - 1}", f"large{turn}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
