"""Aggregation over skewed keys: plain, salted, salted for heavy keys only, rebalanced.

Sums and counts are combined on the map side, so the plain form already sends
one row per key and task; it is the default. Salting pays when the partial
aggregates themselves are heavy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import stack

_MEASURES = ("gmv", "sales_cnt", "row_cnt")


def _measures() -> list[Column]:
    return [
        F.sum("sales_amount").alias("gmv"),
        F.sum("quantity").alias("sales_cnt"),
        F.count("*").alias("row_cnt"),
    ]


def _two_steps(salted: DataFrame, key: str) -> DataFrame:
    first = salted.groupBy(key, "_salt").agg(*_measures())
    return first.groupBy(key).agg(*(F.sum(m).alias(m) for m in _MEASURES))


def _salt(buckets: int) -> Column:
    """A salt from the task that reads the row: no column is read for it, and a key leaves a task as one row."""
    return F.pmod(F.spark_partition_id(), F.lit(buckets))


def agg_naive(df: DataFrame, key: str = "product_id") -> DataFrame:
    return df.groupBy(key).agg(*_measures())


def agg_salted(df: DataFrame, key: str = "product_id", buckets: int = K.SALT_BUCKETS) -> DataFrame:
    """Every key in ``buckets`` parts."""
    return _two_steps(df.withColumn("_salt", _salt(buckets)), key)


def _name(keys: list[str]) -> Column:
    """A key as the number under which the summary knows it."""
    return F.xxhash64(*keys)


def hot_candidates(df: DataFrame, key: str | list[str] = "product_id", min_share: float = 0.01) -> Column:
    """Names of the keys that may hold ``min_share`` of all rows, as a scalar array: one scan of the key columns.

    The tasks keep a frequent-items summary of fixed size each, and these are merged. With m
    tracked keys a count is off by at most 3.5 * 0.75 / m of all rows and a key above twice that is
    always returned, so with m = 16 / min_share none is missed; fewer than 2 / min_share can be
    returned at all.
    """
    keys = [key] if isinstance(key, str) else list(key)
    most, tracked = math.ceil(2 / min_share), math.ceil(16 / min_share)
    if tracked > 1_000_000:
        raise ValueError("min_share below what the summary can tell apart")
    found = df.select(_name(keys).alias("name")).agg(F.expr(f"transform(approx_top_k(name, {most}, {tracked}), x -> x.item)").alias("names"))
    return found.scalar()


def hot_keys(df: DataFrame, key: str | list[str] = "product_id", rows: int | None = None, min_share: float = 0.01) -> DataFrame:
    """(key, row_cnt): every key with at least ``min_share`` of all rows, and more than ``rows``, with its exact count.

    Only candidates of the summary are counted, so what is shuffled does not grow with the number of keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.select(*keys).filter(F.array_contains(hot_candidates(df, keys, min_share), _name(keys))).groupBy(*keys).agg(F.count("*").alias("row_cnt"))
    total = df.agg(F.count("*")).scalar()
    heavy = F.col("row_cnt") >= F.ceil(total * min_share)
    if rows is not None:
        heavy = heavy & (F.col("row_cnt") > rows)
    return counts.filter(heavy)


def agg_salted_hot(
    df: DataFrame, hot: Column | DataFrame | None = None, key: str = "product_id", buckets: int = K.SALT_BUCKETS, min_share: float = 0.01
) -> DataFrame:
    """Only hot keys are salted: those of ``hot``, or the candidates of the summary. The result does not depend on which keys those are.

    A few names reach the tasks as a literal, so no row is joined.
    """
    if isinstance(hot, DataFrame):
        hot = hot.agg(F.collect_set(_name([key]))).scalar()
    elif hot is None:
        hot = hot_candidates(df, key, min_share)
    salt = F.when(F.array_contains(hot, _name([key])), _salt(buckets)).otherwise(F.lit(0))
    return _two_steps(df.withColumn("_salt", salt), key)


def agg_rebalance(df: DataFrame, key: str = "product_id") -> DataFrame:
    """AQE evens out the result partitions and splits those that are too large."""
    return agg_naive(df, key).hint("rebalance", key)


def key_share(df: DataFrame, key: str = "product_id", k: int = 6) -> DataFrame:
    """The k most frequent keys with their share of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("row_cnt"))
    total = counts.agg(F.sum("row_cnt").alias("n")).scalar()
    return (
        counts.withColumn("share", F.round(F.col("row_cnt") / total, 6))
        .orderBy(F.desc("row_cnt"), F.asc(key))
        .limit(k)
    )


def skew_equivalence(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Each variant against the plain one, value by value: keys of either side, and keys that differ.

    All forms meet in one aggregation by key, so the plain one is computed once.
    """
    forms = {
        "naive": agg_naive(df, key),
        "salted_all": agg_salted(df, key),
        "salted_hot": agg_salted_hot(df, key=key),
        "rebalance": agg_rebalance(df, key),
    }
    stacked = stack([f.withColumn("form", F.lit(n)) for n, f in forms.items()])

    def value(form: str, measure: str) -> Column:
        return F.sum(F.when(F.col("form") == form, F.col(measure)))

    per_key = stacked.groupBy(key).agg(*(value(f, m).alias(f"{f}_{m}") for f in forms for m in _MEASURES))

    def differs(form: str) -> Column:
        rows = ~F.col(f"{form}_row_cnt").eqNullSafe(F.col("naive_row_cnt"))
        sums = [
            F.abs(F.col(f"{form}_{m}") - F.col(f"naive_{m}")) > K.MONEY_TOLERANCE for m in ("gmv", "sales_cnt")
        ]
        return rows | F.coalesce(sums[0] | sums[1], F.lit(False))

    variants = [f for f in forms if f != "naive"]
    counted = per_key.agg(*(
        F.struct(
            F.lit(f).alias("variant"),
            F.count(F.when(F.col(f"{f}_row_cnt").isNotNull() | F.col("naive_row_cnt").isNotNull(), 1)).alias("keys"),
            F.sum(F.when(differs(f), 1).otherwise(0)).alias("diff_keys"),
        ).alias(f)
        for f in variants
    ))
    return counted.select(F.inline(F.array(*variants)))


# --- task metrics ---------------------------------------------------------------

_EVENT_LOG = (
    "Event string, `Stage ID` int, "
    "`Task Info` struct<`Launch Time`: bigint, `Finish Time`: bigint>, "
    "`Task Metrics` struct<`Shuffle Read Metrics`: struct<`Local Bytes Read`: bigint, `Remote Bytes Read`: bigint>>"
)


def task_skew(spark, path: str) -> DataFrame:
    """Per stage, from a Spark event log: task times, and shuffle reads, slowest against median.

    ``side`` is ``all`` for all tasks and ``reduce`` for those that read a shuffle.
    """
    events = spark.read.schema(_EVENT_LOG).json(path).filter(F.col("Event") == "SparkListenerTaskEnd")
    read = F.col("Task Metrics.Shuffle Read Metrics")
    tasks = events.select(
        F.col("Stage ID").alias("stage_id"),
        (F.col("Task Info.Finish Time") - F.col("Task Info.Launch Time")).alias("ms"),
        (F.coalesce(read["Local Bytes Read"], F.lit(0)) + F.coalesce(read["Remote Bytes Read"], F.lit(0))).alias(
            "read_bytes"
        ),
    ).filter(F.col("ms") > 0)
    sides = F.explode(F.when(F.col("read_bytes") > 0, F.array(F.lit("all"), F.lit("reduce"))).otherwise(
        F.array(F.lit("all"))
    ))
    median_ms = F.percentile("ms", F.lit(0.5))
    median_read = F.percentile("read_bytes", F.lit(0.5))
    return tasks.withColumn("side", sides).groupBy("stage_id", "side").agg(
        F.count("*").alias("tasks"),
        F.max("ms").alias("max_ms"),
        median_ms.alias("median_ms"),
        F.min("ms").alias("min_ms"),
        F.sum("ms").alias("sum_ms"),
        F.round(F.max("ms") / F.nullif(median_ms, F.lit(0.0)), 2).alias("skew_ratio"),
        F.max("read_bytes").alias("max_read_bytes"),
        median_read.alias("median_read_bytes"),
        F.round(F.max("read_bytes") / F.nullif(median_read, F.lit(0.0)), 2).alias("read_skew"),
    )
