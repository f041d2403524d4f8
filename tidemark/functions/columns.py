"""Column expressions shared by the operators. All are Catalyst built-ins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

__all__ = [
    "dirty_reason", "label_of", "is_type", "flag", "cnt_if", "sum_if", "ratio_or_zero", "ratio_or_null", "percent",
    "unusable_number", "between_days", "calendar", "day_literal", "on_calendar", "day_number", "time_bucket_of",
]


def dirty_reason() -> Column:
    """First matching reason, NULL for a clean row. A NULL or NaN price is clean."""
    missing_key = F.col("event_time").isNull() | F.col("user_id").isNull() | F.col("product_id").isNull()
    known = F.coalesce(F.col("event_type").isin(*K.EVENT_TYPES), F.lit(False))
    return (
        F.when(missing_key, K.NULL_KEY)
        .when(~known, K.INVALID_EVENT_TYPE)
        .when(F.col("price") < 0, K.NEGATIVE_PRICE)
    )


def label_of(column: str, labels: Mapping[str, str]) -> Column:
    chain = F
    for value, label in labels.items():
        chain = chain.when(F.col(column) == value, label)
    return chain


def is_type(event_type: str) -> Column:
    return F.col("event_type") == event_type


def flag(condition: Column) -> Column:
    """1 / 0; a NULL condition is 0."""
    return F.when(condition, 1).otherwise(0)


def cnt_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_if(condition: Column, value: Column) -> Column:
    """Sum of ``value`` where the condition holds, 0 elsewhere; NULL only if every value is NULL."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def ratio_or_null(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def percent(num: Column, den: Column) -> Column:
    """Percentage rounded to 4 places, NULL without a base."""
    return F.when(den > 0, F.round(num / den * 100, 4))


def unusable_number(column: str) -> Column:
    """NULL, NaN or infinite."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def day_literal(day) -> Column:
    return F.lit(str(day)).cast("date")


def between_days(start, end, column: str = K.PARTITION_COLUMN) -> Column:
    """A plain range on the partition column, so that whole partitions are pruned."""
    return F.col(column).between(day_literal(start), day_literal(end))


def day_number(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def calendar(spark, start, end, column: str = K.PARTITION_COLUMN) -> DataFrame:
    """One row per day of ``[start, end]``."""
    return spark.range(1).select(F.explode(F.sequence(day_literal(start), day_literal(end))).alias(column))


def on_calendar(daily: DataFrame, start, end, fill: dict | None = None) -> DataFrame:
    """Exactly one row per day of the range; days without data get NULLs or the given values."""
    days = calendar(daily.sparkSession, start, end)
    out = days.join(daily, K.PARTITION_COLUMN, "left")
    return out.na.fill(fill) if fill else out


def time_bucket_of(hour: Column, buckets) -> Column:
    chain = F
    for last_hour, label in buckets[:-1]:
        chain = chain.when(hour <= last_hour, label)
    return chain.otherwise(buckets[-1][1])
