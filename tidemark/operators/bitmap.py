"""Exact distinct users from mergeable containers of ids.

A day is stored as chunks of 32,768 ids. A chunk with few users holds their places as
a sorted list of two-byte numbers, one with many a bitmap, so no chunk takes more than a
bitmap and a user of a sparse chunk takes two bytes. Containers of several days are united
and then counted; adding daily counts would count a returning user twice.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import between_days, day_literal, flag, ratio_or_null
from ..session import stack

MOST_LISTED = 2048  # places of two bytes that take as much as a bitmap


def build_uv_bitmap(active: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """(event_date, bucket, users, positions, user_bitmap) from anything with a day and a user.

    Users are made distinct per day first, by hash aggregation: a chunk is then
    built from one row per user instead of from every event. A chunk has 32,768 places at most.
    """
    users = active.select("event_date", "user_id").filter(F.col("user_id").isNotNull()).distinct()
    lists = users.groupBy("event_date", F.bitmap_bucket_number("user_id").alias("bucket")).agg(
        F.sort_array(F.collect_list(F.bitmap_bit_position("user_id").cast("smallint"))).alias("positions"))
    few = F.size("positions") <= most_listed
    listed = lists.filter(few).select(
        "event_date", "bucket", F.size("positions").alias("users"), "positions", F.lit(None).cast("binary").alias("user_bitmap"))
    mapped = lists.filter(~few).select("event_date", "bucket", F.explode("positions").alias("at")).groupBy("event_date", "bucket").agg(
        F.count("*").cast("int").alias("users"), F.lit(None).cast("array<smallint>").alias("positions"),
        F.bitmap_construct_agg(F.col("at").cast("bigint")).alias("user_bitmap"))
    return stack([listed, mapped])


def _holds(bitmap: Column, at: Column) -> Column:
    """Whether a bitmap has the bit of a place."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def _merged(containers: DataFrame, *keys) -> DataFrame:
    """(keys, bucket, users): the union of the containers. Lists and bitmaps are united apart and meet once per bucket."""
    by = [*keys, "bucket"]
    listed = containers.filter("positions IS NOT NULL").groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("places"))
    mapped = containers.filter("user_bitmap IS NOT NULL").groupBy(*by).agg(F.bitmap_or_agg("user_bitmap").alias("bits"))
    more = F.size(F.filter("places", lambda at: ~_holds(F.col("bits"), at)))
    return listed.join(mapped, by, "full_outer").select(*by, F.when(F.col("bits").isNull(), F.size("places")).when(
        F.col("places").isNull(), F.bitmap_count("bits")).otherwise(F.bitmap_count("bits") + more).cast("long").alias("users"))


def _total(alias: str):
    return F.coalesce(F.sum("users"), F.lit(0)).alias(alias)


def uv_total(bitmaps: DataFrame) -> DataFrame:
    return _merged(bitmaps).agg(_total("uv"))


def uv_daily(bitmaps: DataFrame) -> DataFrame:
    """One container per day and bucket, so no merge is needed."""
    return bitmaps.groupBy("event_date").agg(F.sum("users").alias("uv"))


def uv_range(bitmaps: DataFrame, start, end) -> DataFrame:
    return uv_total(bitmaps.filter(between_days(start, end)))


def uv_monthly(bitmaps: DataFrame) -> DataFrame:
    month = F.date_format("event_date", "yyyy-MM").alias("ym")
    return _merged(bitmaps.withColumn("ym", month), "ym").groupBy("ym").agg(F.sum("users").alias("uv"))


def _sum0(column):
    return F.coalesce(F.sum(column), F.lit(0))


def _pair(bitmaps: DataFrame, a, b) -> DataFrame:
    """Per bucket: users of day a, of day b, of both days, of either day.

    What both days have follows from the counts of each and of the union, whichever
    containers a bucket has, and also where one day has none.
    """
    two = bitmaps.filter(F.col("event_date").isin(date.fromisoformat(str(a)), date.fromisoformat(str(b))))

    def on(day):
        return F.sum(F.when(F.col("event_date") == day_literal(day), F.col("users")).otherwise(F.lit(0)))

    counts = two.groupBy("bucket").agg(on(a).alias("on_a"), on(b).alias("on_b"))
    united = _merged(two).select("bucket", F.col("users").alias("either"))
    return counts.join(united, "bucket").withColumn("both", F.col("on_a") + F.col("on_b") - F.col("either"))


def bitmap_retained(bitmaps: DataFrame, a, b) -> DataFrame:
    """Users of day a who are there on day b."""
    return _pair(bitmaps, a, b).agg(_sum0("both").alias("retained"))


def bitmap_churned(bitmaps: DataFrame, a, b) -> DataFrame:
    """Users of day a who are not there on day b: either day without day b."""
    return _pair(bitmaps, a, b).agg((_sum0("either") - _sum0("on_b")).alias("churned"))


def bitmap_partition_check(bitmaps: DataFrame, a, b) -> DataFrame:
    """Kept and lost users must add up to the users of day a."""
    return (
        _pair(bitmaps, a, b)
        .agg(
            _sum0("on_a").alias("d0"),
            _sum0("both").alias("retained"),
            (_sum0("either") - _sum0("on_b")).alias("churned"),
        )
        .withColumn("ok", flag(F.col("retained") + F.col("churned") == F.col("d0")))
    )


def retained_users(active: DataFrame, a, b) -> DataFrame:
    """Row form of the intersection."""
    return _users_of(active, a).join(_users_of(active, b), "user_id", "left_semi")


def churned_users(active: DataFrame, a, b) -> DataFrame:
    """Row form of the difference."""
    return _users_of(active, a).join(_users_of(active, b), "user_id", "left_anti")


def _users_of(active: DataFrame, day) -> DataFrame:
    return active.filter(F.col("event_date") == day_literal(day)).select("user_id").distinct()


def uv_inflation(bitmaps: DataFrame) -> DataFrame:
    """Sum of daily counts beside the true count, and their ratio."""
    daily = bitmaps.groupBy("bucket").agg(F.sum("users").alias("daily"))
    return daily.join(_merged(bitmaps), "bucket").agg(_sum0("daily").alias("sum_daily_uv"), _sum0("users").alias("uv")).withColumn(
        "inflation", F.round(ratio_or_null(F.col("sum_daily_uv"), F.col("uv")), 4)
    )


def uv_consistency(fact: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Bitmap count against a distinct count, in total and per month."""
    month = F.date_format("event_date", "yyyy-MM").alias("period")
    seen = fact.select(month, "user_id").filter(F.col("user_id").isNotNull()).distinct()
    exact = stack([
        seen.groupBy("period").agg(F.count("*").alias("distinct_uv")),
        seen.select("user_id").distinct().agg(F.count("*").alias("distinct_uv")).withColumn("period", F.lit("total")),
    ])
    from_bitmap = stack([
        uv_monthly(bitmaps).select(F.col("ym").alias("period"), F.col("uv").alias("bitmap_uv")),
        uv_total(bitmaps).select(F.lit("total").alias("period"), F.col("uv").alias("bitmap_uv")),
    ])
    return exact.join(from_bitmap, "period", "full_outer").select(
        "period", "distinct_uv", "bitmap_uv",
        (F.coalesce("distinct_uv", F.lit(0)) - F.coalesce("bitmap_uv", F.lit(0))).alias("diff"),
    )
