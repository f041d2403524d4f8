"""Sketches of a day that can be united over any range: distinct users, users kept and lost, events per user.

One row per day holds three of Spark's sketches. A range reads these rows only, never the
facts. Every estimate comes with bounds; each bound is three standard errors wide
(KLL: twice the published error at 99%), and exact where the sketch still holds everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import between_days, day_literal

LG_K = 12       # 4,096 entries of HLL and theta
KLL_K = 400
ERRORS = 3.0


def daily_sketches(user_daily: DataFrame, lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """(event_date, users_hll, users_theta, events_kll) from one row per day and user."""
    known = user_daily.filter(F.col("user_id").isNotNull())
    return known.groupBy("event_date").agg(
        F.hll_sketch_agg("user_id", lg_k).alias("users_hll"),
        F.theta_sketch_agg("user_id", lg_k).alias("users_theta"),
        F.kll_sketch_agg_bigint("active_action_cnt", kll_k).alias("events_kll"),
    )


def _bounded(estimate: Column, name: str, error: Column) -> list[Column]:
    return [estimate.alias(name), F.floor(estimate - error).alias("low"), F.ceil(estimate + error).alias("high")]


def uv_approx(sketches: DataFrame, start, end, lg_k: int = LG_K) -> DataFrame:
    """(uv, low, high): distinct users of the range from the union of its days. Relative error 1.04 / sqrt(2^lg_k)."""
    total = sketches.filter(between_days(start, end)).agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users_hll")), F.lit(0)).cast("double").alias("e"))
    return total.select(*_bounded(F.col("e"), "uv", F.col("e") * (ERRORS * 1.04 / (1 << lg_k) ** 0.5)))


def _pair(sketches: DataFrame, a, b) -> DataFrame:
    """The theta sketches of two days in one row; a day without users is NULL."""
    def on(day):
        return F.any_value(F.when(F.col("event_date") == day_literal(day), F.col("users_theta")), True)

    return sketches.filter(F.col("event_date").isin(day_literal(a), day_literal(b))).agg(on(a).alias("a"), on(b).alias("b"))


def _part(pair: DataFrame, part: Column, name: str, lg_k: int) -> DataFrame:
    """Estimate of a part of two sets. A sketch of n > k users keeps k / n of them by hash, so n / k users stand behind each one kept."""
    size = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0)).cast("double")
    scale = F.greatest(size(F.col("a")), size(F.col("b"))) / (1 << lg_k)
    behind = F.when(scale > 1, scale).otherwise(F.lit(0.0))
    counted = pair.select(part.cast("double").alias("e"), behind.alias("behind"))
    error = ERRORS * F.sqrt(F.col("e") * F.col("behind")) + ERRORS * ERRORS * F.col("behind")
    return counted.select(*_bounded(F.col("e"), name, error)).withColumn("low", F.greatest("low", F.lit(0)))


def retained_approx(sketches: DataFrame, a, b, lg_k: int = LG_K) -> DataFrame:
    """(retained, low, high): users of day a who are there on day b."""
    both = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("a", "b")), F.lit(0))
    return _part(_pair(sketches, a, b), both, "retained", lg_k)


def churned_approx(sketches: DataFrame, a, b, lg_k: int = LG_K) -> DataFrame:
    """(churned, low, high): users of day a who are not there on day b."""
    lost = F.coalesce(F.theta_sketch_estimate(F.theta_difference("a", "b")), F.theta_sketch_estimate("a"), F.lit(0))
    return _part(_pair(sketches, a, b), lost, "churned", lg_k)


def rank_error(kll_k: int = KLL_K) -> float:
    """Twice the published error of a rank at 99% confidence."""
    return 2 * 2.296 / kll_k ** 0.9021


def event_quantiles(sketches: DataFrame, start, end, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(share, events, days): events of a user on a day, over all days of the range."""
    merged = sketches.filter(between_days(start, end)).agg(
        F.kll_merge_agg_bigint("events_kll").alias("k"), F.count("*").alias("days")).filter("days > 0")
    return merged.select("days", F.inline(F.array(*(
        F.struct(F.lit(p).alias("share"), F.kll_sketch_get_quantile_bigint("k", F.lit(p)).alias("events")) for p in shares))))
