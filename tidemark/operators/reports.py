"""Report tables over the daily aggregates.

``start`` / ``end`` are optional in the one-row-per-day reports: when given, the
report has a row for every day of the range, also for a day without data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import (
    between_days, cnt_if, day_literal, day_number, flag, is_type, on_calendar, percent, ratio_or_null, ratio_or_zero,
    time_bucket_of,
)
from .daily import type_users_daily


def trade_daily(user_behavior: DataFrame, start=None, end=None) -> DataFrame:
    """gmv, orders, buyers, average order value, revenue per buyer."""
    daily = user_behavior.groupBy("event_date").agg(
        F.sum("purchase_amount").alias("gmv"),
        F.sum("purchase_cnt").alias("order_cnt"),
        cnt_if(F.col("purchase_cnt") > 0).alias("buyer_cnt"),
    )
    if start is not None:
        daily = on_calendar(daily, start, end)
    return daily.withColumns({
        "avg_order_value": ratio_or_zero(F.col("gmv"), F.col("order_cnt")),
        "arppu": ratio_or_zero(F.col("gmv"), F.col("buyer_cnt")),
    })


def funnel_daily(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Users per step across products, and three rates that are not clamped."""
    daily = type_users_daily(fact)
    if start is not None:
        daily = on_calendar(daily, start, end, {"view_uv": 0, "cart_uv": 0, "purchase_uv": 0})
    return daily.withColumns({
        "view_to_cart_rate": ratio_or_zero(F.col("cart_uv"), F.col("view_uv")),
        "view_to_purchase_rate": ratio_or_zero(F.col("purchase_uv"), F.col("view_uv")),
        "cart_to_purchase_rate": ratio_or_zero(F.col("purchase_uv"), F.col("cart_uv")),
    })


def hot_rank_daily(product_daily: DataFrame, n: int = K.HOT_RANK_SIZE) -> DataFrame:
    """The n best products of every day: amount, then count, then id.

    Each task keeps n rows per day before the shuffle, so the window never sees a whole day.
    Amounts are ordered at four decimals: below that only the order of summation shows.
    """
    order = Window.partitionBy("event_date").orderBy(
        F.round("sales_amount", 4).desc_nulls_last(), F.desc_nulls_last("sales_cnt"), F.asc("product_id")
    )
    return (
        product_daily.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("event_date", "rank", "product_id", "category_id", "brand", "sales_cnt", "sales_amount", "exposure_uv")
    )


def session_behavior_daily(user_session: DataFrame, start=None, end=None) -> DataFrame:
    actions = F.col("view_cnt") + F.col("cart_cnt") + F.col("purchase_cnt") + F.col("remove_cart_cnt")
    daily = user_session.groupBy("event_date").agg(
        F.count("*").alias("session_cnt"),
        F.avg("session_duration_sec").alias("avg_duration_sec"),
        F.avg(actions).alias("avg_action_cnt"),
        F.sum("cart_cnt").alias("carts"),
        F.sum("purchase_cnt").alias("purchases"),
    )
    if start is not None:
        daily = on_calendar(daily, start, end, {"session_cnt": 0})
    return daily.withColumn("cart_purchase_rate", ratio_or_zero(F.col("purchases"), F.col("carts"))).drop(
        "carts", "purchases"
    )


def traffic_hour_report(traffic_hour: DataFrame, buckets=K.TIME_BUCKETS_EN) -> DataFrame:
    """Shares of the day, purchase rate and peak flag; at most 24 rows per window."""
    day = Window.partitionBy("event_date")
    return traffic_hour.select(
        "event_date",
        "event_hour",
        time_bucket_of(F.col("event_hour"), buckets).alias("time_bucket"),
        "pv",
        "uv",
        "purchase_cnt",
        "purchase_uv",
        "gmv",
        percent(F.col("pv"), F.sum("pv").over(day)).alias("pv_share"),
        percent(F.col("purchase_cnt"), F.sum("purchase_cnt").over(day)).alias("order_share"),
        percent(F.col("purchase_uv"), F.col("uv")).alias("purchase_rate"),
        flag(F.col("pv") == F.max("pv").over(day)).alias("is_peak_hour"),
    )


def retention_daily(user_behavior: DataFrame, start, end, offsets=K.RETENTION_OFFSETS) -> DataFrame:
    """Users of day D0 and how many are active again n days later; NULL when D0 + n is past ``end``.

    No self-join: within the days of one user (at most one row a day) a range
    frame of exactly n days ahead tells whether the user returned. All offsets
    share one shuffle by user.
    """
    days_of_user = Window.partitionBy("user_id").orderBy("day_no")
    active = (
        user_behavior.filter(between_days(start, end))
        .select("user_id", "event_date", day_number("event_date").alias("day_no"))
        .select("event_date", *(
            F.count(F.lit(1)).over(days_of_user.rangeBetween(n, n)).alias(f"back_{n}") for n in offsets
        ))
    )
    daily = active.groupBy("event_date").agg(
        F.count("*").alias("d0_uv"), *(cnt_if(F.col(f"back_{n}") > 0).alias(f"back_{n}") for n in offsets)
    )
    daily = on_calendar(daily, start, end, {"d0_uv": 0, **{f"back_{n}": 0 for n in offsets}})
    out = [F.col("event_date"), F.col("d0_uv")]
    for n in offsets:
        seen = F.when(F.date_add("event_date", n) <= day_literal(end), F.col(f"back_{n}"))
        out += [seen.alias(f"d{n}_uv"), percent(seen, F.col("d0_uv")).alias(f"d{n}_rate")]
    return daily.select(*out)


# --- RFM --------------------------------------------------------------------

def _score(buyers: DataFrame, end, recency_days: int) -> DataFrame:
    """Recency in days and three good/bad marks against the mean over all buyers.

    The means come from a scalar subquery, one row, evaluated once. It also takes
    the latest purchase day, which keeps its input identical to the main plan, so
    the shuffled buyers are reused instead of being computed twice.
    """
    mean = buyers.agg(
        F.struct(
            F.avg("f_cnt").alias("f"), F.avg("m_amount").alias("m"), F.max("last_buy_date").alias("latest")
        ).alias("mean")
    ).scalar()
    age = F.datediff(day_literal(end), F.col("last_buy_date"))
    return (
        buyers.withColumn("mean", mean)
        .select(
            "user_id",
            age.cast("bigint").alias("r_days"),
            "f_cnt",
            "m_amount",
            flag(age <= recency_days).alias("r_good"),
            flag(F.col("f_cnt") >= F.col("mean.f")).alias("f_good"),
            flag(F.col("m_amount") >= F.col("mean.m")).alias("m_good"),
        )
    )


def rfm_scored(fact: DataFrame, start, end, recency_days: int = K.RECENCY_DAYS) -> DataFrame:
    buyers = (
        fact.filter(between_days(start, end) & (F.col("is_purchase") == 1))
        .groupBy("user_id")
        .agg(
            F.count("*").alias("f_cnt"),
            F.sum("price").alias("m_amount"),
            F.max("event_date").alias("last_buy_date"),
        )
    )
    return _score(buyers, end, recency_days)


def _segment(scored: DataFrame, end, segments) -> DataFrame:
    chain = F
    for (m, f, r), label in segments.items():
        chain = chain.when((F.col("m_good") == m) & (F.col("f_good") == f) & (F.col("r_good") == r), label)
    return scored.select(
        "user_id", "r_days", "f_cnt", "m_amount", chain.alias("rfm_seg"), F.lit(str(end)).alias("as_of_dt")
    )


def rfm(fact: DataFrame, start, end, recency_days: int = K.RECENCY_DAYS, segments=K.RFM_SEGMENTS_EN) -> DataFrame:
    """Eight segments of all buyers of the range, as of ``end``."""
    return _segment(rfm_scored(fact, start, end, recency_days), end, segments)


def rfm_from_daily(
    user_behavior: DataFrame, start, end, recency_days: int = K.RECENCY_DAYS, segments=K.RFM_SEGMENTS_EN
) -> DataFrame:
    """The same from the day x user aggregate. Users without a purchase are left out after the sum."""
    buyers = (
        user_behavior.filter(between_days(start, end))
        .groupBy("user_id")
        .agg(
            F.sum("purchase_cnt").alias("f_cnt"),
            F.sum("purchase_amount").alias("m_amount"),
            F.max(F.when(F.col("purchase_cnt") > 0, F.col("event_date"))).alias("last_buy_date"),
        )
        .filter(F.col("f_cnt") > 0)
    )
    return _segment(_score(buyers, end, recency_days), end, segments)


def rfm_summary(snapshot: DataFrame, segments=K.RFM_SEGMENTS_EN) -> DataFrame:
    """Users and money per segment with their shares; eight rows at most enter the window."""
    total = Window.partitionBy("as_of_dt")
    vip = segments[(1, 1, 1)]
    return snapshot.groupBy("as_of_dt", "rfm_seg").agg(
        F.count("*").alias("users"), F.sum("m_amount").alias("amount")
    ).select(
        "as_of_dt",
        "rfm_seg",
        "users",
        "amount",
        ratio_or_null(F.col("users"), F.sum("users").over(total)).alias("user_share"),
        ratio_or_null(F.col("amount"), F.sum("amount").over(total)).alias("amount_share"),
        flag(F.col("rfm_seg") == vip).alias("is_vip"),
    )


# --- overview ---------------------------------------------------------------

def new_old_users(user_behavior: DataFrame, user_dim: DataFrame) -> DataFrame:
    """Per day: users first seen that day, and the others."""
    first = user_dim.select("user_id", F.col("first_seen_date").alias("event_date"), F.lit(1).alias("is_new"))
    marked = user_behavior.select("user_id", "event_date").join(first, ["user_id", "event_date"], "left")
    return marked.groupBy("event_date").agg(
        F.count("is_new").alias("new_user_cnt"),
        (F.count("*") - F.count("is_new")).alias("old_user_cnt"),
    )


def daily_overview(
    fact: DataFrame,
    user_behavior: DataFrame,
    user_session: DataFrame,
    traffic_hour: DataFrame,
    user_dim: DataFrame,
    daily_uv: DataFrame,
) -> DataFrame:
    """21 columns per day. ``daily_uv`` is (event_date, uv), from the bitmaps.

    Six aggregates of one row per day, joined on the day.
    """
    day = "event_date"
    traffic = traffic_hour.groupBy(day).agg(F.sum("pv").alias("pv"))
    sessions = session_behavior_daily(user_session)
    trade = trade_daily(user_behavior)
    funnel = funnel_daily(fact)
    new = new_old_users(user_behavior, user_dim).select(day, "new_user_cnt")
    joined = daily_uv
    for part in (traffic, sessions, trade, funnel, new):
        joined = joined.join(part, day)
    return joined.select(
        day, "uv", "pv", "session_cnt", "view_uv", "cart_uv", "purchase_uv", "gmv", "order_cnt", "buyer_cnt",
        "new_user_cnt",
        (F.col("uv") - F.col("new_user_cnt")).alias("old_user_cnt"),
        "avg_order_value", "arppu",
        ratio_or_zero(F.col("gmv"), F.col("uv")).alias("arpu"),
        "view_to_cart_rate", "view_to_purchase_rate", "cart_to_purchase_rate",
        "avg_duration_sec", "avg_action_cnt", "cart_purchase_rate",
    )


# --- hourly summaries over a range -------------------------------------------

def bucket_summary(hour_report: DataFrame) -> DataFrame:
    """Per time bucket of the range: shares, average order value, days on which the peak fell into it.

    At most 24 hours x days rows go in, four come out.
    """
    by_bucket = hour_report.groupBy("time_bucket").agg(
        F.sum("pv").alias("pv"),
        F.sum("purchase_cnt").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.countDistinct(F.when(F.col("is_peak_hour") == 1, F.col("event_date"))).alias("peak_days"),
    )
    whole = Window.partitionBy(F.lit(1))
    return by_bucket.select(
        "time_bucket", "pv", "orders",
        percent(F.col("pv"), F.sum("pv").over(whole)).alias("pv_share"),
        percent(F.col("orders"), F.sum("orders").over(whole)).alias("order_share"),
        ratio_or_null(F.col("gmv"), F.col("orders")).alias("avg_order_value"),
        "peak_days",
    )


def hour_profile(hour_report: DataFrame) -> DataFrame:
    """Per hour of the day over the range: traffic, orders, days as peak, and peak / trough of the whole profile."""
    by_hour = hour_report.groupBy("event_hour").agg(
        F.sum("pv").alias("pv"),
        F.sum("purchase_cnt").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.sum("is_peak_hour").alias("peak_days"),
    )
    whole = Window.partitionBy(F.lit(1))
    return by_hour.select(
        "event_hour", "pv", "orders", "peak_days",
        percent(F.col("pv"), F.sum("pv").over(whole)).alias("pv_share"),
        ratio_or_null(F.col("gmv"), F.col("orders")).alias("avg_order_value"),
        F.round(F.max("pv").over(whole) / F.min("pv").over(whole), 4).alias("peak_to_trough"),
    )
