"""Date, user, session and category dimensions, rebuilt from all facts or merged with one day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, cnt_if, day_literal, flag, ratio_or_zero


# --- dates ------------------------------------------------------------------

def date_dim(spark: SparkSession, start, end) -> DataFrame:
    d = F.col("date_id")
    return calendar(spark, start, end, "date_id").select(
        d,
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.day(d).alias("day"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofweek(d).alias("day_of_week"),
        flag(~F.dayofweek(d).isin(1, 7)).alias("is_workday"),
    )


# --- users ------------------------------------------------------------------

def _user_days(fact: DataFrame) -> DataFrame:
    return (
        fact.filter(F.col("user_id").isNotNull())
        .groupBy("user_id", "event_date")
        .agg(F.max("is_purchase").alias("bought"))
    )


def user_dim(fact: DataFrame) -> DataFrame:
    """First and last day, active days, first purchase day, purchase days.

    One row per user and day first, so both day counts are plain counts.
    """
    bought_on = F.when(F.col("bought") == 1, F.col("event_date"))
    return _user_days(fact).groupBy("user_id").agg(
        F.min("event_date").alias("first_seen_date"),
        F.max("event_date").alias("last_seen_date"),
        F.count("event_date").alias("active_days"),
        F.min(bought_on).alias("first_purchase_date"),
        F.count(bought_on).alias("purchase_days"),
    )


def merge_user_dim(dim: DataFrame, fact: DataFrame, dt) -> DataFrame:
    """Add one day. Day counters grow only for users last seen before ``dt``, so a rerun changes nothing."""
    day = day_literal(dt)
    today = fact.filter((F.col("event_date") == day) & F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max("is_purchase").alias("bought")
    )
    bought_on = F.when(F.col("bought") == 1, day)
    absent = F.col("bought").isNull()
    unseen = F.col("last_seen_date").isNull() | (F.col("last_seen_date") < day)

    def grown(counter: str, step: Column) -> Column:
        old = F.col(counter)
        return F.when(absent | ~unseen, old).otherwise(F.coalesce(old, F.lit(0)) + step).alias(counter)

    return dim.join(today, "user_id", "full_outer").select(
        "user_id",
        F.least("first_seen_date", F.when(~absent, day)).alias("first_seen_date"),
        F.greatest("last_seen_date", F.when(~absent, day)).alias("last_seen_date"),
        grown("active_days", F.lit(1)),
        F.least("first_purchase_date", bought_on).alias("first_purchase_date"),
        grown("purchase_days", F.col("bought")),
    )


def left_censored(dim: DataFrame, start) -> DataFrame:
    """Buyers whose first purchase is on the first day of the data: their earlier history is unknown."""
    return dim.agg(
        F.count("*").alias("users"),
        F.count("first_purchase_date").alias("buyers"),
        F.coalesce(cnt_if(F.col("first_purchase_date") == day_literal(start)), F.lit(0)).alias("left_censored"),
    )


# --- sessions ---------------------------------------------------------------

def session_dim(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("user_session").isNotNull()).groupBy("user_session").agg(
        F.max("user_id").alias("user_id"),
        F.min("event_time").alias("session_start_time"),
        F.max("event_time").alias("session_end_time"),
    )


def multi_user_sessions(fact: DataFrame) -> DataFrame:
    """Session values used by several users. The missing session counts as one value here, not in ``sessions``."""
    users = fact.groupBy("user_session").agg(F.countDistinct("user_id").alias("users"))
    return users.agg(
        F.coalesce(cnt_if(F.col("users") > 1), F.lit(0)).alias("multi_user_sessions"),
        F.count("user_session").alias("sessions"),
    ).withColumn("share", F.round(ratio_or_zero(F.col("multi_user_sessions"), F.col("sessions")), 6))


def new_sessions(dim: DataFrame, fact: DataFrame, dt) -> DataFrame:
    """Sessions of the day that the dimension does not have. A known session is not extended."""
    today = session_dim(fact.filter(F.col("event_date") == day_literal(dt)))
    return today.join(dim.select("user_session"), "user_session", "left_anti")


# --- categories -------------------------------------------------------------

def _level(code: str, index: int) -> Column:
    """NULL beyond the last level."""
    return F.get(F.split(code, r"\."), F.lit(index))


def category_dim(fact: DataFrame) -> DataFrame:
    """Largest code over all days, and the largest value of each level.

    The distinct codes come first: that is a hash aggregation, while a maximum of
    texts has to sort its input.
    """
    codes = fact.filter(F.col("category_id").isNotNull()).select("category_id", "category_code").distinct()
    return codes.groupBy("category_id").agg(
        F.max("category_code").alias("category_code"),
        *(F.max(_level("category_code", i)).alias(f"category_l{i + 1}") for i in range(3)),
    )


def merge_category_dim(dim: DataFrame, fact: DataFrame, dt) -> DataFrame:
    """The code of the day wins; a category or level not seen that day keeps its old value."""
    names = ["category_code", "category_l1", "category_l2", "category_l3"]
    today = (
        fact.filter((F.col("event_date") == day_literal(dt)) & F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.max("category_code").alias("today_code"))
    )
    values = [F.col("today_code")] + [_level("today_code", i) for i in range(3)]
    return dim.join(today, "category_id", "full_outer").select(
        "category_id", *(F.coalesce(v, F.col(n)).alias(n) for n, v in zip(names, values))
    )
