"""Daily aggregates. Every function computes all days of its input in one job.

Distinct users per group are counted in two steps: first one row per (group,
user) with flags, then a plain sum. The first step is combined on the map side
and keyed by user, so a group that holds a third of the events is spread over
all tasks; the second step sends one small row per task and group. The
alternative, several distinct counts at once, multiplies every input row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import cnt_if, flag, is_type, sum_if


def _bought():
    return F.col("is_purchase") == 1


def _ever(condition):
    """1 when any row of the group meets the condition."""
    return F.max(flag(condition))


def user_session_daily(fact: DataFrame) -> DataFrame:
    """Day x user x session: four counts and the length in whole seconds."""
    span = F.unix_timestamp(F.max("event_time")) - F.unix_timestamp(F.min("event_time"))
    return fact.groupBy("event_date", "user_id", "user_session").agg(
        cnt_if(is_type(K.VIEW)).alias("view_cnt"),
        cnt_if(is_type(K.CART)).alias("cart_cnt"),
        cnt_if(is_type(K.PURCHASE)).alias("purchase_cnt"),
        cnt_if(is_type(K.REMOVE)).alias("remove_cart_cnt"),
        F.greatest(span, F.lit(0).cast("bigint")).alias("session_duration_sec"),
    )


def product_daily(fact: DataFrame) -> DataFrame:
    """Day x product: attributes, three user counts, sales.

    The largest brand is taken from the distinct brands, apart from the users: a maximum
    of texts beside the counts would have to sort every event.
    """
    by_user = fact.groupBy("event_date", "product_id", "user_id").agg(
        F.max("category_id").alias("category_id"),
        _ever(is_type(K.VIEW)).alias("viewed"),
        _ever(is_type(K.CART)).alias("carted"),
        _ever(is_type(K.PURCHASE)).alias("bought"),
        cnt_if(is_type(K.PURCHASE)).alias("sales_cnt"),
        sum_if(is_type(K.PURCHASE), F.col("price")).alias("sales_amount"),
    )
    products = by_user.groupBy("event_date", "product_id").agg(
        F.max("category_id").alias("category_id"),
        F.sum("viewed").alias("exposure_uv"),
        F.sum("carted").alias("cart_uv"),
        F.sum("bought").alias("purchase_uv"),
        F.sum("sales_cnt").alias("sales_cnt"),
        F.sum("sales_amount").alias("sales_amount"),
    )
    brands = (
        fact.select(F.col("event_date").alias("_day"), F.col("product_id").alias("_product"), "brand").distinct()
        .groupBy("_day", "_product").agg(F.max("brand").alias("brand"))
    )
    same = F.col("event_date").eqNullSafe(F.col("_day")) & F.col("product_id").eqNullSafe(F.col("_product"))
    return products.join(brands, same).select(
        "event_date", "product_id", "category_id", "brand", "exposure_uv", "cart_uv", "purchase_uv", "sales_cnt", "sales_amount",
    )


def user_behavior_daily(fact: DataFrame) -> DataFrame:
    """Day x user: actions and purchases."""
    # all non-purchases share the NULL product, so the first step keeps few rows per user
    by_product = fact.withColumn("bought_product", F.when(_bought(), F.col("product_id"))).groupBy(
        "event_date", "user_id", "bought_product"
    ).agg(
        F.count("*").alias("actions"),
        sum_if(_bought(), F.col("price")).alias("amount"),
        F.sum("is_purchase").alias("purchases"),
    )
    return by_product.groupBy("event_date", "user_id").agg(
        F.sum("actions").alias("active_action_cnt"),
        F.sum("amount").alias("purchase_amount"),
        F.count("bought_product").alias("purchase_product_cnt"),
        F.sum("purchases").alias("purchase_cnt"),
    )


def traffic_hour_daily(fact: DataFrame) -> DataFrame:
    """Day x hour traffic. Users and sessions are distinct within the hour only.

    Two kinds of distinct values: users and sessions are reduced separately, each
    event taking part in two narrow shuffles, where one query with three distinct
    counts would send it through the shuffle four times.
    """
    hour = ["event_date", "event_hour"]
    by_user = fact.groupBy(*hour, "user_id").agg(
        F.count("*").alias("pv"),
        cnt_if(is_type(K.VIEW)).alias("view_pv"),
        cnt_if(is_type(K.CART)).alias("cart_cnt"),
        F.sum("is_purchase").alias("purchase_cnt"),
        sum_if(_bought(), F.col("price")).alias("gmv"),
    )
    traffic = by_user.groupBy(*hour).agg(
        F.sum("pv").alias("pv"),
        F.count("user_id").alias("uv"),
        F.sum("view_pv").alias("view_pv"),
        F.sum("cart_cnt").alias("cart_cnt"),
        F.sum("purchase_cnt").alias("purchase_cnt"),
        cnt_if(F.col("purchase_cnt") > 0).alias("purchase_uv"),
        F.sum("gmv").alias("gmv"),
    )
    sessions = (
        fact.filter(F.col("user_session").isNotNull())
        .select(*hour, "user_session")
        .distinct()
        .groupBy(*hour)
        .agg(F.count("*").alias("session_cnt"))
    )
    # 24 rows a day on either side
    return traffic.join(sessions, hour, "left").na.fill(0, ["session_cnt"])


def type_users_daily(fact: DataFrame) -> DataFrame:
    """Day: users who viewed, carted, bought, across all products."""
    by_user = fact.groupBy("event_date", "user_id").agg(
        _ever(is_type(K.VIEW)).alias("viewed"),
        _ever(is_type(K.CART)).alias("carted"),
        _ever(is_type(K.PURCHASE)).alias("bought"),
    )
    return by_user.groupBy("event_date").agg(
        F.sum("viewed").alias("view_uv"),
        F.sum("carted").alias("cart_uv"),
        F.sum("bought").alias("purchase_uv"),
    )
