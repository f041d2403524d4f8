"""Window-level analytics: KPIs, rankings, price bands, strict funnel, decomposition.

Users and sessions are distinct within the window asked for; daily or monthly
numbers must not be added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import between_days, cnt_if, flag, is_type, ratio_or_null, sum_if, unusable_number


def _bought() -> Column:
    return F.col("is_purchase") == 1


_AMOUNTS = ("amount", "purchases")


def _user_totals(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*keys, "user_id").agg(
        sum_if(_bought(), F.col("price")).alias("amount"), F.sum("is_purchase").alias("purchases")
    )


def _buying_sessions(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.filter(_bought() & F.col("user_session").isNotNull()).select(*keys, "user_session").distinct()


def _kpis(users: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """From one row per (key, user) and one per (key, session): plain counts, and a join of one row per key."""
    totals = users.groupBy(key).agg(
        *(F.sum(c).alias(c) for c in _AMOUNTS),
        F.count("user_id").alias("active_users"),
        cnt_if(F.col("purchases") > 0).alias("buyers"),
    )
    counted = sessions.groupBy(key).agg(F.count("*").alias("buying_sessions"))
    return (
        totals.join(counted, key, "left")
        .na.fill(0, ["buying_sessions"])
        .withColumn("buyer_share", ratio_or_null(F.col("buyers"), F.col("active_users")))
    )


def window_kpis(fact: DataFrame, windows: list[tuple[str, str, str]]) -> DataFrame:
    """KPIs of each named window ``(name, first day, last day)``; windows may overlap.

    Days in the same windows are reduced together first, so a user is repeated per
    window only after that, and not for every event or day.
    """
    member = F.array_compact(F.array(*(F.when(between_days(a, b), F.lit(name)) for name, a, b in windows)))
    first = min(a for _, a, _ in windows)
    last = max(b for _, _, b in windows)
    days = fact.filter(between_days(first, last)).withColumn("windows", member)

    def per_window(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(F.explode("windows").alias("window_name"), *columns)

    users = per_window(_user_totals(days, "windows"), "user_id", *_AMOUNTS).groupBy("window_name", "user_id").agg(
        *(F.sum(c).alias(c) for c in _AMOUNTS)
    )
    sessions = per_window(_buying_sessions(days, "windows"), "user_session").distinct()
    return _kpis(users, sessions, "window_name")


def daily_trend(fact: DataFrame, start, end) -> DataFrame:
    days = fact.filter(between_days(start, end))
    return _kpis(_user_totals(days, "event_date"), _buying_sessions(days, "event_date"), "event_date")


def attr_ranking(fact: DataFrame, attr: str, n: int = 20) -> DataFrame:
    """The n values of an attribute with the largest purchase amount. The rank is taken over those n rows only."""
    top = (
        fact.filter(_bought() & F.col(attr).isNotNull())
        .groupBy(F.col(attr).cast("string").alias("attr_value"))
        .agg(F.round(F.sum("price"), 2).alias("amount"), F.count("*").alias("purchases"))
        .orderBy(F.desc_nulls_last("amount"), F.asc("attr_value"))
        .limit(n)
    )
    return top.withColumn(
        "rank", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("amount")))
    )


def repurchase(fact: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """Buyers of the first period, those who buy again in the second, and their share."""
    in_first, in_second = between_days(*first), between_days(*second)
    buyers = fact.filter(_bought() & (in_first | in_second)).groupBy("user_id").agg(
        F.max(flag(in_first)).alias("a"), F.max(flag(in_second)).alias("b")
    )
    return buyers.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("buyers"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("returning"),
    ).withColumn("repurchase_share", F.round(ratio_or_null(F.col("returning"), F.col("buyers")), 4))


def product_window(fact: DataFrame, start, end) -> DataFrame:
    """Per product over the whole window: users who viewed, carted, bought, and the amount."""
    by_user = fact.filter(between_days(start, end)).groupBy("product_id", "user_id").agg(
        F.max(flag(is_type(K.VIEW))).alias("viewed"),
        F.max(flag(is_type(K.CART))).alias("carted"),
        F.max(flag(is_type(K.PURCHASE))).alias("bought"),
        sum_if(_bought(), F.col("price")).alias("amount"),
    )
    return by_user.groupBy("product_id").agg(
        F.sum("viewed").alias("view_users"),
        F.sum("carted").alias("cart_users"),
        F.sum("bought").alias("buy_users"),
        F.sum("amount").alias("amount"),
    ).withColumn("viewed_not_bought", flag((F.col("view_users") > 0) & (F.col("buy_users") == 0)))


def price_bands(fact: DataFrame, edges=(50.0, 100.0, 200.0, 400.0)) -> DataFrame:
    """Purchases by price band ``[low, high)``, with shares over the bands.

    Zero prices and unusable ones (NULL, NaN, infinite) stand apart, without shares.
    """
    price = F.col("price")
    band = F.when(unusable_number("price"), -1).when(price == 0, 0)
    for i, edge in enumerate(edges, 1):
        band = band.when(price < edge, i)
    band = band.otherwise(len(edges) + 1)
    names = {-1: "excluded", 0: "zero", 1: f"<{edges[0]:g}", len(edges) + 1: f">={edges[-1]:g}"}
    names.update({i + 1: f"{edges[i - 1]:g}-{edges[i]:g}" for i in range(1, len(edges))})
    label = F
    for no, name in sorted(names.items()):
        label = label.when(F.col("band_no") == no, name)
    usable = F.when(~unusable_number("price"), price)
    grouped = fact.filter(_bought()).groupBy(band.alias("band_no")).agg(
        F.count("*").alias("records"), F.coalesce(F.sum(usable), F.lit(0.0)).alias("amount")
    )
    # at most one row per band reaches the window
    real = F.col("band_no") > 0
    whole = Window.partitionBy(F.lit(1))

    def share(c):
        total = F.sum(F.when(real, F.col(c))).over(whole)
        return F.when(real, F.round(F.col(c) / total, 4))

    return grouped.select(
        "band_no", label.alias("band"), "records", "amount",
        share("records").alias("record_share"), share("amount").alias("amount_share"),
    )


def rf_matrix(scored: DataFrame) -> DataFrame:
    """Buyers by recency and frequency mark, from ``rfm_scored``; four rows at most."""
    whole = Window.partitionBy(F.lit(1))
    return scored.groupBy("r_good", "f_good").agg(
        F.count("*").alias("users"), F.sum("m_amount").alias("amount")
    ).withColumn("user_share", F.round(F.col("users") / F.sum("users").over(whole), 4))


def funnel_steps(fact: DataFrame, hours: int = 24) -> DataFrame:
    """Per user and product with a view: first view, first cart after it, first purchase after that cart.

    Cart and purchase must lie within ``hours`` of the first view. Each step joins the
    events of its type with one row per pair and quarter of the time limit (five at
    most), so the events of a pair are spread over time, those outside the limit meet
    nothing, and no pair is treated differently for its size.
    """
    pair = ["user_id", "product_id"]
    quarter = max(1, int(hours) * 900)  # seconds
    first_view = fact.filter(is_type(K.VIEW)).groupBy(*pair).agg(F.min("event_time").alias("view_time"))
    limit = F.col("view_time") + F.expr(f"INTERVAL {int(hours)} HOURS")

    def part(t: Column) -> Column:
        return F.floor(F.unix_seconds(t) / quarter)

    def step(reached: DataFrame, event_type: str, after: str, name: str) -> DataFrame:
        events = fact.filter(is_type(event_type)).select(*pair, F.col("event_time").alias("t"), part(F.col("event_time")).alias("_part"))
        open_ = reached.withColumn("_part", F.explode(F.sequence(part(F.col(after)), part(limit))))
        hit = events.join(open_, [*pair, "_part"]).filter((F.col("t") >= F.col(after)) & (F.col("t") <= limit))
        firsts = [F.min("view_time").alias("view_time"), F.min("t").alias("t")]
        return hit.groupBy(*pair, "_part").agg(*firsts).groupBy(*pair).agg(*firsts).withColumnRenamed("t", name)

    carted = step(first_view, K.CART, "view_time", "cart_time")
    bought = step(carted, K.PURCHASE, "cart_time", "purchase_time").drop("view_time")
    return first_view.join(carted.drop("view_time"), pair, "left").join(bought, pair, "left")


def strict_funnel(fact: DataFrame, hours: int = 24) -> DataFrame:
    """Pairs of user and product that reach each step in order within the time limit, and the rates."""
    return funnel_steps(fact, hours).agg(
        F.count("view_time").alias("view_pairs"),
        F.count("cart_time").alias("cart_pairs"),
        F.count("purchase_time").alias("purchase_pairs"),
    ).withColumns({
        "view_to_cart": F.round(ratio_or_null(F.col("cart_pairs"), F.col("view_pairs")), 4),
        "cart_to_purchase": F.round(ratio_or_null(F.col("purchase_pairs"), F.col("cart_pairs")), 4),
    })


def gmv_decomposition(fact: DataFrame, before: tuple, after: tuple) -> DataFrame:
    """Change of gmv as buyers x purchases per buyer x price per purchase.

    The logarithmic form: each factor's part is L * ln(new / old), where L is the
    logarithmic mean of both gmv; the three parts add up to the change exactly.
    """
    in_0, in_1 = between_days(*before), between_days(*after)
    per_user = fact.filter(_bought() & (in_0 | in_1)).groupBy("user_id").agg(
        cnt_if(in_0).alias("n0"), cnt_if(in_1).alias("n1"),
        sum_if(in_0, F.col("price")).alias("g0"), sum_if(in_1, F.col("price")).alias("g1"),
    )
    t = per_user.agg(
        cnt_if(F.col("n0") > 0).alias("buyers_0"), cnt_if(F.col("n1") > 0).alias("buyers_1"),
        F.sum("n0").alias("purchases_0"), F.sum("n1").alias("purchases_1"),
        F.sum("g0").alias("gmv_0"), F.sum("g1").alias("gmv_1"),
    )
    c = F.col
    g0, g1 = c("gmv_0"), c("gmv_1")
    mean = F.when(g0 == g1, g0).otherwise((g1 - g0) / (F.ln(g1) - F.ln(g0)))
    usable = (g0 > 0) & (g1 > 0)

    def part(new: Column, old: Column) -> Column:
        return F.when(usable, mean * F.ln(new / old))

    return t.select(
        "buyers_0", "buyers_1", "purchases_0", "purchases_1", "gmv_0", "gmv_1",
        (g1 - g0).alias("gmv_change"),
        part(c("buyers_1"), c("buyers_0")).alias("by_buyers"),
        part(c("purchases_1") / c("buyers_1"), c("purchases_0") / c("buyers_0")).alias("by_frequency"),
        part(g1 / c("purchases_1"), g0 / c("purchases_0")).alias("by_price"),
    )
