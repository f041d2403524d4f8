"""Cross-layer conservation, report invariants and the reconciliation of the daily overview.

Both sides of every comparison are aggregated to one row, or one row per day,
before they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import between_days, calendar, cnt_if, day_literal, day_number, flag, sum_if, unusable_number
from ..session import stack
from .daily import type_users_daily


def _side_by_side(totals: dict[str, DataFrame], value: str) -> DataFrame:
    """One row with one column per named one-row total, NULL as 0."""
    tagged = [df.select(F.lit(name).alias("side"), F.col(value).alias("v")) for name, df in totals.items()]
    stacked = stack(tagged)
    return stacked.agg(*(
        F.coalesce(F.max(F.when(F.col("side") == name, F.col("v"))), F.lit(0)).alias(name) for name in totals
    ))


def _all_equal(names: list[str]) -> Column:
    first = F.col(names[0])
    return flag(reduce(lambda a, b: a & b, [F.col(n) == first for n in names[1:]]))


def purchase_conservation(fact, user_behavior, product, user_session, trade, start, end) -> DataFrame:
    """Purchases are the same in facts, users, products, sessions and the trade report."""
    days = between_days(start, end)

    def total(df, column):
        return df.filter(days).agg(F.sum(column).cast("bigint").alias("v"))

    sides = {
        "fact_cnt": total(fact, "is_purchase"),
        "user_cnt": total(user_behavior, "purchase_cnt"),
        "product_cnt": total(product, "sales_cnt"),
        "session_cnt": total(user_session, "purchase_cnt"),
        "trade_cnt": total(trade, "order_cnt"),
    }
    return _side_by_side(sides, "v").withColumn("ok", _all_equal(list(sides)))


def gmv_conservation(fact, user_behavior, product, trade, start, end) -> DataFrame:
    """gmv is the same within a cent in facts, users, products and the trade report."""
    days = between_days(start, end)

    def total(df, value):
        return df.filter(days).agg(value.alias("v"))

    sides = {
        "fact_gmv": total(fact, sum_if(F.col("is_purchase") == 1, F.col("price"))),
        "user_gmv": total(user_behavior, F.sum("purchase_amount")),
        "product_gmv": total(product, F.sum("sales_amount")),
        "trade_gmv": total(trade, F.sum("gmv")),
    }
    names = list(sides)
    # sums are compared, not their rounded forms: two equal sums near half a cent may round apart
    close = F.greatest(*names) - F.least(*names) <= K.MONEY_TOLERANCE
    return _side_by_side(sides, "v").withColumn("ok", flag(close)).withColumns({n: F.round(n, 2) for n in names})


def funnel_violations(funnel: DataFrame) -> DataFrame:
    """Days on which viewers are fewer than cart users or buyers. A gate: must be zero."""
    bad = ~((F.col("view_uv") >= F.col("cart_uv")) & (F.col("view_uv") >= F.col("purchase_uv")))
    return funnel.agg(F.count("*").alias("days"), F.coalesce(cnt_if(bad), F.lit(0)).alias("violations"))


def current_version_violations(dim: DataFrame) -> DataFrame:
    """Products without exactly one current version."""
    per_product = dim.groupBy("product_id").agg(F.sum("dw_is_current").alias("n"))
    return per_product.agg(
        F.count("*").alias("products"), F.coalesce(cnt_if(F.col("n") != 1), F.lit(0)).alias("violations")
    )


def hour_conservation(fact, traffic_hour, hour_report, start, end) -> DataFrame:
    """Events: hourly aggregate = hourly report = fact rows."""
    days = between_days(start, end)
    sides = {
        "fact_rows": fact.filter(days).agg(F.count("*").alias("v")),
        "hour_pv": traffic_hour.filter(days).agg(F.sum("pv").alias("v")),
        "report_pv": hour_report.filter(days).agg(F.sum("pv").alias("v")),
    }
    return _side_by_side(sides, "v").withColumn("ok", _all_equal(list(sides)))


def retention_check(retention: DataFrame, start, end, offsets=K.RETENTION_OFFSETS) -> DataFrame:
    """Every day present, nobody returns who was not there, number of censored days."""
    more = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(f"d{n}_uv") > F.col("d0_uv"), F.lit(False)) for n in offsets
    ])
    expected = F.datediff(day_literal(end), day_literal(start)) + 1
    return retention.filter(between_days(start, end)).agg(
        F.count("*").alias("days"),
        F.coalesce(cnt_if(more), F.lit(0)).alias("violations"),
        F.coalesce(cnt_if(F.col(f"d{max(offsets)}_rate").isNull()), F.lit(0)).alias("censored_days"),
    ).select(
        expected.cast("bigint").alias("expected_days"), "days", "violations", "censored_days",
        flag((F.col("violations") == 0) & (F.col("days") == expected)).alias("ok"),
    )


def row_expectations(hot_rank, product, daily_reports: dict[str, DataFrame], rfm, user_behavior, start, end,
                     n: int = K.HOT_RANK_SIZE) -> DataFrame:
    """Rows a report must have against the rows it has.

    Hot ranks: n a day, or all products of a smaller day. Daily reports: one row a
    day. RFM: one row per buyer of the range.
    """
    spark = product.sparkSession
    days = between_days(start, end)
    cal = calendar(spark, start, end)
    want_rank = product.filter(days).groupBy("event_date").agg(F.least(F.count("*"), F.lit(n)).alias("expected"))
    have_rank = hot_rank.filter(days).groupBy("event_date").agg(F.count("*").alias("actual"))

    def compared(name: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
        joined = expected.join(actual, "event_date", "full_outer").na.fill(0)
        return joined.agg(
            F.sum("expected").alias("expected_rows"),
            F.sum("actual").alias("actual_rows"),
            cnt_if(F.col("expected") != F.col("actual")).alias("bad_days"),
        ).select(F.lit(name).alias("table_name"), "*")

    parts = [compared("ads_product_hot_rank_daily", want_rank, have_rank)]
    one_a_day = cal.withColumn("expected", F.lit(1).cast("bigint"))
    for name, report in daily_reports.items():
        have = report.filter(days).groupBy("event_date").agg(F.count("*").alias("actual"))
        parts.append(compared(name, one_a_day, have))
    buyers = user_behavior.filter(days & (F.col("purchase_cnt") > 0)).select("user_id").distinct().agg(
        F.count("*").alias("v")
    )
    both = _side_by_side({"expected_rows": buyers, "actual_rows": rfm.agg(F.count("*").alias("v"))}, "v")
    parts.append(both.select(
        F.lit("ads_user_rfm_snapshot").alias("table_name"), "expected_rows", "actual_rows",
        flag(F.col("expected_rows") != F.col("actual_rows")).cast("bigint").alias("bad_days"),
    ))
    return stack(parts).withColumn("ok", flag(F.col("bad_days") == 0))


# --- daily overview -----------------------------------------------------------

def overview_coverage(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.count("*").alias("rows_total"),
        F.countDistinct("event_date").alias("distinct_days"),
        F.min("event_date").alias("first_day"),
        F.max("event_date").alias("last_day"),
    )


def _differs(a: str, b: str) -> Column:
    """Days on which the values differ; a value against none differs too."""
    return cnt_if(~F.col(a).eqNullSafe(F.col(b)))


def _money_differs(a: str, b: str) -> Column:
    return cnt_if((F.col(a).isNull() != F.col(b).isNull()) | (F.abs(F.col(a) - F.col(b)) > K.MONEY_TOLERANCE))


def _beside(overview: DataFrame, references: list[DataFrame]) -> DataFrame:
    """All sides by day, days of one side only included; ``_in_overview`` and ``_in_references`` (how many) tell which."""
    joined = overview.withColumn("_in_overview", F.lit(1))
    for i, reference in enumerate(references):
        joined = joined.join(reference.withColumn(f"_in_{i}", F.lit(1)), "event_date", "full")
    there = sum((F.coalesce(f"_in_{i}", F.lit(0)) for i in range(len(references))), F.lit(0))
    return joined.withColumn("_in_references", there)


def _one_sided(references: int) -> list[Column]:
    inside = F.col("_in_overview").isNotNull()
    return [
        cnt_if(inside & (F.col("_in_references") < references)).alias("days_missing_in_references"),
        cnt_if(~inside).alias("days_missing_in_overview"),
    ]


def overview_reconcile(overview, daily_uv, traffic_hour, user_session, user_behavior, fact) -> DataFrame:
    """Days that differ from a recomputation, for nine metrics, and days that one side lacks; money within a cent."""
    day = "event_date"
    references = [
        daily_uv.select(day, F.col("uv").alias("r_uv")),
        traffic_hour.groupBy(day).agg(F.sum("pv").alias("r_pv")),
        user_session.groupBy(day).agg(F.count("*").alias("r_session")),
        user_behavior.groupBy(day).agg(
            F.sum("purchase_amount").alias("r_gmv"),
            F.sum("purchase_cnt").alias("r_order"),
            cnt_if(F.col("purchase_cnt") > 0).alias("r_buyer"),
        ),
        type_users_daily(fact).select(
            day, F.col("view_uv").alias("r_view"), F.col("cart_uv").alias("r_cart"),
            F.col("purchase_uv").alias("r_purchase"),
        ),
    ]
    return _beside(overview, references).agg(
        _differs("uv", "r_uv").alias("uv_bad"),
        _differs("pv", "r_pv").alias("pv_bad"),
        _differs("session_cnt", "r_session").alias("session_bad"),
        _money_differs("gmv", "r_gmv").alias("gmv_bad"),
        _differs("order_cnt", "r_order").alias("order_bad"),
        _differs("buyer_cnt", "r_buyer").alias("buyer_bad"),
        _differs("view_uv", "r_view").alias("view_bad"),
        _differs("cart_uv", "r_cart").alias("cart_bad"),
        _differs("purchase_uv", "r_purchase").alias("purchase_bad"),
        *_one_sided(len(references)),
    )


def overview_invariants(overview: DataFrame) -> DataFrame:
    """Days that break each of seven invariants. Funnel order and rate range may fail on sound data:
    a purchase need not follow a cart of the same day."""
    c = F.col
    rates = ("view_to_cart_rate", "view_to_purchase_rate", "cart_to_purchase_rate", "cart_purchase_rate")
    out_of_range = reduce(lambda a, b: a | b, [(c(r) < 0) | (c(r) > 1) for r in rates])
    return overview.agg(
        cnt_if(~((c("view_uv") >= c("cart_uv")) & (c("cart_uv") >= c("purchase_uv")))).alias("funnel_order_bad"),
        cnt_if(c("uv") < c("view_uv")).alias("uv_lt_view_bad"),
        cnt_if(c("new_user_cnt") + c("old_user_cnt") != c("uv")).alias("newold_sum_bad"),
        cnt_if(c("new_user_cnt") > c("uv")).alias("new_gt_uv_bad"),
        cnt_if(c("old_user_cnt") < 0).alias("old_negative_bad"),
        cnt_if(out_of_range).alias("rate_range_bad"),
        cnt_if(c("arppu") < c("arpu") - 0.001).alias("arppu_lt_arpu_bad"),
    )


def overview_nulls(overview: DataFrame) -> DataFrame:
    core = ("uv", "pv", "session_cnt", "gmv", "order_cnt", "buyer_cnt", "new_user_cnt", "old_user_cnt")
    derived = (
        "avg_order_value", "arppu", "arpu", "view_to_cart_rate", "view_to_purchase_rate", "cart_to_purchase_rate",
        "avg_duration_sec", "avg_action_cnt", "cart_purchase_rate",
    )

    def any_null(names):
        return cnt_if(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names]))

    return overview.agg(any_null(core).alias("core_null_bad"), any_null(derived).alias("derived_null_bad"))


def overview_cross_check(overview, trade, funnel, session_report) -> DataFrame:
    """Against three report tables: days that differ, days that all have, and days that one side lacks."""
    day = "event_date"

    def renamed(df, prefix, names):
        return df.select(day, *(F.col(n).alias(prefix + n) for n in names))

    references = [
        renamed(trade, "t_", ("gmv", "order_cnt", "buyer_cnt")),
        renamed(funnel, "f_", ("view_uv", "cart_uv", "purchase_uv")),
        renamed(session_report, "s_", ("session_cnt",)),
    ]
    return _beside(overview, references).agg(
        cnt_if(F.col("_in_overview").isNotNull() & (F.col("_in_references") == len(references))).alias("compared_days"),
        _money_differs("gmv", "t_gmv").alias("gmv_bad"),
        _differs("order_cnt", "t_order_cnt").alias("order_bad"),
        _differs("buyer_cnt", "t_buyer_cnt").alias("buyer_bad"),
        _differs("view_uv", "f_view_uv").alias("view_bad"),
        _differs("cart_uv", "f_cart_uv").alias("cart_bad"),
        _differs("purchase_uv", "f_purchase_uv").alias("purchase_bad"),
        _differs("session_cnt", "s_session_cnt").alias("session_bad"),
        *_one_sided(len(references)),
    )


def overview_edges(overview: DataFrame, days: int = 3) -> DataFrame:
    """The first and the last days of the overview, in one pass; the window sees one row per day."""
    from_start = F.row_number().over(Window.orderBy("event_date"))
    from_end = F.row_number().over(Window.orderBy(F.desc("event_date")))
    return (
        overview.withColumns({"_first": from_start, "_last": from_end})
        .filter((F.col("_first") <= days) | (F.col("_last") <= days))
        .drop("_first", "_last")
    )


def overview_shape(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.min("gmv").alias("gmv_min"),
        F.max("gmv").alias("gmv_max"),
        F.round(F.avg("uv"), 0).alias("uv_avg"),
        F.min("uv").alias("uv_min"),
        F.max("uv").alias("uv_max"),
        F.sum("gmv").alias("gmv_total"),
        F.sum("order_cnt").alias("order_total"),
    )


# --- rerun proof ----------------------------------------------------------------

def fingerprint(df: DataFrame) -> DataFrame:
    """Digest of a table that ignores row order: count, sum of row hashes, xor of row hashes."""
    row_hash = F.xxhash64(*sorted(df.columns))
    return df.select(row_hash.alias("h")).agg(
        F.count("*").alias("row_cnt"),
        F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


def _exact(df: DataFrame) -> list[Column]:
    """Columns with doubles as whole numbers of ten-thousandths, so that a sum in another order has the same value."""
    def value(name: str, kind: str) -> Column:
        if kind != "double":
            return F.col(name)
        whole = F.floor(F.col(name) * 10_000 + 0.5001)  # noise around an exact half falls on one side
        return F.when(unusable_number(name), F.col(name).cast("string")).otherwise(whole.cast("string"))

    return [value(name, kind) for name, kind in sorted(df.dtypes)]


def partition_digests(df: DataFrame, partition: str | None) -> DataFrame:
    """(part, row_cnt, hash_sum, hash_xor) per partition, ``all`` for a table without. Digests of parts add up to that of the table."""
    part = F.coalesce(F.col(partition).cast("string"), F.lit("none")) if partition else F.lit("all")
    return df.select(part.alias("part"), F.xxhash64(*_exact(df)).alias("h")).groupBy("part").agg(
        F.count("*").alias("row_cnt"), F.sum(F.col("h").cast("decimal(20,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def digest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, part, row_cnt, status): ``same``, ``changed``, ``added`` or ``removed``, from digests (table_name, part, ...) alone."""
    sides = [df.select("table_name", "part", F.struct("row_cnt", "hash_sum", "hash_xor").alias(side)) for side, df in (("a", before), ("b", after))]
    both = sides[0].join(sides[1], ["table_name", "part"], "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select("table_name", "part", F.coalesce("b.row_cnt", "a.row_cnt").alias("row_cnt"), status.alias("status"))


# --- observations on the data ------------------------------------------------------

def hour_coverage(fact: DataFrame) -> DataFrame:
    """Hours with events for every day and event type; a missing type has 0 hours.

    Hours of a type are bits of one number, so one aggregation by day is enough.
    """
    def hours(event_type: str) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), F.col("event_hour"))
        return F.coalesce(F.bit_or(F.when(F.col("event_type") == event_type, bit)), F.lit(0)).alias(event_type)

    masks = fact.groupBy("event_date").agg(*(hours(t) for t in K.EVENT_TYPES))
    each = F.inline(F.array(*(F.struct(F.lit(t).alias("event_type"), F.col(t).alias("mask")) for t in K.EVENT_TYPES)))
    return masks.select("event_date", each).select(
        "event_date",
        "event_type",
        F.bit_count("mask").alias("hours_covered"),
        (F.lit(24) - F.bit_count("mask")).alias("hours_missing"),
    )


def funnel_inversion(funnel: DataFrame) -> DataFrame:
    """Days with more buyers than cart users, and the largest ratio."""
    inverted = F.col("purchase_uv") > F.col("cart_uv")
    return funnel.agg(
        F.count("*").alias("days"),
        F.coalesce(cnt_if(inverted), F.lit(0)).alias("inverted_days"),
        F.max("cart_to_purchase_rate").alias("max_ratio"),
    )


def events_per_user(user_behavior: DataFrame) -> DataFrame:
    """p50 / p90 / p99 of the events of a user, per day.

    The exact percentile keeps a map of distinct counts, not of users.
    """
    def p(share: float) -> Column:
        return F.percentile("active_action_cnt", F.lit(share))

    return user_behavior.groupBy("event_date").agg(
        F.count("*").alias("users"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99")
    )


def type_growth(fact: DataFrame, base: tuple, target: tuple) -> DataFrame:
    """Events a day per type in the target period over those in the base period."""
    in_base, in_target = between_days(*base), between_days(*target)

    def length(period):
        return F.datediff(day_literal(period[1]), day_literal(period[0])) + 1

    return (
        fact.filter(in_base | in_target)
        .groupBy("event_type")
        .agg(cnt_if(in_base).alias("base_events"), cnt_if(in_target).alias("target_events"))
        .withColumn("growth", F.when(
            F.col("base_events") > 0,
            F.round((F.col("target_events") / length(target)) / (F.col("base_events") / length(base)), 4),
        ))
    )


def user_overlap(user_behavior: DataFrame) -> DataFrame:
    """Users of a day who were also active the day before. One shuffle by user, no self-join."""
    days = Window.partitionBy("user_id").orderBy("day_no").rangeBetween(-1, -1)
    seen = user_behavior.select("user_id", "event_date", day_number("event_date").alias("day_no")).select(
        "event_date", F.count(F.lit(1)).over(days).alias("yesterday")
    )
    return seen.groupBy("event_date").agg(
        F.count("*").alias("users"), cnt_if(F.col("yesterday") > 0).alias("also_yesterday")
    ).withColumn("overlap", F.round(F.col("also_yesterday") / F.col("users"), 4))


def purchase_oddities(fact: DataFrame) -> DataFrame:
    """Per day: purchases at price 0, and buyers who viewed nothing that day."""
    bought = F.col("is_purchase") == 1
    per_user = fact.groupBy("event_date", "user_id").agg(
        F.sum("is_purchase").alias("purchases"),
        cnt_if(bought & (F.col("price") == 0)).alias("zero_price"),
        F.max(flag(F.col("event_type") == K.VIEW)).alias("viewed"),
    )
    return per_user.groupBy("event_date").agg(
        F.sum("purchases").alias("purchases"),
        F.sum("zero_price").alias("zero_price_purchases"),
        cnt_if(F.col("purchases") > 0).alias("buyers"),
        cnt_if((F.col("purchases") > 0) & (F.col("viewed") == 0)).alias("buyers_without_view"),
    )
