"""Bitmaps, quality gates, reconciliation, observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import between_days
from tidemark.operators import bitmap, quality, reconcile, sketches
from tidemark.plans import jobs

from .prelude import END, START, big, cnt, rate, rnd
from .registry import case
from .tables import DAY, FIRST_HALF, NEXT_DAY, SECOND_HALF, money, rates

# --- bitmaps -----------------------------------------------------------------

_UV = "COUNT(DISTINCT user_id)"
_ON = "SELECT DISTINCT user_id FROM fact WHERE event_date = DATE '{}'"
_A, _B = _ON.format(DAY), _ON.format(NEXT_DAY)


@case("uv_bitmap_build", """
    SELECT event_date, CAST(FLOOR((user_id - 1) / 32768) AS BIGINT) + 1 AS bucket, COUNT(DISTINCT user_id) AS users
    FROM fact GROUP BY ALL""")
def _(t):
    held = F.coalesce(F.bitmap_count("user_bitmap"), F.size("positions").cast("bigint"))
    return t.bitmaps.select("event_date", "bucket", held.alias("users"))


_MIXED = f"""
    SELECT COUNT(DISTINCT user_id) AS uv, (SELECT COUNT(*) FROM ({_A} INTERSECT {_B})) AS retained,
           (SELECT COUNT(*) FROM ({_A} EXCEPT {_B})) AS churned, 1 AS kinds_mixed, 1 AS small_enough FROM fact"""


@case("uv_mixed_containers", _MIXED)
def _(t):
    # odd ids gather in few chunks, even ones lie far apart: lists and bitmaps side by side
    user = F.col("user_id")
    spread = t.fact.withColumn("user_id", F.when(user % 2 == 1, user).otherwise(user * 100_000))
    held = bitmap.build_uv_bitmap(spread, most_listed=4)
    size = F.coalesce(F.size("positions") * 2, F.lit(4096))
    shape = held.agg(F.when((F.count("positions") > 0) & (F.count("user_bitmap") > 0), 1).otherwise(0).alias("kinds_mixed"),
                     F.when(F.sum(F.when(F.col("positions").isNotNull(), size)) == 2 * F.sum(F.when(F.col("positions").isNotNull(), F.col("users"))), 1)
                     .otherwise(0).alias("small_enough"))
    return shape.withColumns({
        "uv": bitmap.uv_total(held).scalar(), "retained": bitmap.bitmap_retained(held, DAY, NEXT_DAY).scalar(),
        "churned": bitmap.bitmap_churned(held, DAY, NEXT_DAY).scalar()})


@case("uv_total", f"SELECT {_UV} AS uv FROM fact")
def _(t):
    return bitmap.uv_total(t.bitmaps)


@case("uv_daily", f"SELECT event_date, {_UV} AS uv FROM fact GROUP BY event_date")
def _(t):
    return t.uv_daily


@case("uv_range", f"SELECT {_UV} AS uv FROM fact WHERE event_date BETWEEN DATE '{START}' AND DATE '2024-01-07'")
def _(t):
    return bitmap.uv_range(t.bitmaps, START, "2024-01-07")


@case("uv_monthly", f"SELECT strftime(event_date, '%Y-%m') AS ym, {_UV} AS uv FROM fact GROUP BY ALL")
def _(t):
    return bitmap.uv_monthly(t.bitmaps)


@case("uv_retained", f"SELECT COUNT(*) AS retained FROM ({_A} INTERSECT {_B})")
def _(t):
    return bitmap.bitmap_retained(t.bitmaps, DAY, NEXT_DAY)


@case("uv_retained_wide_ids", f"SELECT COUNT(*) AS retained FROM ({_A} INTERSECT {_B})")
def _(t):
    # ids far apart: most chunks exist on one of the two days only
    wide = t.fact.withColumn("user_id", F.col("user_id") * 100_000)
    return bitmap.bitmap_retained(bitmap.build_uv_bitmap(wide), DAY, NEXT_DAY)


@case("uv_churned", f"SELECT COUNT(*) AS churned FROM ({_A} EXCEPT {_B})")
def _(t):
    return bitmap.bitmap_churned(t.bitmaps, DAY, NEXT_DAY)


@case("uv_set_check", f"""
    SELECT (SELECT COUNT(*) FROM ({_A})) AS d0, (SELECT COUNT(*) FROM ({_A} INTERSECT {_B})) AS retained,
           (SELECT COUNT(*) FROM ({_A} EXCEPT {_B})) AS churned, 1 AS ok""")
def _(t):
    return bitmap.bitmap_partition_check(t.bitmaps, DAY, NEXT_DAY)


@case("uv_sum_trap", f"""
    SELECT {big('SUM(d)')} AS sum_daily_uv, (SELECT {_UV} FROM fact) AS uv,
           {rnd(f'SUM(d) / (SELECT {_UV} FROM fact)', 4)} AS inflation
    FROM (SELECT {_UV} AS d FROM fact GROUP BY event_date)""")
def _(t):
    return bitmap.uv_inflation(t.bitmaps)


@case("uv_bitmap_vs_distinct", f"""
    SELECT strftime(event_date, '%Y-%m') AS period, {_UV} AS distinct_uv, {_UV} AS bitmap_uv, CAST(0 AS BIGINT) AS diff
    FROM fact GROUP BY ALL
    UNION ALL SELECT 'total', {_UV}, {_UV}, 0 FROM fact""")
def _(t):
    return bitmap.uv_consistency(t.fact, t.bitmaps)


@case("users_retained_rows", f"{_A} INTERSECT {_B}")
def _(t):
    return bitmap.retained_users(t.fact, DAY, NEXT_DAY)


@case("users_churned_rows", f"{_A} EXCEPT {_B}")
def _(t):
    return bitmap.churned_users(t.fact, DAY, NEXT_DAY)


# --- sketches ----------------------------------------------------------------

_RANGES = {"all": (START, END), "first": FIRST_HALF, "second": SECOND_HALF}


def _inside(df: DataFrame, exact: str) -> DataFrame:
    """The exact count, and whether it lies inside the bounds of the estimate."""
    return df.select(*(c for c in ("period", "lg_k") if c in df.columns), exact, F.when(F.col(exact).between(F.col("low"), F.col("high")), 1).otherwise(0).alias("inside"))


@case("q5_uv_approx", " UNION ALL ".join(
    f"SELECT '{n}' AS period, {_UV} AS exact, 1 AS inside, 1 AS same_as_one_sketch FROM fact WHERE event_date BETWEEN DATE '{a}' AND DATE '{b}'"
    for n, (a, b) in _RANGES.items()))
def _(t):
    wh = t.warehouse("sketches")
    wh.write_partitions(jobs.SKETCH, sketches.daily_sketches(t.ub))
    stored = wh.read(jobs.SKETCH)
    rows = []
    for name, (a, b) in _RANGES.items():
        users = t.fact.filter(between_days(a, b))
        one = users.agg(F.hll_sketch_agg("user_id", sketches.LG_K).alias("users_hll")).withColumn("event_date", F.lit(a).cast("date"))
        found = sketches.uv_approx(stored, a, b).withColumns({
            "uv_one": sketches.uv_approx(one, a, b).select("uv").scalar(), "exact": users.agg(F.count_distinct("user_id")).scalar()})
        rows.append(found.withColumns({"period": F.lit(name), "same_as_one_sketch": F.when(F.col("uv") == F.col("uv_one"), 1).otherwise(0)}).select(
            "period", "exact", F.when(F.col("exact").between(F.col("low"), F.col("high")), 1).otherwise(0).alias("inside"), "same_as_one_sketch"))
    return reduce(DataFrame.unionByName, rows)


def _parted(t, approx, exact: DataFrame, name: str) -> DataFrame:
    """Estimates from sketches that hold all users, and from some too small for them."""
    rows = []
    for lg_k in (sketches.LG_K, 5):
        stored = sketches.daily_sketches(t.ub, lg_k=lg_k)
        counted = exact.agg(F.count("*")).scalar()
        rows.append(_inside(approx(stored, DAY, NEXT_DAY, lg_k).withColumns({"exact": counted, "lg_k": F.lit(lg_k)}), "exact"))
    return reduce(DataFrame.unionByName, rows).withColumnRenamed("exact", name)


@case("uv_retained_approx", f"""
    SELECT lg_k, n AS retained, 1 AS inside FROM (SELECT COUNT(*) AS n FROM ({_A} INTERSECT {_B})), (VALUES (12), (5)) v(lg_k)""")
def _(t):
    return _parted(t, sketches.retained_approx, bitmap.retained_users(t.fact, DAY, NEXT_DAY), "retained")


@case("uv_churned_approx", f"""
    SELECT lg_k, n AS churned, 1 AS inside FROM (SELECT COUNT(*) AS n FROM ({_A} EXCEPT {_B})), (VALUES (12), (5)) v(lg_k)""")
def _(t):
    return _parted(t, sketches.churned_approx, bitmap.churned_users(t.fact, DAY, NEXT_DAY), "churned")


@case("event_distribution_range", " UNION ALL ".join(
    f"SELECT '{n}' AS period, CAST(p AS DOUBLE) AS share, (SELECT COUNT(DISTINCT event_date) FROM ub WHERE event_date BETWEEN DATE '{a}' AND DATE '{b}') AS days, "
    f"1 AS inside FROM (VALUES (0.5), (0.9), (0.99)) v(p)" for n, (a, b) in _RANGES.items()))
def _(t):
    # the rank that the estimate has among all rows must be the wanted one, up to the stated error
    stored = sketches.daily_sketches(t.ub)
    error, rows = sketches.rank_error(), []
    for name, (a, b) in _RANGES.items():
        found = sketches.event_quantiles(stored, a, b).agg(F.collect_list(F.struct("share", "events", "days"))).scalar()  # three quantiles
        each = t.ub.filter(between_days(a, b)).select("active_action_cnt", F.inline(found))
        ranked = each.groupBy("share", "days").agg(
            F.avg((F.col("active_action_cnt") < F.col("events")).cast("int")).alias("below"),
            F.avg((F.col("active_action_cnt") <= F.col("events")).cast("int")).alias("upto"))
        inside = (F.col("below") <= F.col("share") + error) & (F.col("upto") >= F.col("share") - error)
        rows.append(ranked.select(F.lit(name).alias("period"), "share", "days", F.when(inside, 1).otherwise(0).alias("inside")))
    return reduce(DataFrame.unionByName, rows)


# --- gates -------------------------------------------------------------------

# the gates also judge two days past the data, which have no rows
LAST = "2024-02-01"
_DAYS = f"SELECT CAST(UNNEST(generate_series(DATE '{START}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS event_date"


@case("dqc_ods_empty", f"""
    SELECT event_date, 1 AS seq, 'empty_partition' AS code, 'partition not empty' AS item,
           CASE WHEN n > 0 THEN 'PASS' ELSE 'BLOCK' END AS status, 'rows=' || n AS detail
    FROM (SELECT d.event_date, COUNT(g.event_date) AS n FROM ({_DAYS}) d LEFT JOIN tagged g USING (event_date)
          GROUP BY d.event_date)""")
def _(t):
    return quality.empty_gate(t.raw, START, LAST)


@case("dqc_ods_volume", """
    SELECT event_date, 2 AS seq, 'row_count_drop' AS code, 'row count against recent days' AS item,
           CASE WHEN base IS NULL OR (n - base) / base BETWEEN -0.5 AND 0.5 THEN 'PASS'
                WHEN n > base THEN 'WARN' ELSE 'BLOCK' END AS status,
           CASE WHEN base IS NULL THEN 'rows=' || n || ' no history'
                ELSE 'rows=' || n || ' median=' || printf('%.1f', base) END AS detail
    FROM (SELECT event_date, n, median(n) OVER (ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base
          FROM (SELECT event_date, COUNT(*) AS n FROM tagged GROUP BY event_date))""")
def _(t):
    return quality.volume_gate(t.raw, START, LAST)


def _null_sql(seq: int, column: str) -> str:
    return f"""
    SELECT event_date, {seq} AS seq, 'null_{column}' AS code, 'NULL rate of {column}' AS item,
           CASE WHEN b = 0 THEN 'PASS' WHEN b / n <= 0.001 THEN 'WARN' ELSE 'BLOCK' END AS status,
           'nulls=' || b || ' rows=' || n AS detail
    FROM (SELECT event_date, COUNT(*) AS n, COUNT(*) - COUNT({column}) AS b FROM tagged GROUP BY event_date)"""


_NULLS_SQL = " UNION ALL ".join(
    _null_sql(3 + i, c) for i, c in enumerate(("user_id", "product_id", "user_session", "event_time"))
)
_PRICE_SQL = """
    SELECT event_date, 7 AS seq, 'price_invalid' AS code, 'NULL, NaN or infinite prices' AS item,
           CASE WHEN b / n < 0.01 THEN 'PASS' ELSE 'BLOCK' END AS status, 'bad=' || b || ' rows=' || n AS detail
    FROM (SELECT event_date, COUNT(*) AS n,
                 COUNT(*) FILTER (WHERE price IS NULL OR isnan(price) OR isinf(price)) AS b
          FROM tagged GROUP BY event_date)"""


@case("dqc_ods_nulls", _NULLS_SQL)
def _(t):
    return quality.null_gate(t.raw, START, LAST)


@case("dqc_ods_price", _PRICE_SQL)
def _(t):
    return quality.price_gate(t.raw, START, LAST)


@case("dqc_dwd", f"""
    WITH f AS (SELECT event_date, COUNT(*) AS n, MIN(event_time) AS a, MAX(event_time) AS b,
                      COUNT(*) FILTER (WHERE CAST(event_time AS DATE) <> event_date) AS tz,
                      COUNT(*) FILTER (WHERE price < 0) AS neg,
                      COUNT(*) FILTER (WHERE event_type NOT IN ('view','cart','remove_from_cart','purchase')) AS bad,
                      COUNT(*) FILTER (WHERE event_time IS NULL OR user_id IS NULL OR product_id IS NULL
                                          OR event_type IS NULL) AS nk
               FROM fact GROUP BY event_date),
    u AS (SELECT event_date, COUNT(*) AS dup FROM (
              SELECT event_date FROM fact GROUP BY event_date, user_id, event_time, product_id, event_type
              HAVING COUNT(*) > 1) GROUP BY event_date),
    j AS (SELECT y.event_date, COALESCE(o.n, 0) AS ods, COALESCE(d.n, 0) AS dirty, COALESCE(f.n, 0) AS n,
                 COALESCE(dup, 0) AS dup, COALESCE(nk, 0) AS nk, COALESCE(bad, 0) AS bad, COALESCE(neg, 0) AS neg,
                 COALESCE(tz, 0) AS tz, a, b
          FROM ({_DAYS}) y LEFT JOIN f USING (event_date) LEFT JOIN u USING (event_date)
          LEFT JOIN (SELECT event_date, COUNT(*) AS n FROM tagged GROUP BY event_date) o USING (event_date)
          LEFT JOIN (SELECT event_date, COUNT(*) AS n FROM dirty GROUP BY event_date) d USING (event_date))
    SELECT event_date, 1 AS seq, 'count_overflow' AS code, 'account balance' AS item,
           CASE WHEN ods >= n + dirty THEN 'PASS' ELSE 'BLOCK' END AS status,
           'source=' || ods || ' = clean=' || n || ' + dirty=' || dirty || ' + duplicates=' || (ods - n - dirty) AS detail
    FROM j
    UNION ALL SELECT event_date, 2, 'empty_partition', 'partition not empty',
           CASE WHEN n > 0 THEN 'PASS' ELSE 'BLOCK' END, 'rows=' || n FROM j
    UNION ALL SELECT event_date, 3, 'dup_key', 'event key unique',
           CASE WHEN dup = 0 THEN 'PASS' ELSE 'BLOCK' END, 'groups=' || dup FROM j
    UNION ALL SELECT event_date, 4, 'null_core_field', 'core fields present',
           CASE WHEN nk = 0 THEN 'PASS' ELSE 'BLOCK' END, 'rows=' || nk FROM j
    UNION ALL SELECT event_date, 5, 'bad_event_type', 'event type known',
           CASE WHEN bad = 0 THEN 'PASS' ELSE 'BLOCK' END, 'rows=' || bad FROM j
    UNION ALL SELECT event_date, 6, 'negative_price', 'price not negative',
           CASE WHEN neg = 0 THEN 'PASS' ELSE 'BLOCK' END, 'rows=' || neg FROM j
    UNION ALL SELECT event_date, 7, 'timezone_offset', 'partition is the UTC day',
           CASE WHEN tz = 0 THEN 'PASS' ELSE 'BLOCK' END,
           CASE WHEN a IS NULL THEN 'no data' ELSE 'rows=' || tz || ' | ' || strftime(a, '%Y-%m-%d %H:%M:%S') || ' ~ '
                || strftime(b, '%Y-%m-%d %H:%M:%S') END FROM j""")
def _(t):
    return quality.dwd_gate(t.raw, t.fact, t.dirty, START, LAST)


@case("dqc_gmv_volatility", """
    SELECT event_date, 1 AS seq, 'gmv_drop' AS code, 'gmv against recent days' AS item,
           CASE WHEN h < 7 THEN 'PASS' WHEN gmv IS NULL THEN 'BLOCK' WHEN base <= 0 THEN 'PASS'
                WHEN (gmv - base) / base < -0.5 THEN 'BLOCK' WHEN ABS((gmv - base) / base) > 0.3 THEN 'WARN'
                ELSE 'PASS' END AS status,
           CASE WHEN h < 7 THEN 'history=' || h || ' days, skipped' WHEN gmv IS NULL THEN 'no gmv'
                WHEN base <= 0 THEN 'median is zero, skipped'
                ELSE printf('gmv=%.2f median=%.2f', gmv, base) END AS detail
    FROM (SELECT event_date, gmv, COUNT(*) OVER w AS h, median(gmv) OVER w AS base FROM trade
          WINDOW w AS (ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""")
def _(t):
    return quality.gmv_gate(t.trade, START, END)


# --- conservation --------------------------------------------------------------


@case("check_purchase_conservation", f"""
    SELECT {big('(SELECT SUM(is_purchase) FROM fact)')} AS fact_cnt, {big('(SELECT SUM(purchase_cnt) FROM ub)')} AS user_cnt,
           {big('(SELECT SUM(sales_cnt) FROM pd)')} AS product_cnt,
           {big('(SELECT SUM(purchase_cnt) FROM us)')} AS session_cnt,
           {big('(SELECT SUM(order_cnt) FROM trade)')} AS trade_cnt, 1 AS ok""")
def _(t):
    return reconcile.purchase_conservation(t.fact, t.ub, t.pd, t.us, t.trade, START, END)


@case("check_gmv_conservation", """
    SELECT ROUND((SELECT SUM(CASE WHEN is_purchase = 1 THEN price ELSE 0 END) FROM fact), 2) AS fact_gmv,
           ROUND((SELECT SUM(purchase_amount) FROM ub), 2) AS user_gmv,
           ROUND((SELECT SUM(sales_amount) FROM pd), 2) AS product_gmv,
           ROUND((SELECT SUM(gmv) FROM trade), 2) AS trade_gmv, 1 AS ok""")
def _(t):
    return reconcile.gmv_conservation(t.fact, t.ub, t.pd, t.trade, START, END)


@case("check_funnel", """
    SELECT COUNT(*) AS days, COUNT(*) FILTER (WHERE view_uv < cart_uv OR view_uv < purchase_uv) AS violations
    FROM funnel""")
def _(t):
    return reconcile.funnel_violations(t.funnel)


@case("check_scd2_current", """
    SELECT COUNT(*) AS products, COUNT(*) FILTER (WHERE n <> 1) AS violations
    FROM (SELECT product_id, SUM(dw_is_current) AS n FROM scd GROUP BY product_id)""")
def _(t):
    return reconcile.current_version_violations(t.scd2)


@case("check_hour_conservation", f"""
    SELECT (SELECT COUNT(*) FROM fact) AS fact_rows, {big('(SELECT SUM(pv) FROM th)')} AS hour_pv,
           {big('(SELECT SUM(pv) FROM hour)')} AS report_pv, 1 AS ok""")
def _(t):
    return reconcile.hour_conservation(t.fact, t.th, t.hour_report, START, END)


@case("check_retention", f"""
    SELECT CAST(DATE '{END}' - DATE '{START}' + 1 AS BIGINT) AS expected_days, COUNT(*) AS days,
           {cnt('d1_uv > d0_uv OR d3_uv > d0_uv OR d7_uv > d0_uv')} AS violations,
           {cnt('d7_rate IS NULL')} AS censored_days, 1 AS ok FROM ret""")
def _(t):
    return reconcile.retention_check(t.retention, START, END)


@case("row_count_expectations", f"""
    WITH want AS (SELECT {big('SUM(LEAST(n, 100))')} AS n FROM (SELECT COUNT(*) AS n FROM pd GROUP BY event_date)),
    b AS (SELECT COUNT(DISTINCT user_id) AS n FROM fact WHERE is_purchase = 1)
    SELECT 'ads_product_hot_rank_daily' AS table_name, n AS expected_rows, (SELECT COUNT(*) FROM hot) AS actual_rows,
           CAST(0 AS BIGINT) AS bad_days, 1 AS ok FROM want
    UNION ALL SELECT 'ads_trade_daily', 30, (SELECT COUNT(*) FROM trade), 0, 1
    UNION ALL SELECT 'ads_conversion_funnel_daily', 30, (SELECT COUNT(*) FROM funnel), 0, 1
    UNION ALL SELECT 'ads_session_behavior_daily', 30, (SELECT COUNT(*) FROM sess), 0, 1
    UNION ALL SELECT 'ads_user_rfm_snapshot', n, (SELECT COUNT(*) FROM rfm), 0, 1 FROM b""")
def _(t):
    daily = {
        "ads_trade_daily": t.trade, "ads_conversion_funnel_daily": t.funnel,
        "ads_session_behavior_daily": t.session_report,
    }
    return reconcile.row_expectations(t.hot, t.pd, daily, t.rfm, t.ub, START, END)


# --- overview --------------------------------------------------------------------


@case("overview_coverage", """
    SELECT COUNT(*) AS rows_total, COUNT(DISTINCT event_date) AS distinct_days, MIN(event_date) AS first_day,
           MAX(event_date) AS last_day FROM ov""")
def _(t):
    return reconcile.overview_coverage(t.overview)


@case("overview_reconcile", "SELECT " + ", ".join(
    f"{big(f'SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)')} AS {n}_bad" for n, c in (
        ("uv", "uv"), ("pv", "pv"), ("session", "session_cnt"), ("gmv", "gmv"), ("order", "order_cnt"),
        ("buyer", "buyer_cnt"), ("view", "view_uv"), ("cart", "cart_uv"), ("purchase", "purchase_uv"))) + f", {cnt('uv IS NULL')} AS days_missing_in_references, {cnt('event_date IS NULL')} AS days_missing_in_overview FROM ov")
def _(t):
    return reconcile.overview_reconcile(t.overview, t.uv_daily, t.th, t.us, t.ub, t.fact)


@case("overview_reconcile_damaged", f"""
    WITH d AS (SELECT *, event_date = DATE '{DAY}' AS lost, event_date = DATE '{NEXT_DAY}' AS changed FROM ov)
    SELECT {cnt('FALSE')} AS uv_bad, {cnt('lost')} AS pv_bad, {cnt('FALSE')} AS session_bad, {cnt('changed')} AS gmv_bad,
           {cnt('FALSE')} AS order_bad, {cnt('FALSE')} AS buyer_bad, {cnt('FALSE')} AS view_bad, {cnt('FALSE')} AS cart_bad,
           {cnt('FALSE')} AS purchase_bad, {cnt('lost')} AS days_missing_in_references, {cnt('FALSE')} AS days_missing_in_overview FROM d""")
def _(t):
    hours = t.th.filter(F.col("event_date") != F.lit(DAY).cast("date"))
    users = t.ub.withColumn("purchase_amount", F.col("purchase_amount") + F.when(F.col("event_date") == F.lit(NEXT_DAY).cast("date"), 1.0).otherwise(0.0))
    return reconcile.overview_reconcile(t.overview, t.uv_daily, hours, t.us, users, t.fact)


@case("overview_invariants", f"""
    SELECT {cnt('NOT (view_uv >= cart_uv AND cart_uv >= purchase_uv)')} AS funnel_order_bad,
           {cnt('uv < view_uv')} AS uv_lt_view_bad, {cnt('new_user_cnt + old_user_cnt <> uv')} AS newold_sum_bad,
           {cnt('new_user_cnt > uv')} AS new_gt_uv_bad, {cnt('old_user_cnt < 0')} AS old_negative_bad,
           {cnt('GREATEST(view_to_cart_rate, view_to_purchase_rate, cart_to_purchase_rate, cart_purchase_rate) > 1')}
               AS rate_range_bad,
           {cnt('arppu < arpu - 0.001')} AS arppu_lt_arpu_bad FROM ov""")
def _(t):
    return reconcile.overview_invariants(t.overview)


@case("overview_nulls", f"""
    SELECT {cnt('uv + pv + session_cnt + gmv + order_cnt + buyer_cnt + new_user_cnt + old_user_cnt IS NULL')}
               AS core_null_bad,
           {cnt('''avg_order_value + arppu + arpu + view_to_cart_rate + view_to_purchase_rate + cart_to_purchase_rate
                   + avg_duration_sec + avg_action_cnt + cart_purchase_rate IS NULL''')} AS derived_null_bad FROM ov""")
def _(t):
    return reconcile.overview_nulls(t.overview)


@case("overview_cross_check", f"""
    SELECT COUNT(*) AS compared_days, {cnt('ABS(o.gmv - t.gmv) > 0.01')} AS gmv_bad,
           {cnt('o.order_cnt <> t.order_cnt')} AS order_bad, {cnt('o.buyer_cnt <> t.buyer_cnt')} AS buyer_bad,
           {cnt('o.view_uv <> f.view_uv')} AS view_bad, {cnt('o.cart_uv <> f.cart_uv')} AS cart_bad,
           {cnt('o.purchase_uv <> f.purchase_uv')} AS purchase_bad,
           {cnt('o.session_cnt <> s.session_cnt')} AS session_bad,
           {cnt('t.event_date IS NULL OR f.event_date IS NULL OR s.event_date IS NULL')} AS days_missing_in_references,
           {cnt('o.event_date IS NULL')} AS days_missing_in_overview
    FROM ov o JOIN trade t USING (event_date) JOIN funnel f USING (event_date) JOIN sess s USING (event_date)""")
def _(t):
    return reconcile.overview_cross_check(t.overview, t.trade, t.funnel, t.session_report)


@case("overview_shape", """
    SELECT ROUND(MIN(gmv), 2) AS gmv_min, ROUND(MAX(gmv), 2) AS gmv_max, ROUND(AVG(uv), 0) AS uv_avg,
           MIN(uv) AS uv_min, MAX(uv) AS uv_max, ROUND(SUM(gmv), 2) AS gmv_total,
           CAST(SUM(order_cnt) AS BIGINT) AS order_total FROM ov""")
def _(t):
    return reconcile.overview_shape(t.overview).withColumns(money("gmv_min", "gmv_max", "gmv_total"))


_EDGE = ("uv", "pv", "session_cnt", "view_uv", "cart_uv", "purchase_uv", "order_cnt", "buyer_cnt", "new_user_cnt",
         "old_user_cnt")


@case("overview_edges", f"""
    SELECT event_date, {', '.join(_EDGE)}, ROUND(gmv, 2) AS gmv, {rate('arpu')} AS arpu, {rate('arppu')} AS arppu
    FROM ov WHERE event_date IN (SELECT event_date FROM ov ORDER BY event_date LIMIT 3)
               OR event_date IN (SELECT event_date FROM ov ORDER BY event_date DESC LIMIT 3)""")
def _(t):
    return reconcile.overview_edges(t.overview).withColumns({**money("gmv"), **rates("arpu", "arppu")}).select(
        "event_date", *_EDGE, "gmv", "arpu", "arppu"
    )


# --- observations --------------------------------------------------------------------


@case("hour_coverage", """
    SELECT d.event_date, y.event_type, CAST(COUNT(DISTINCT f.event_hour) AS INTEGER) AS hours_covered,
           CAST(24 - COUNT(DISTINCT f.event_hour) AS INTEGER) AS hours_missing
    FROM (SELECT DISTINCT event_date FROM fact) d
    CROSS JOIN (SELECT UNNEST(['view','cart','remove_from_cart','purchase']) AS event_type) y
    LEFT JOIN fact f ON f.event_date = d.event_date AND f.event_type = y.event_type
    GROUP BY d.event_date, y.event_type""")
def _(t):
    return reconcile.hour_coverage(t.fact)


@case("funnel_inversion", f"""
    SELECT COUNT(*) AS days, COUNT(*) FILTER (WHERE purchase_uv > cart_uv) AS inverted_days,
           {rate('MAX(cart_to_purchase_rate)')} AS max_ratio FROM funnel""")
def _(t):
    return reconcile.funnel_inversion(t.funnel).withColumns(rates("max_ratio"))


@case("event_distribution", f"""
    SELECT event_date, COUNT(*) AS users, {rate('quantile_cont(n, 0.5)')} AS p50,
           {rate('quantile_cont(n, 0.9)')} AS p90, {rate('quantile_cont(n, 0.99)')} AS p99
    FROM (SELECT event_date, user_id, COUNT(*) AS n FROM fact GROUP BY event_date, user_id) GROUP BY event_date""")
def _(t):
    return reconcile.events_per_user(t.ub).withColumns(rates("p50", "p90", "p99"))


@case("event_type_growth", f"""
    SELECT event_type, {cnt(f"event_date <= DATE '{FIRST_HALF[1]}'")} AS base_events,
           {cnt(f"event_date >= DATE '{SECOND_HALF[0]}'")} AS target_events,
           {rnd(f'''({cnt(f"event_date >= DATE '{SECOND_HALF[0]}'")} / 15) /
                    ({cnt(f"event_date <= DATE '{FIRST_HALF[1]}'")} / 15)''', 4)} AS growth
    FROM fact GROUP BY event_type""")
def _(t):
    return reconcile.type_growth(t.fact, FIRST_HALF, SECOND_HALF)


@case("user_overlap", f"""
    SELECT a.event_date, COUNT(*) AS users, COUNT(b.user_id) AS also_yesterday,
           {rnd('COUNT(b.user_id) / COUNT(*)', 4)} AS overlap
    FROM ub a LEFT JOIN ub b ON b.user_id = a.user_id AND b.event_date = a.event_date - 1 GROUP BY a.event_date""")
def _(t):
    return reconcile.user_overlap(t.ub)


@case("zero_price_purchase", f"""
    WITH b AS (SELECT DISTINCT event_date, user_id FROM fact WHERE is_purchase = 1),
    v AS (SELECT DISTINCT event_date, user_id FROM fact WHERE event_type = 'view'),
    o AS (SELECT event_date, COUNT(*) AS buyers, COUNT(*) FILTER (WHERE v.user_id IS NULL) AS n
          FROM b LEFT JOIN v USING (event_date, user_id) GROUP BY event_date)
    SELECT f.event_date, {big('SUM(is_purchase)')} AS purchases,
           {cnt('is_purchase = 1 AND price = 0')} AS zero_price_purchases, ANY_VALUE(COALESCE(o.buyers, 0)) AS buyers,
           ANY_VALUE(COALESCE(o.n, 0)) AS buyers_without_view
    FROM fact f LEFT JOIN o USING (event_date) GROUP BY f.event_date""")
def _(t):
    return reconcile.purchase_oddities(t.fact)
