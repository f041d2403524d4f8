"""Cleaning, dimensions, product history, daily aggregates, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, dims, reports, scd2

from .prelude import NEXT_OPENING, SEEN_BEFORE_NEXT, big, rate, rnd
from .registry import case
from .tables import BEFORE_MERGE, DAY, END, MERGE_DAY, RECENCY, START, Tables, micros, money, rates

RAW_COLUMNS = ("event_date", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id",
               "user_session")
_RAW = ", ".join(RAW_COLUMNS)

# --- cleaning ----------------------------------------------------------------


@case("dirty_classify", f"SELECT epoch_us(event_time) AS event_us, {_RAW}, dirty_reason FROM tagged")
def _(t: Tables):
    return cleaning.with_dirty_reason(t.raw).select(micros("event_time"), *RAW_COLUMNS, "dirty_reason")


@case("dirty_quarantine", f"SELECT epoch_us(event_time) AS event_us, {_RAW}, dirty_reason FROM dirty")
def _(t):
    return t.dirty.select(micros("event_time"), *RAW_COLUMNS, "dirty_reason")


@case("dirty_summary", "SELECT dirty_reason, COUNT(*) AS cnt FROM dirty GROUP BY dirty_reason")
def _(t):
    return cleaning.dirty_summary(t.raw)


@case("dedup_events", f"SELECT epoch_us(event_time) AS event_us, {_RAW.replace('event_date, ', '')} FROM fact")
def _(t):
    return cleaning.dedup_events(cleaning.clean_events(t.raw)).select(micros("event_time"), *RAW_COLUMNS[1:])


@case("derive_fact", f"""
    SELECT epoch_us(event_time) AS event_us, {_RAW},
           CASE event_type WHEN 'view' THEN 'view' WHEN 'cart' THEN 'add to cart'
                WHEN 'remove_from_cart' THEN 'remove from cart' WHEN 'purchase' THEN 'purchase' END AS behavior_type,
           CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_purchase,
           CAST(hour(event_time) AS INTEGER) AS event_hour
    FROM tagged WHERE dirty_reason IS NULL""")
def _(t):
    return cleaning.derive_fact(cleaning.clean_events(t.raw)).select(
        micros("event_time"), *RAW_COLUMNS, "behavior_type", "is_purchase", "event_hour"
    )


@case("build_fact", f"SELECT epoch_us(event_time) AS event_us, {_RAW}, is_purchase, event_hour FROM fact")
def _(t):
    return t.fact.select(micros("event_time"), *RAW_COLUMNS, "is_purchase", "event_hour")


@case("account_balance", """
    SELECT s.event_date, s.n AS source_cnt, f.n AS clean_cnt, d.n AS dirty_cnt, s.n - f.n - d.n AS duplicate_cnt,
           1 AS balanced
    FROM (SELECT event_date, COUNT(*) AS n FROM tagged GROUP BY event_date) s
    JOIN (SELECT event_date, COUNT(*) AS n FROM fact GROUP BY event_date) f USING (event_date)
    JOIN (SELECT event_date, COUNT(*) AS n FROM dirty GROUP BY event_date) d USING (event_date)""")
def _(t):
    return cleaning.account_balance(t.raw, t.fact, t.dirty)


@case("partition_count", f"SELECT COUNT(*) AS cnt FROM fact WHERE event_date = DATE '{DAY}'")
def _(t):
    return cleaning.count_day(t.fact, DAY)


# --- dimensions -----------------------------------------------------------------


@case("dim_date_build", """
    SELECT CAST(d AS DATE) AS date_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
           CAST(day(d) AS INTEGER) AS day, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
           CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week,
           CASE WHEN dayofweek(d) IN (0, 6) THEN 0 ELSE 1 END AS is_workday
    FROM (SELECT UNNEST(generate_series(date_trunc('year', MIN(ts)), date_trunc('year', MAX(ts)) + INTERVAL 1 YEAR
                        - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM events)""")
def _(t):
    # the years of the data, taken from the facts' source
    first, last = t.parquet("events").agg(F.year(F.min("ts")), F.year(F.max("ts"))).first()
    return dims.date_dim(t.spark, f"{first}-01-01", f"{last}-12-31")


@case("dim_user_rebuild", "SELECT * FROM du")
def _(t):
    return t.user_dim


@case("dim_user_merge", f"""
    SELECT user_id, MIN(event_date) AS first_seen_date, MAX(event_date) AS last_seen_date,
           COUNT(DISTINCT event_date) AS active_days,
           MIN(CASE WHEN is_purchase = 1 THEN event_date END) AS first_purchase_date,
           COUNT(DISTINCT CASE WHEN is_purchase = 1 THEN event_date END) AS purchase_days
    FROM fact WHERE event_date <= DATE '{MERGE_DAY}' GROUP BY user_id""")
def _(t):
    before = dims.user_dim(t.fact_before(MERGE_DAY))
    once = dims.merge_user_dim(before, t.fact, MERGE_DAY)
    return dims.merge_user_dim(once, t.fact, MERGE_DAY)  # the second merge must change nothing


@case("user_left_censor", f"""
    SELECT COUNT(*) AS users, COUNT(first_purchase_date) AS buyers,
           COUNT(*) FILTER (WHERE first_purchase_date = DATE '{START}') AS left_censored FROM du""")
def _(t):
    return dims.left_censored(t.user_dim, START)


@case("dim_session_rebuild", """
    SELECT user_session, user_id, epoch_us(session_start_time) AS session_start_us,
           epoch_us(session_end_time) AS session_end_us FROM ds""")
def _(t):
    return dims.session_dim(t.fact).select(
        "user_session", "user_id", micros("session_start_time"), micros("session_end_time")
    )


@case("session_multi_user", f"""
    SELECT COUNT(*) FILTER (WHERE u > 1) AS multi_user_sessions, COUNT(user_session) AS sessions,
           {rnd('COUNT(*) FILTER (WHERE u > 1) / COUNT(user_session)', 6)} AS share
    FROM (SELECT user_session, COUNT(DISTINCT user_id) AS u FROM fact GROUP BY user_session)""")
def _(t):
    return dims.multi_user_sessions(t.fact)


@case("dim_session_append", f"""
    SELECT user_session, MAX(user_id) AS user_id, epoch_us(MIN(event_time)) AS session_start_us,
           epoch_us(MAX(event_time)) AS session_end_us
    FROM fact
    WHERE event_date = DATE '{MERGE_DAY}' AND user_session IS NOT NULL
      AND user_session NOT IN (SELECT user_session FROM fact
                               WHERE event_date < DATE '{MERGE_DAY}' AND user_session IS NOT NULL)
    GROUP BY user_session""")
def _(t):
    known = dims.session_dim(t.fact_before(MERGE_DAY))
    return dims.new_sessions(known, t.fact, MERGE_DAY).select(
        "user_session", "user_id", micros("session_start_time"), micros("session_end_time")
    )


@case("dim_category_rebuild", "SELECT * FROM dc")
def _(t):
    return dims.category_dim(t.fact)


@case("dim_category_merge", f"""
    WITH old AS (SELECT category_id, MAX(category_code) AS c FROM fact
                 WHERE event_date < DATE '{MERGE_DAY}' AND category_id IS NOT NULL GROUP BY category_id),
    oldl AS (SELECT category_id, MAX(NULLIF(split_part(category_code, '.', 1), '')) AS l1,
                    MAX(NULLIF(split_part(category_code, '.', 2), '')) AS l2,
                    MAX(NULLIF(split_part(category_code, '.', 3), '')) AS l3 FROM fact
             WHERE event_date < DATE '{MERGE_DAY}' AND category_id IS NOT NULL GROUP BY category_id),
    new AS (SELECT category_id, MAX(category_code) AS c FROM fact
            WHERE event_date = DATE '{MERGE_DAY}' AND category_id IS NOT NULL GROUP BY category_id)
    SELECT category_id, COALESCE(new.c, old.c) AS category_code,
           COALESCE(NULLIF(split_part(new.c, '.', 1), ''), l1) AS category_l1,
           COALESCE(NULLIF(split_part(new.c, '.', 2), ''), l2) AS category_l2,
           COALESCE(NULLIF(split_part(new.c, '.', 3), ''), l3) AS category_l3
    FROM old FULL JOIN new USING (category_id) LEFT JOIN oldl USING (category_id)""")
def _(t):
    return dims.merge_category_dim(dims.category_dim(t.fact_before(MERGE_DAY)), t.fact, MERGE_DAY)


# --- product history --------------------------------------------------------------

_SCD = "dim_product_sk, product_id, category_id, category_code, brand, dw_start_date, dw_end_date, dw_is_current"


@case("scd2_dominant", "SELECT event_date, product_id, category_id, category_code, brand, cnt FROM dom")
def _(t):
    return scd2.dominant_attrs(t.fact)


@case("scd2_versions", """
    SELECT event_date, product_id, category_id, category_code, brand, cnt, changed, version_no FROM versioned""")
def _(t):
    return scd2.version_runs(scd2.dominant_attrs(t.fact))


@case("scd2_rebuild", f"SELECT {_SCD} FROM scd")
def _(t):
    return t.scd2


# versions known before the merge keep their numbers; those that the day opens follow, and close what they replace on that day
_MERGE_SQL = f"""
    SELECT ROW_NUMBER() OVER (ORDER BY o.event_date = DATE '{MERGE_DAY}', o.product_id, o.event_date) AS dim_product_sk,
           o.product_id, o.category_id, o.category_code, o.brand, o.event_date AS dw_start_date,
           CASE WHEN n.product_id IS NULL THEN DATE '9999-12-31' WHEN n.event_date = DATE '{MERGE_DAY}' THEN n.event_date
                ELSE CAST({SEEN_BEFORE_NEXT} + 1 AS DATE) END AS dw_end_date,
           CASE WHEN n.product_id IS NULL THEN 1 ELSE 0 END AS dw_is_current
    FROM openings o {NEXT_OPENING}"""


@case("scd2_merge", _MERGE_SQL)
def _(t):
    before = scd2.scd2_build(t.fact, START, BEFORE_MERGE)
    return scd2.scd2_merge(before, t.fact, MERGE_DAY)


@case("scd2_preflight", f"""
    SELECT CAST(COUNT(*) AS BIGINT) AS versions, COUNT(DISTINCT product_id) AS products,
           CAST(SUM(dw_is_current) AS BIGINT) AS current_versions,
           MAX(CASE WHEN dw_is_current = 1 THEN dw_start_date END) AS newest_start,
           CASE WHEN MAX(CASE WHEN dw_is_current = 1 THEN dw_start_date END) > DATE '{START}'
                THEN 'day_before_newest_version' END AS reason
    FROM scd""")
def _(t):
    return scd2.scd2_preflight(t.scd2, START)


@case("scd2_validate", """
    SELECT (SELECT COUNT(*) FROM (SELECT product_id FROM scd GROUP BY product_id HAVING SUM(dw_is_current) <> 1))
               AS bad_current,
           (SELECT COUNT(*) FROM scd a JOIN scd b ON a.product_id = b.product_id AND a.dim_product_sk < b.dim_product_sk
              AND a.dw_start_date < b.dw_end_date AND b.dw_start_date < a.dw_end_date) AS overlaps,
           (SELECT COUNT(*) FROM (SELECT product_id FROM scd GROUP BY product_id, dw_start_date HAVING COUNT(*) > 1))
               AS duplicate_starts""")
def _(t):
    return scd2.scd2_validate(t.scd2)


@case("scd2_stats", f"""
    SELECT COUNT(DISTINCT product_id) AS products, COUNT(*) AS versions,
           COUNT(*) FILTER (WHERE dw_is_current = 1) AS current_versions,
           COUNT(*) FILTER (WHERE dw_is_current = 0) AS history_versions,
           COUNT(*) FILTER (WHERE dw_start_date = DATE '2024-01-11') AS opened,
           COUNT(*) FILTER (WHERE dw_end_date = DATE '2024-01-11') AS closed,
           {rnd('COUNT(*) / COUNT(DISTINCT product_id)', 3)} AS versions_per_product
    FROM scd""")
def _(t):
    return scd2.scd2_stats(t.scd2, "2024-01-11")


@case("scd2_asof", """
    SELECT p.event_date, p.product_id, p.sales_cnt, s.dim_product_sk, s.category_id AS asof_category_id,
           s.category_code AS asof_category_code, s.brand AS asof_brand
    FROM pd p LEFT JOIN scd s ON s.product_id = p.product_id AND p.event_date >= s.dw_start_date
                             AND p.event_date < s.dw_end_date""")
def _(t):
    return scd2.scd2_asof(t.scd2, t.pd.select("event_date", "product_id", "sales_cnt"))


@case("scd2_current", f"SELECT {_SCD} FROM scd WHERE dw_is_current = 1")
def _(t):
    return scd2.scd2_current(t.scd2)


# --- daily aggregates ---------------------------------------------------------------


@case("dws_user_session", "SELECT * FROM us")
def _(t):
    return t.us


@case("dws_product", "SELECT * REPLACE (ROUND(sales_amount, 2) AS sales_amount) FROM pd")
def _(t):
    return t.pd.withColumns(money("sales_amount"))


@case("dws_user_behavior", "SELECT * REPLACE (ROUND(purchase_amount, 2) AS purchase_amount) FROM ub")
def _(t):
    return t.ub.withColumns(money("purchase_amount"))


@case("dws_traffic_hour", "SELECT * REPLACE (ROUND(gmv, 2) AS gmv) FROM th")
def _(t):
    return t.th.withColumns(money("gmv"))


# --- reports ------------------------------------------------------------------------


@case("ads_trade", f"""
    SELECT event_date, ROUND(gmv, 2) AS gmv, order_cnt, buyer_cnt, {rate('avg_order_value')} AS avg_order_value,
           {rate('arppu')} AS arppu FROM trade""")
def _(t):
    return t.trade.withColumns({**money("gmv"), **rates("avg_order_value", "arppu")})


_FUNNEL_RATES = ("view_to_cart_rate", "view_to_purchase_rate", "cart_to_purchase_rate")


@case("ads_funnel", "SELECT event_date, view_uv, cart_uv, purchase_uv, "
      + ", ".join(f"{rate(c)} AS {c}" for c in _FUNNEL_RATES) + " FROM funnel")
def _(t):
    return t.funnel.withColumns(rates(*_FUNNEL_RATES))


@case("ads_hot_rank", "SELECT * REPLACE (ROUND(sales_amount, 2) AS sales_amount) FROM hot")
def _(t):
    return t.hot.withColumns(money("sales_amount"))


_SESSION_RATES = ("avg_duration_sec", "avg_action_cnt", "cart_purchase_rate")


@case("ads_session_behavior", "SELECT event_date, session_cnt, "
      + ", ".join(f"{rate(c)} AS {c}" for c in _SESSION_RATES) + " FROM sess")
def _(t):
    return t.session_report.withColumns(rates(*_SESSION_RATES))


@case("ads_traffic_hour", "SELECT * REPLACE (ROUND(gmv, 2) AS gmv) FROM hour")
def _(t):
    return t.hour_report.withColumns(money("gmv"))


@case("ads_retention", "SELECT * FROM ret")
def _(t):
    return t.retention


@case("ads_rfm_fact", "SELECT * REPLACE (ROUND(m_amount, 2) AS m_amount) FROM rfm")
def _(t):
    return t.rfm.withColumns(money("m_amount"))


@case("ads_rfm_dws", f"""
    WITH p AS (SELECT user_id, CAST(SUM(purchase_cnt) AS BIGINT) AS f, SUM(purchase_amount) AS m,
                      MAX(CASE WHEN purchase_cnt > 0 THEN event_date END) AS last_day
               FROM ub GROUP BY user_id HAVING SUM(purchase_cnt) > 0),
    g AS (SELECT *, m >= (SELECT AVG(m) FROM p) AS mg, f >= (SELECT AVG(f) FROM p) AS fg,
                 DATE '{END}' - last_day <= {RECENCY} AS rg FROM p)
    SELECT user_id, CAST(DATE '{END}' - last_day AS BIGINT) AS r_days, f AS f_cnt, ROUND(m, 2) AS m_amount,
           CASE WHEN mg AND fg AND rg THEN 'key value' WHEN mg AND fg THEN 'key keep' WHEN mg AND rg THEN 'key develop'
                WHEN mg THEN 'key win-back' WHEN fg AND rg THEN 'general value' WHEN fg THEN 'general keep'
                WHEN rg THEN 'general develop' ELSE 'general win-back' END AS rfm_seg,
           '{END}' AS as_of_dt
    FROM g""")
def _(t):
    return reports.rfm_from_daily(t.ub, START, END, RECENCY).withColumns(money("m_amount"))


@case("rfm_segment_summary", f"""
    SELECT as_of_dt, rfm_seg, COUNT(*) AS users, ROUND(SUM(m_amount), 2) AS amount,
           {rate('COUNT(*) / SUM(COUNT(*)) OVER ()')} AS user_share,
           {rate('SUM(m_amount) / SUM(SUM(m_amount)) OVER ()')} AS amount_share,
           CASE WHEN rfm_seg = 'key value' THEN 1 ELSE 0 END AS is_vip
    FROM rfm GROUP BY as_of_dt, rfm_seg""")
def _(t):
    return reports.rfm_summary(t.rfm).withColumns({**money("amount"), **rates("user_share", "amount_share")})


OVERVIEW_RATES = ("avg_order_value", "arppu", "arpu", *_FUNNEL_RATES, *_SESSION_RATES)


@case("ads_overview", "SELECT * REPLACE (ROUND(gmv, 2) AS gmv, "
      + ", ".join(f"{rate(c)} AS {c}" for c in OVERVIEW_RATES) + ") FROM ov")
def _(t):
    return t.overview.withColumns({**money("gmv"), **rates(*OVERVIEW_RATES)})


@case("new_old_users", """
    SELECT b.event_date, COUNT(*) FILTER (WHERE d.first_seen_date = b.event_date) AS new_user_cnt,
           COUNT(*) FILTER (WHERE d.first_seen_date <> b.event_date) AS old_user_cnt
    FROM ub b JOIN du d USING (user_id) GROUP BY b.event_date""")
def _(t):
    return reports.new_old_users(t.ub, t.user_dim)


@case("time_bucket_month", f"""
    SELECT time_bucket, {big('SUM(pv)')} AS pv, {big('SUM(purchase_cnt)')} AS orders,
           {rnd('SUM(pv) / SUM(SUM(pv)) OVER () * 100', 4)} AS pv_share,
           {rnd('SUM(purchase_cnt) / SUM(SUM(purchase_cnt)) OVER () * 100', 4)} AS order_share,
           {rate('SUM(gmv) / SUM(purchase_cnt)')} AS avg_order_value,
           COUNT(DISTINCT CASE WHEN is_peak_hour = 1 THEN event_date END) AS peak_days
    FROM hour GROUP BY time_bucket""")
def _(t):
    return reports.bucket_summary(t.hour_report).withColumns(rates("avg_order_value"))


@case("hour_profile", f"""
    SELECT event_hour, {big('SUM(pv)')} AS pv, {big('SUM(purchase_cnt)')} AS orders,
           {big('SUM(is_peak_hour)')} AS peak_days,
           {rnd('SUM(pv) / SUM(SUM(pv)) OVER () * 100', 4)} AS pv_share,
           CASE WHEN SUM(purchase_cnt) > 0 THEN {rate('SUM(gmv) / SUM(purchase_cnt)')} END AS avg_order_value,
           {rnd('MAX(SUM(pv)) OVER () / MIN(SUM(pv)) OVER ()', 4)} AS peak_to_trough
    FROM hour GROUP BY event_hour""")
def _(t):
    return reports.hour_profile(t.hour_report).withColumns(rates("avg_order_value"))
