"""Benchmark set, skewed aggregation, window-level analytics, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import benchset, dims, insight, logs, reports, skew
from tidemark.sources import attempts
from tidemark.session import scratch_path, shuffles_released

from .prelude import END, START, big, cnt, rate, rnd, uv
from .registry import case
from .tables import DAY, FIRST_HALF, SECOND_HALF, money, rates

# --- benchmark set ---------------------------------------------------------------


@case("q1_sum_price", "SELECT ROUND(SUM(price), 2) AS total_price FROM fact")
def _(t):
    return benchset.q1_sum_price(t.fact).withColumns(money("total_price"))


@case("q1m_count", "SELECT COUNT(*) AS cnt FROM fact")
def _(t):
    return benchset.q1m_count(t.fact)


@case("q2_one_day", f"SELECT COUNT(*) AS cnt FROM fact WHERE event_date = DATE '{DAY}'")
def _(t):
    return benchset.q2_one_day(t.fact, DAY)


@case("q3_group_type", "SELECT event_type, COUNT(*) AS cnt FROM fact GROUP BY event_type")
def _(t):
    return benchset.q3_group_type(t.fact)


@case("q4_day_gmv", """
    SELECT event_date, COUNT(*) AS cnt, ROUND(SUM(price), 2) AS total_price FROM fact GROUP BY event_date""")
def _(t):
    return benchset.q4_day_gmv(t.fact).withColumns(money("total_price"))


@case("q5_uv", "SELECT COUNT(DISTINCT user_id) AS uv FROM fact")
def _(t):
    return benchset.q5_uv(t.fact)


@case("q6_group_product", """
    SELECT product_id, COUNT(*) AS cnt, ROUND(SUM(price), 2) AS total_price FROM fact GROUP BY product_id""")
def _(t):
    return benchset.q6_group_product(t.fact).withColumns(money("total_price"))


@case("q7_funnel_day", f"""
    SELECT {uv('view')} AS view_uv, {uv('cart')} AS cart_uv, {uv('purchase')} AS purchase_uv
    FROM fact WHERE event_date = DATE '{DAY}'""")
def _(t):
    return benchset.q7_funnel_day(t.fact, DAY)


@case("q8_rank_category", f"""
    SELECT product_id, category_code, ROUND(sales_amount, 2) AS sales_amount FROM (
        SELECT h.product_id, c.category_code, h.sales_amount FROM hot h LEFT JOIN dc c USING (category_id)
        WHERE h.event_date = DATE '{DAY}' ORDER BY ROUND(h.sales_amount, 4) DESC NULLS LAST, h.product_id LIMIT 100)""")
def _(t):
    return benchset.q8_rank_category(t.hot, dims.category_dim(t.fact), DAY).withColumns(money("sales_amount"))


@case("q9_buyers", """
    SELECT user_id, COUNT(*) AS cnt, ROUND(SUM(price), 2) AS total_price FROM fact WHERE event_type = 'purchase'
    GROUP BY user_id""")
def _(t):
    return benchset.q9_buyers(t.fact).withColumns(money("total_price"))


@case("q10_topn_window", """
    SELECT event_date, product_id, ROUND(sales_amount, 2) AS sales_amount, CAST(rn AS INTEGER) AS rn
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_date
                     ORDER BY ROUND(sales_amount, 4) DESC NULLS LAST, product_id) AS rn FROM pd) WHERE rn <= 100""")
def _(t):
    return benchset.q10_topn_window(t.pd).withColumns(money("sales_amount"))


_FORM_ROWS = {
    **dict.fromkeys(("q1_sum_price", "q1m_count", "q2_one_day", "q5_uv", "q7_funnel_day"), "SELECT CAST(1 AS BIGINT)"),
    "q3_group_type": "SELECT COUNT(DISTINCT event_type) FROM fact", "q4_day_gmv": "SELECT COUNT(DISTINCT event_date) FROM fact",
    "q6_group_product": "SELECT COUNT(DISTINCT product_id) FROM fact", "q8_rank_category": f"SELECT COUNT(*) FROM hot WHERE event_date = DATE '{DAY}'",
    "q9_buyers": "SELECT COUNT(DISTINCT user_id) FROM fact WHERE is_purchase = 1", "q10_topn_window": "SELECT COUNT(*) FROM hot",
}


@case("bench_sql_forms", " UNION ALL ".join(
    f"SELECT '{n}' AS query, n AS rows_one, n AS rows_other, 1 AS equal FROM ({q}) x(n)" for n, q in _FORM_ROWS.items()))
def _(t):
    """Every query as SQL and as DataFrame operations; the second form meets its rows in another order."""
    dim = dims.category_dim(t.fact)
    for view, df in (("fact", t.fact), ("hot_rank", t.hot), ("product_daily", t.pd), ("dim_category", dim)):
        df.createOrReplaceTempView(view)
    fact = t.fact.repartition(7, "price")
    frames = {
        "q1_sum_price": benchset.q1_sum_price(fact), "q1m_count": benchset.q1m_count(fact), "q2_one_day": benchset.q2_one_day(fact, DAY),
        "q3_group_type": benchset.q3_group_type(fact), "q4_day_gmv": benchset.q4_day_gmv(fact), "q5_uv": benchset.q5_uv(fact),
        "q6_group_product": benchset.q6_group_product(fact), "q7_funnel_day": benchset.q7_funnel_day(fact, DAY),
        "q8_rank_category": benchset.q8_rank_category(t.hot, dim, DAY), "q9_buyers": benchset.q9_buyers(fact), "q10_topn_window": benchset.q10_topn_window(t.pd),
    }
    return benchset.forms_agree({n: benchset.sql_form(t.spark, n, DAY) for n in frames}, frames)


@case("bench_row_gate", """
    SELECT 'q4_day_gmv' AS query, CAST(30 AS BIGINT) AS expected_rows, COUNT(DISTINCT event_date) AS actual_rows,
           CASE WHEN COUNT(DISTINCT event_date) = 30 THEN 1 ELSE 0 END AS ok FROM fact
    UNION ALL SELECT 'q6_group_product', 100, COUNT(DISTINCT product_id),
           CASE WHEN COUNT(DISTINCT product_id) = 100 THEN 1 ELSE 0 END FROM fact
    UNION ALL SELECT 'q3_group_type', 3, COUNT(DISTINCT event_type),
           CASE WHEN COUNT(DISTINCT event_type) = 3 THEN 1 ELSE 0 END FROM fact""")
def _(t):
    # three event types are expected where the data has four: this row must not be ok
    return benchset.row_gate(
        {"q4_day_gmv": benchset.q4_day_gmv(t.fact), "q6_group_product": benchset.q6_group_product(t.fact),
         "q3_group_type": benchset.q3_group_type(t.fact)},
        {"q4_day_gmv": 30, "q6_group_product": 100, "q3_group_type": 3},
    )


# --- skewed aggregation -------------------------------------------------------------

_AGG = """SELECT product_id, ROUND(SUM(sales_amount), 2) AS gmv, ROUND(SUM(quantity), 2) AS sales_cnt, COUNT(*) AS row_cnt
          FROM sales GROUP BY product_id"""


@case("agg_naive", _AGG)
def _(t):
    return skew.agg_naive(t.sales).withColumns(money("gmv", "sales_cnt"))


@case("hot_keys", """
    SELECT product_id, COUNT(*) AS row_cnt FROM sales GROUP BY product_id HAVING COUNT(*) >= 0.0005 * (SELECT COUNT(*) FROM sales)""")
def _(t):
    return skew.hot_keys(t.sales, min_share=0.0005)


@case("key_distribution", f"""
    SELECT product_id, row_cnt, share FROM (
        SELECT product_id, COUNT(*) AS row_cnt, {rnd('COUNT(*) / SUM(COUNT(*)) OVER ()', 6)} AS share
        FROM sales GROUP BY product_id ORDER BY row_cnt DESC, product_id LIMIT 6)""")
def _(t):
    return skew.key_share(t.sales)


@case("agg_salted_all", _AGG)
def _(t):
    return skew.agg_salted(t.sales).withColumns(money("gmv", "sales_cnt"))


@case("agg_salted_hot", _AGG)
def _(t):
    return skew.agg_salted_hot(t.sales).withColumns(money("gmv", "sales_cnt"))


@case("agg_rebalance", _AGG)
def _(t):
    return skew.agg_rebalance(t.sales).withColumns(money("gmv", "sales_cnt"))


@case("skew_equivalence", """
    SELECT UNNEST(['salted_all', 'salted_hot', 'rebalance']) AS variant, COUNT(DISTINCT product_id) AS keys,
           CAST(0 AS BIGINT) AS diff_keys FROM sales""")
def _(t):
    return skew.skew_equivalence(t.sales)


@case("task_skew_metrics", f"""
    WITH tasks AS (SELECT l_linenumber AS stage_id, CAST(l_quantity * 10 AS BIGINT) AS ms,
                          CASE WHEN l_linenumber > 1 THEN l_suppkey * 100 ELSE 0 END AS bytes FROM lineitem),
    s AS (SELECT *, 'all' AS side FROM tasks UNION ALL SELECT *, 'reduce' FROM tasks WHERE bytes > 0)
    SELECT stage_id, side, COUNT(*) AS tasks, MAX(ms) AS max_ms, median(ms) AS median_ms, MIN(ms) AS min_ms,
           {big('SUM(ms)')} AS sum_ms, {rnd('MAX(ms) / median(ms)', 2)} AS skew_ratio, MAX(bytes) AS max_read_bytes,
           median(bytes) AS median_read_bytes,
           CASE WHEN median(bytes) > 0 THEN {rnd('MAX(bytes) / median(bytes)', 2)} END AS read_skew
    FROM s GROUP BY stage_id, side""")
def _(t):
    # an event log with one task per order line, written as the JSON lines a Spark event log consists of
    start = F.lit(1_700_000_000_000).cast("bigint")
    li = t.parquet("lineitem")
    event = li.select(F.to_json(F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.col("l_linenumber").alias("Stage ID"),
        F.struct(
            start.alias("Launch Time"), (start + (F.col("l_quantity") * 10).cast("bigint")).alias("Finish Time")
        ).alias("Task Info"),
        F.struct(F.struct(
            F.when(F.col("l_linenumber") > 1, F.col("l_suppkey") * 60).otherwise(F.lit(0)).alias("Local Bytes Read"),
            F.when(F.col("l_linenumber") > 1, F.col("l_suppkey") * 40).otherwise(F.lit(0)).alias("Remote Bytes Read"),
        ).alias("Shuffle Read Metrics")).alias("Task Metrics"),
    )).alias("value"))
    path = scratch_path(t.spark, "eventlog")
    event.unionByName(event.limit(1).select(F.lit('{"Event":"SparkListenerStageCompleted"}').alias("value"))).write.text(
        path
    )
    return skew.task_skew(t.spark, path)


# --- window-level analytics -----------------------------------------------------------

_KPI = f"""ROUND(SUM(CASE WHEN is_purchase = 1 THEN price ELSE 0 END), 2) AS amount,
           {big('SUM(is_purchase)')} AS purchases, COUNT(DISTINCT user_id) AS active_users, {uv('purchase')} AS buyers,
           COUNT(DISTINCT CASE WHEN is_purchase = 1 THEN user_session END) AS buying_sessions,
           {rate(f"{uv('purchase')} / COUNT(DISTINCT user_id)")} AS buyer_share"""


@case("window_kpis", f"""
    SELECT 'all' AS window_name, {_KPI} FROM fact
    UNION ALL SELECT 'first half', {_KPI} FROM fact WHERE event_date <= DATE '{FIRST_HALF[1]}'
    UNION ALL SELECT 'second half', {_KPI} FROM fact WHERE event_date >= DATE '{SECOND_HALF[0]}'""")
def _(t):
    windows = [("all", START, END), ("first half", *FIRST_HALF), ("second half", *SECOND_HALF)]
    return insight.window_kpis(t.fact, windows).withColumns({**money("amount"), **rates("buyer_share")})


@case("daily_trend", f"SELECT event_date, {_KPI} FROM fact GROUP BY event_date")
def _(t):
    return insight.daily_trend(t.fact, START, END).withColumns({**money("amount"), **rates("buyer_share")})


def _ranking_sql(attr: str, n: int) -> str:
    return f"""
    SELECT *, DENSE_RANK() OVER (ORDER BY amount DESC NULLS LAST)::INTEGER AS rank FROM (
        SELECT CAST({attr} AS VARCHAR) AS attr_value, ROUND(SUM(price), 2) AS amount, COUNT(*) AS purchases
        FROM fact WHERE is_purchase = 1 AND {attr} IS NOT NULL GROUP BY {attr}
        ORDER BY amount DESC NULLS LAST, attr_value LIMIT {n})"""


@case("attr_ranking", _ranking_sql("brand", 20))
def _(t):
    return insight.attr_ranking(t.fact, "brand", 20)


@case("attr_ranking_product", _ranking_sql("product_id", 50))
def _(t):
    return insight.attr_ranking(t.fact, "product_id", 50)


@case("attr_ranking_category", _ranking_sql("category_code", 20))
def _(t):
    return insight.attr_ranking(t.fact, "category_code", 20)


@case("monthly_repurchase", f"""
    WITH a AS (SELECT DISTINCT user_id FROM fact WHERE is_purchase = 1 AND event_date <= DATE '{FIRST_HALF[1]}'),
    b AS (SELECT DISTINCT user_id FROM fact WHERE is_purchase = 1 AND event_date >= DATE '{SECOND_HALF[0]}')
    SELECT COUNT(*) AS buyers, COUNT(b.user_id) AS returning,
           {rnd('COUNT(b.user_id) / COUNT(*)', 4)} AS repurchase_share
    FROM a LEFT JOIN b USING (user_id)""")
def _(t):
    return insight.repurchase(t.fact, FIRST_HALF, SECOND_HALF)


@case("order_repurchase", f"""
    WITH o AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders),
    a AS (SELECT DISTINCT c FROM o WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
    b AS (SELECT DISTINCT c FROM o WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
    SELECT COUNT(*) AS buyers, COUNT(b.c) AS returning, {rnd('COUNT(b.c) / COUNT(*)', 4)} AS repurchase_share
    FROM a LEFT JOIN b USING (c)""")
def _(t):
    orders = t.parquet("orders").select(
        F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("event_date"), F.lit(1).alias("is_purchase")
    )
    return insight.repurchase(orders, ("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31"))


@case("product_window", f"""
    SELECT product_id, {uv('view')} AS view_users, {uv('cart')} AS cart_users, {uv('purchase')} AS buy_users,
           ROUND(SUM(CASE WHEN is_purchase = 1 THEN price ELSE 0 END), 2) AS amount,
           CASE WHEN {uv('view')} > 0 AND {uv('purchase')} = 0 THEN 1 ELSE 0 END AS viewed_not_bought
    FROM fact GROUP BY product_id""")
def _(t):
    return insight.product_window(t.fact, START, END).withColumns(money("amount"))


@case("price_bands", f"""
    WITH p AS (SELECT CASE WHEN price IS NULL OR isnan(price) OR isinf(price) THEN -1 WHEN price = 0 THEN 0
                           WHEN price < 50 THEN 1 WHEN price < 100 THEN 2 WHEN price < 200 THEN 3 WHEN price < 400 THEN 4
                           ELSE 5 END AS band_no, price FROM fact WHERE is_purchase = 1),
    g AS (SELECT band_no, COUNT(*) AS records, COALESCE(SUM(CASE WHEN band_no >= 0 THEN price END), 0.0) AS amount
          FROM p GROUP BY band_no)
    SELECT CAST(band_no AS INTEGER) AS band_no,
           CASE band_no WHEN -1 THEN 'excluded' WHEN 0 THEN 'zero' WHEN 1 THEN '<50' WHEN 2 THEN '50-100'
                WHEN 3 THEN '100-200' WHEN 4 THEN '200-400' ELSE '>=400' END AS band,
           records, ROUND(amount, 2) AS amount,
           CASE WHEN band_no > 0 THEN {rnd('records / (SELECT SUM(records) FROM g WHERE band_no > 0)', 4)} END AS record_share,
           CASE WHEN band_no > 0 THEN {rnd('amount / (SELECT SUM(amount) FROM g WHERE band_no > 0)', 4)} END AS amount_share
    FROM g""")
def _(t):
    return insight.price_bands(t.fact).withColumns(money("amount"))


@case("rf_matrix", f"""
    SELECT r_good, f_good, COUNT(*) AS users, ROUND(SUM(m_amount), 2) AS amount,
           {rnd('COUNT(*) / SUM(COUNT(*)) OVER ()', 4)} AS user_share FROM scored GROUP BY r_good, f_good""")
def _(t):
    return insight.rf_matrix(t.scored).withColumns(money("amount"))


@case("strict_funnel_24h", f"""
    WITH v AS (SELECT user_id, product_id, MIN(event_time) AS vt FROM fact WHERE event_type = 'view' GROUP BY ALL),
    c AS (SELECT v.user_id, v.product_id, v.vt, MIN(f.event_time) AS ct FROM v JOIN fact f USING (user_id, product_id)
          WHERE f.event_type = 'cart' AND f.event_time BETWEEN v.vt AND v.vt + INTERVAL 24 HOURS GROUP BY ALL),
    p AS (SELECT DISTINCT c.user_id, c.product_id FROM c JOIN fact f USING (user_id, product_id)
          WHERE f.event_type = 'purchase' AND f.event_time BETWEEN c.ct AND c.vt + INTERVAL 24 HOURS)
    SELECT a AS view_pairs, b AS cart_pairs, d AS purchase_pairs,
           CASE WHEN a > 0 THEN {rnd('b / a', 4)} END AS view_to_cart,
           CASE WHEN b > 0 THEN {rnd('d / b', 4)} END AS cart_to_purchase
    FROM (SELECT (SELECT COUNT(*) FROM v) AS a, (SELECT COUNT(*) FROM c) AS b, (SELECT COUNT(*) FROM p) AS d)""")
def _(t):
    return insight.strict_funnel(t.fact, 24)


@case("strict_funnel_10d", f"""
    WITH v AS (SELECT user_id, product_id, MIN(event_time) AS vt FROM fact WHERE event_type = 'view' GROUP BY ALL),
    c AS (SELECT v.user_id, v.product_id, v.vt, MIN(f.event_time) AS ct FROM v JOIN fact f USING (user_id, product_id)
          WHERE f.event_type = 'cart' AND f.event_time BETWEEN v.vt AND v.vt + INTERVAL 240 HOURS GROUP BY ALL),
    p AS (SELECT DISTINCT c.user_id, c.product_id FROM c JOIN fact f USING (user_id, product_id)
          WHERE f.event_type = 'purchase' AND f.event_time BETWEEN c.ct AND c.vt + INTERVAL 240 HOURS)
    SELECT a AS view_pairs, b AS cart_pairs, d AS purchase_pairs,
           CASE WHEN a > 0 THEN {rnd('b / a', 4)} END AS view_to_cart,
           CASE WHEN b > 0 THEN {rnd('d / b', 4)} END AS cart_to_purchase
    FROM (SELECT (SELECT COUNT(*) FROM v) AS a, (SELECT COUNT(*) FROM c) AS b, (SELECT COUNT(*) FROM p) AS d)""")
def _(t):
    return insight.strict_funnel(t.fact, 240)


_PERIOD = "FILTER (WHERE event_date <= DATE '2024-01-15')", "FILTER (WHERE event_date >= DATE '2024-01-16')"


@case("gmv_decomposition", f"""
    WITH s AS (SELECT COUNT(DISTINCT user_id) {_PERIOD[0]} AS b0, COUNT(DISTINCT user_id) {_PERIOD[1]} AS b1,
                      COUNT(*) {_PERIOD[0]} AS n0, COUNT(*) {_PERIOD[1]} AS n1,
                      SUM(price) {_PERIOD[0]} AS g0, SUM(price) {_PERIOD[1]} AS g1 FROM fact WHERE is_purchase = 1),
    l AS (SELECT *, CASE WHEN g0 = g1 THEN g0 ELSE (g1 - g0) / (ln(g1) - ln(g0)) END AS m FROM s)
    SELECT b0 AS buyers_0, b1 AS buyers_1, n0 AS purchases_0, n1 AS purchases_1, ROUND(g0, 2) AS gmv_0,
           ROUND(g1, 2) AS gmv_1, ROUND(g1 - g0, 2) AS gmv_change, {rnd('m * ln(b1 / b0)', 2)} AS by_buyers,
           {rnd('m * ln((n1 / b1) / (n0 / b0))', 2)} AS by_frequency,
           {rnd('m * ln((g1 / n1) / (g0 / n0))', 2)} AS by_price FROM l""")
def _(t):
    return insight.gmv_decomposition(t.fact, FIRST_HALF, SECOND_HALF).withColumns(
        money("gmv_0", "gmv_1", "gmv_change", "by_buyers", "by_frequency", "by_price")
    )


# --- logs -------------------------------------------------------------------------------

# what the derived logs contain is known from the order line they come from
_LOG = """
    l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem),
    a AS (SELECT 'dag_' || (o_custkey % 5) AS dag_id, strftime(o_orderdate, '%Y-%m-%d') AS run_id,
                 'task_' || o AS task_id, -1 AS map_index, CAST(n AS INTEGER) AS attempt, o, n, (o + n) % 9 AS kind
          FROM l JOIN orders ON o_orderkey = o)"""
_KEYS = "dag_id, run_id, task_id, map_index, attempt"
_PARSE = "'pyspark.errors.ParseException: [PARSE_SYNTAX_ERROR] Syntax error near end. (line 3, pos ' || n || ')'"
_TRACE = "Traceback (most recent call last):"
_LINES = f"""
    CASE kind
        WHEN 0 THEN ['[DONE] ok']
        WHEN 1 THEN ['{_TRACE}', '  File "/opt/jobs/job_' || n || '.py", line ' || n || ', in main',
                     '  File "/usr/lib/site-packages/pyspark/deco.py", line 12, in deco', {_PARSE}, '== SQL ==',
                     'SELECT customer, SUM(amount)', 'FROM t_' || o, 'GROUP BY', '--------^^^',
                     'Task failed with exception']
        WHEN 2 THEN ['Task failed', '{_TRACE}', '  File "/opt/jobs/job_' || n || '.py", line ' || n,
                     'AnalysisException: [UNRESOLVED_COLUMN.WITH_SUGGESTION] No column c_' || o]
        WHEN 3 THEN ['stderr [DIVIDE_BY_ZERO] Division by zero in task ' || o, '::endgroup::', '[WARN] not an error']
        WHEN 4 THEN ['SparkArithmeticException: [ARITHMETIC_OVERFLOW] overflow', '[DONE] part',
                     '[CAST_INVALID_INPUT] bad value ' || o]
        WHEN 5 THEN ['Task failed', '[PARSE_SYNTAX_ERROR] Syntax error at x' || o]
        WHEN 6 THEN ['Task failed', '{{not json}} [CAST_INVALID_INPUT] bad ' || o]
        WHEN 7 THEN ['x', '{_TRACE}', 'Outer: why', '{_TRACE}', 'AnalysisException: [UNRESOLVED_COLUMN] deep ' || o, 'also']
        ELSE ['{_TRACE}'] || list_transform(range(1, CASE WHEN o % 64 = 0 THEN 151 ELSE 4 END), lambda i: 'step ' || i)
             || ['[DIVIDE_BY_ZERO] far ' || o] END"""


@case("log_lines", f"""
    WITH {_LOG.strip()},
    t AS (SELECT *, ['Task started', '[INFO] plain line'] || {_LINES} AS lines FROM a)
    SELECT {_KEYS}, CAST(UNNEST(generate_series(0, len(lines) - 1)) AS INTEGER) AS line_no, UNNEST(lines) AS text FROM t""")
def _(t):
    return logs.decode_logs(attempts.task_logs(t.spark, t.sf_dir))


# per error: kind of log, first and last line of its block behind the two lines all logs begin with, what it is, the line of its message
_BLOCKS = """
    (1, 1, 9, 'PARSE_SYNTAX_ERROR', 'ParseException', 'syntax error', 4), (2, 2, 4, 'UNRESOLVED_COLUMN.WITH_SUGGESTION', 'AnalysisException', 'analysis error', 4),
    (3, 1, 1, 'DIVIDE_BY_ZERO', 'SparkSQLExecutionError', 'execution error', 1), (4, 1, 3, 'ARITHMETIC_OVERFLOW', 'SparkArithmeticException', 'execution error', 1),
    (4, 3, 3, 'CAST_INVALID_INPUT', 'SparkSQLExecutionError', 'execution error', 3), (5, 2, 2, 'PARSE_SYNTAX_ERROR', 'SparkSQLExecutionError', 'syntax error', 2),
    (6, 2, 2, 'CAST_INVALID_INPUT', 'SparkSQLExecutionError', 'execution error', 2), (7, 4, 6, 'UNRESOLVED_COLUMN', 'AnalysisException', 'analysis error', 5),
    (8, 1, 999, 'DIVIDE_BY_ZERO', 'SparkSQLExecutionError', 'execution error', -1)"""


@case("sql_errors", f"""
    WITH {_LOG.strip()},
    x AS (SELECT *, {_LINES} AS lines FROM a),
    e(kind, first_line, last_line, error_code, exception_type, category, message_line) AS (VALUES {_BLOCKS.strip()})
    SELECT {_KEYS}, error_code, exception_type, category, lines[message_line] AS message,
           CASE WHEN kind IN (1, 2) THEN '/opt/jobs/job_' || n || '.py' END AS source_file, CASE WHEN kind IN (1, 2) THEN attempt END AS source_line,
           CASE WHEN kind = 1 THEN 3 END AS sql_line, CASE WHEN kind = 1 THEN attempt END AS sql_pos,
           CASE WHEN kind = 1 THEN array_to_string(lines[6:8], chr(10)) END AS sql, array_to_string(lines[first_line:last_line], chr(10)) AS raw_traceback
    FROM x JOIN e USING (kind)""")
def _(t):
    return logs.extract_sql_errors(attempts.task_logs(t.spark, t.sf_dir))


_ATTEMPTS = f"""{_LOG.strip()},
    o AS (SELECT 'dag_' || (o_custkey % 5) AS dag_id, strftime(o_orderdate, '%Y-%m-%d') AS run_id,
                 'task_' || o_orderkey AS task_id, -1 AS map_index, o_orderstatus AS st FROM orders),
    k AS (SELECT dag_id, run_id, task_id, map_index, 1 AS attempt,
                 CASE st WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'success' END AS state FROM o
          UNION ALL SELECT dag_id, run_id, task_id, map_index, 2, 'success' FROM o WHERE st = 'F'),
    m AS (SELECT {_KEYS}, COALESCE(k.state, 'unknown') AS state, CASE WHEN k.state IS NULL THEN NULL ELSE 90.0::DOUBLE END
                 AS duration, CASE WHEN a.kind IS NULL THEN 0 ELSE 1 END AS has_log,
                 CASE a.kind WHEN 0 THEN 0 WHEN 4 THEN 2 WHEN NULL THEN 0 ELSE CASE WHEN a.kind IS NULL THEN 0 ELSE 1 END END
                 AS errors, a.kind FROM k FULL JOIN a USING ({_KEYS}))"""


@case("attempts_merge", f"""
    WITH {_ATTEMPTS}
    SELECT {_KEYS}, m.state, CASE WHEN m.state <> 'unknown' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS start_date,
           CASE WHEN m.state <> 'unknown' THEN strftime(o_orderdate + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') END AS end_date, duration, has_log
    FROM m JOIN orders ON o_orderkey = CAST(substr(task_id, 6) AS BIGINT)""")
def _(t):
    merged = logs.merge_attempts(
        attempts.task_history(t.spark, t.sf_dir), attempts.task_current(t.spark, t.sf_dir),
        attempts.task_logs(t.spark, t.sf_dir),
    )
    return merged.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_date", "end_date")})


def _attempts(t):
    task_logs = attempts.task_logs(t.spark, t.sf_dir)
    merged = logs.merge_attempts(
        attempts.task_history(t.spark, t.sf_dir), attempts.task_current(t.spark, t.sf_dir), task_logs
    )
    return logs.with_error_counts(merged, logs.extract_sql_errors(task_logs))


@case("attempt_kpis", f"""
    WITH {_ATTEMPTS}
    SELECT dag_id, COUNT(*) AS attempts, {cnt("state = 'success'")} AS success, {cnt("state = 'failed'")} AS failed,
           {cnt('errors > 0')} AS with_sql_error FROM m GROUP BY dag_id""")
def _(t):
    return logs.attempt_kpis(_attempts(t), "dag_id")


@case("attempt_kpis_syntax", f"""
    WITH {_ATTEMPTS}
    SELECT COUNT(*) AS attempts, {cnt("state = 'success'")} AS success, {cnt("state = 'failed'")} AS failed,
           {cnt('errors > 0')} AS with_sql_error FROM m WHERE dag_id = 'dag_1' AND kind IN (1, 5)""")
def _(t):
    return logs.attempt_kpis(logs.filter_attempts(_attempts(t), dag="dag_1", kind="syntax", text="parse_syntax"))


@case("attempt_search", f"""
    WITH {_LOG.strip()} SELECT {_KEYS} FROM a WHERE kind = 3 AND CAST(o AS VARCHAR) LIKE '1%'""")
def _(t):
    """A text of the error messages, over the table of grams."""
    path = scratch_path(t.spark, "grams")
    with shuffles_released(t.spark):
        _attempts(t).write.parquet(f"{path}/attempts")
    counted = t.spark.read.parquet(f"{path}/attempts")
    logs.write_search(counted.filter("sql_errors > 0"), f"{path}/grams")
    return logs.find_attempts(counted, t.spark.read.parquet(f"{path}/grams"), "Zero in task 1").select(*logs.RUN_KEYS)
