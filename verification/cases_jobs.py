"""Sources, sinks, table maintenance and jobs: each writes to a fresh scratch folder and returns what it reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import between_days
from tidemark.operators import daily, dims, reconcile, reports
from tidemark.plans import handoff, jobs
from tidemark.schemas import EVENT_TIME_FORMAT, TABLES
from tidemark.session import scratch_path
from tidemark.sources import events, export
from tidemark.sources.warehouse import Warehouse

from . import digest
from .cases_core import _MERGE_SQL, _RAW, RAW_COLUMNS
from .registry import case
from .tables import BEFORE_MERGE, DAY, END, FIRST_HALF, MERGE_DAY, RECENCY, SECOND_HALF, START, Tables, days_of_range

_PER_DAY = "SELECT event_date, COUNT(*) AS cnt FROM {} GROUP BY event_date"


def _per_day(df: DataFrame) -> DataFrame:
    return df.groupBy("event_date").agg(F.count("*").alias("cnt"))


def _csv_source(t: Tables) -> DataFrame:
    """The clickstream written as CSV with zone-bearing times, and read back."""
    path = scratch_path(t.spark, "csv")
    t.raw.drop("event_date").write.csv(path, header=True, timestampFormat=EVENT_TIME_FORMAT)
    return events.read_events_csv(t.spark, path)


# --- sources -------------------------------------------------------------------


@case("src_events_csv", f"""
    SELECT CAST(FLOOR(epoch(event_time)) AS BIGINT) AS event_sec, {_RAW.replace('event_date, ', '')} FROM src""")
def _(t):
    return _csv_source(t).select(F.unix_timestamp("event_time").alias("event_sec"), *RAW_COLUMNS[1:])


@case("ods_ingest_day", f"""
    SELECT event_date, COUNT(*) AS cnt, CAST(0 AS BIGINT) AS rows_of_second_load FROM tagged
    WHERE event_date = DATE '{DAY}' GROUP BY event_date""")
def _(t):
    wh, source = t.warehouse("ingest-day"), _csv_source(t)
    events.ingest_day(wh, source, DAY)
    again = events.ingest_day(wh, source, DAY)
    return _per_day(wh.read(events.RAW)).withColumn("rows_of_second_load", F.lit(again.rows).cast("bigint"))


@case("ods_ingest_bulk", """
    SELECT event_date, COUNT(*) AS cnt, (SELECT COUNT(*) FROM tagged) AS reported_rows,
           (SELECT COUNT(DISTINCT event_date) FROM tagged) AS reported_days FROM tagged GROUP BY event_date""")
def _(t):
    wh = t.warehouse("ingest-bulk")
    done = events.ingest_bulk(wh, _csv_source(t))
    return _per_day(wh.read(events.RAW)).withColumns({
        "reported_rows": F.lit(done.rows).cast("bigint"),
        "reported_days": F.lit(len(done.partitions)).cast("bigint"),
    })


# --- sinks ---------------------------------------------------------------------


@case("write_partition", digest.of_sql("dwd_event_fact", """(SELECT *, CASE event_type WHEN 'view' THEN 'view' WHEN 'cart' THEN 'add to cart'
    WHEN 'remove_from_cart' THEN 'remove from cart' WHEN 'purchase' THEN 'purchase' END AS behavior_type FROM fact)""")
    + f" WHERE event_date <> DATE '{DAY}' OR is_purchase = 1")
def _(t):
    wh = t.warehouse("partitions")
    fact = t.fact
    wh.write_partitions(jobs.FACT, fact)
    # one day again, with fewer rows: the other days must stay
    wh.write_partitions(jobs.FACT, fact.filter((F.col("event_date") == DAY) & (F.col("is_purchase") == 1)))
    return digest.of_frame(jobs.FACT, wh.read(jobs.FACT))


@case("skip_existing", f"""
    SELECT DISTINCT event_date FROM ub WHERE event_date > DATE '{FIRST_HALF[1]}'""")
def _(t):
    wh = t.warehouse("resume")
    wh.write_partitions(jobs.USER, t.ub.filter(between_days(*FIRST_HALF)))
    todo = wh.missing_days(jobs.USER, START, END)
    wh.write_partitions(jobs.USER, t.ub.filter(F.col("event_date").isin(todo)))
    assert wh.missing_days(jobs.USER, START, END) == []
    return wh.read(jobs.USER).filter(F.col("event_date").isin(todo)).select("event_date").distinct()


@case("append_new", f"""
    SELECT user_session, epoch_us(MIN(event_time)) AS session_start_us, epoch_us(MAX(event_time)) AS session_end_us
    FROM fact f WHERE user_session IS NOT NULL AND event_date <= DATE '{BEFORE_MERGE}' GROUP BY user_session
    UNION ALL
    SELECT user_session, epoch_us(MIN(event_time)), epoch_us(MAX(event_time))
    FROM fact WHERE user_session IS NOT NULL AND event_date = DATE '{MERGE_DAY}' AND user_session NOT IN (
        SELECT user_session FROM fact WHERE user_session IS NOT NULL AND event_date <= DATE '{BEFORE_MERGE}')
    GROUP BY user_session""")
def _(t):
    wh = t.warehouse("append")
    wh.overwrite("dim_session", dims.session_dim(t.fact_before(MERGE_DAY)))
    for _again in range(2):  # the second append finds nothing new
        wh.append_new("dim_session", dims.new_sessions(wh.read("dim_session"), t.fact, MERGE_DAY))
    return wh.read("dim_session").select(
        "user_session", F.unix_micros("session_start_time").alias("session_start_us"),
        F.unix_micros("session_end_time").alias("session_end_us"),
    )


@case("rewrite_self", f"""
    SELECT user_id, MIN(event_date) AS first_seen_date, MAX(event_date) AS last_seen_date,
           COUNT(DISTINCT event_date) AS active_days,
           MIN(CASE WHEN is_purchase = 1 THEN event_date END) AS first_purchase_date,
           COUNT(DISTINCT CASE WHEN is_purchase = 1 THEN event_date END) AS purchase_days
    FROM fact WHERE event_date <= DATE '{MERGE_DAY}' GROUP BY user_id""")
def _(t):
    wh = t.warehouse("rewrite")
    wh.overwrite("dim_user", dims.user_dim(t.fact_before(MERGE_DAY)))
    for _again in range(2):
        wh.rewrite("dim_user", lambda dim: dims.merge_user_dim(dim, t.fact, MERGE_DAY))
    return wh.read("dim_user")


@case("replace_snapshot", "SELECT as_of_dt, COUNT(*) AS users, CAST(SUM(f_cnt) AS BIGINT) AS purchases FROM rfm GROUP BY as_of_dt")
def _(t):
    wh = t.warehouse("snapshot")
    wh.replace_snapshot(jobs.RFM, reports.rfm(t.fact, START, FIRST_HALF[1], RECENCY))
    wh.replace_snapshot(jobs.RFM, t.rfm)
    return wh.read(jobs.RFM).groupBy("as_of_dt").agg(
        F.count("*").alias("users"), F.sum("f_cnt").alias("purchases")
    )


# --- catalog --------------------------------------------------------------------


def _registered(t: Tables, label: str):
    """A warehouse registered under its own database names."""
    wh = t.warehouse(label)
    wh.prefix = "t" + wh.root.rsplit("-", 1)[1][:12] + "_"
    return wh


@case("create_tables", "SELECT * FROM du")
def _(t):
    wh = _registered(t, "catalog")
    wh.overwrite("dim_user", t.user_dim)
    names = wh.create_tables()
    assert len(names) == len(TABLES) and len(wh.create_tables(drop=["dim_user"])) == len(TABLES)
    return t.spark.table(wh.full_name("dim_user"))


@case("recover_partitions", f"{_PER_DAY.format('pd')}")
def _(t):
    wh = _registered(t, "recover")
    wh.create_tables()
    wh.write_partitions(jobs.PRODUCT, t.pd)
    assert jobs.PRODUCT in wh.recover_partitions()
    return _per_day(t.spark.table(wh.full_name(jobs.PRODUCT)))


# --- exports ----------------------------------------------------------------------

def _exported(t: Tables):
    """Every exportable table that a range build fills."""
    wh = _built(t)
    out = scratch_path(t.spark, "export")
    return wh, out, export.export_csv(wh, out, [n for n in export.EXPORTABLE if n in _BUILT_TABLES])


_BUILT_TABLES = {
    "ods_event_log": "src", "dwd_event_fact": "fact", "dwd_event_dirty": "dirty", "dim_product_scd2": "scd",
    "dim_user": "du", "dim_category": "dc", "dim_session": "ds", "dws_user_session_daily": "us",
    "dws_product_daily": "pd", "dws_user_behavior_daily": "ub", "dws_traffic_hour_daily": "th",
    "ads_trade_daily": "trade", "ads_conversion_funnel_daily": "funnel", "ads_product_hot_rank_daily": "hot",
    "ads_session_behavior_daily": "sess", "ads_traffic_hour_daily": "hour", "ads_user_retention_daily": "ret",
    "ads_user_rfm_snapshot": "rfm", "ads_ec_daily_overview": "ov",
}
_LABELLED = """(SELECT *, CASE event_type WHEN 'view' THEN 'view' WHEN 'cart' THEN 'add to cart' WHEN 'remove_from_cart' THEN 'remove from cart'
    WHEN 'purchase' THEN 'purchase' END AS behavior_type FROM fact)"""
#: the jobs count 30 days as recent, the report queries fewer
_SNAPSHOT = """(SELECT user_id, r_days, f_cnt, m_amount, CASE m_good WHEN 1 THEN 'key ' ELSE 'general ' END
    || CASE WHEN f_good = 1 AND r_days <= 30 THEN 'value' WHEN f_good = 1 THEN 'keep' WHEN r_days <= 30 THEN 'develop' ELSE 'win-back' END AS rfm_seg,
    as_of_dt FROM (SELECT s.*, r.as_of_dt FROM scored s JOIN rfm r USING (user_id)))"""
_VALUES = _BUILT_TABLES | {"ods_event_log": "tagged", "dwd_event_fact": _LABELLED, "ads_user_rfm_snapshot": _SNAPSHOT}
#: a day that is added: sessions known before are not extended, history is merged
_VALUES_BY_DAY = _VALUES | {
    "dim_session": f"""(
        SELECT user_session, MAX(user_id) AS user_id, MIN(event_time) AS session_start_time, MAX(event_time) AS session_end_time
        FROM fact WHERE user_session IS NOT NULL AND event_date <= DATE '{BEFORE_MERGE}' GROUP BY user_session
        UNION ALL SELECT user_session, MAX(user_id), MIN(event_time), MAX(event_time)
        FROM fact WHERE event_date = DATE '{MERGE_DAY}' AND user_session NOT IN (
            SELECT user_session FROM fact WHERE user_session IS NOT NULL AND event_date <= DATE '{BEFORE_MERGE}') GROUP BY user_session)""",
    "dim_product_scd2": f"({_MERGE_SQL})",
}


def _values(wh, names) -> DataFrame:
    return reduce(DataFrame.unionByName, [digest.of_frame(n, wh.read(n)) for n in names])


def _values_sql(relations: dict[str, str]) -> str:
    return " UNION ALL ".join(digest.of_sql(n, c) for n, c in relations.items())


_EXPORT_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS row_cnt FROM {c}" for n, c in _BUILT_TABLES.items() if n in export.EXPORTABLE)


@case("export_csv_manifest", f"""
    SELECT *, CASE WHEN table_name = 'ads_user_rfm_snapshot' THEN 'as_of_dt' WHEN table_name NOT LIKE 'dim%' THEN 'event_date' END
        AS partition_col FROM ({_EXPORT_ROWS})""")
def _(t):
    return _exported(t)[2].select("table_name", "row_cnt", "partition_col")


@case("export_reconcile", f"""
    SELECT *, 1 AS columns_equal, 1 AS values_equal, row_cnt AS loaded_rows, CAST(0 AS BIGINT) AS rejected_rows, 1 AS ok
    FROM ({_EXPORT_ROWS})""")
def _(t):
    wh, out, _manifest = _exported(t)
    return export.verify_export(wh, out)


@case("export_lost_column", f"""
    SELECT 'ads_trade_daily' AS table_name, COUNT(*) AS row_cnt, COUNT(*) AS loaded_rows, COUNT(*) AS rejected_rows,
           0 AS columns_equal, 0 AS values_equal, 0 AS ok FROM trade""")
def _(t):
    wh = t.warehouse("lost-column")
    wh.write_partitions(jobs.TRADE, t.trade)
    out = scratch_path(t.spark, "export")
    export.export_csv(wh, out, [jobs.TRADE])
    short = wh.read(jobs.TRADE).select(*wh.spec(jobs.TRADE).column_names[:-1])
    short.write.mode("overwrite").options(**export.CSV_OPTIONS).csv(f"{out}/{jobs.TRADE}")
    return export.verify_export(wh, out)


_REPORT_CTES = {"ads_trade_daily": "trade", "ads_conversion_funnel_daily": "funnel", "ads_product_hot_rank_daily": "hot",
                "ads_session_behavior_daily": "sess", "ads_user_rfm_snapshot": "rfm", "dim_category": "dc"}


@case("export_reports", _values_sql(_REPORT_CTES))
def _(t):
    wh = t.warehouse("reports")
    for name, df in (("ads_trade_daily", t.trade), ("ads_conversion_funnel_daily", t.funnel), ("ads_product_hot_rank_daily", t.hot),
                     ("ads_session_behavior_daily", t.session_report)):
        wh.write_partitions(name, df)
    # an older snapshot beside the newest one: only the newest is exported
    wh.write_partitions(jobs.RFM, reports.rfm(t.fact, START, FIRST_HALF[1], RECENCY).unionByName(t.rfm))
    wh.overwrite("dim_category", dims.category_dim(t.fact))
    out = scratch_path(t.spark, "report-files")
    paths = export.export_reports(wh, out)
    parts = [
        digest.of_frame(n, t.spark.read.schema(wh.spec(n).schema).csv(path, header=True, enforceSchema=False))
        for n, path in zip(export.REPORTS, paths)
    ]
    return reduce(DataFrame.unionByName, parts)


@case("stage_handoff", """
    SELECT 'customer-' || o_custkey AS customer, ROUND(SUM(o_totalprice), 2) AS total_amount FROM orders GROUP BY o_custkey""")
def _(t):
    orders = t.parquet("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("customer"),
        F.col("o_totalprice").alias("amount"),
    )
    extracted, transformed = scratch_path(t.spark, "extract"), scratch_path(t.spark, "transform")
    handoff.extract(orders, extracted)
    handoff.transform(t.spark, extracted, transformed)
    return handoff.load(t.spark, transformed).withColumn("total_amount", F.round("total_amount", 2))


# --- jobs ---------------------------------------------------------------------------

#: exact tables, and those of sketches, of which a rerun may hold other bytes
_EXACT = [n for n in TABLES if n != jobs.SKETCH]


@case("rerun_fingerprint", f"""
    SELECT table_name, parts, row_cnt, CAST(0 AS BIGINT) AS changed FROM (
    {" UNION ALL ".join(f"SELECT '{n}' AS table_name, " + (f"COUNT(DISTINCT coalesce(CAST({TABLES[n].partition} AS VARCHAR), 'none'))" if TABLES[n].partition else
                        "CAST(1 AS BIGINT)") + f" AS parts, COUNT(*) AS row_cnt FROM {c}" for n, c in _VALUES.items())}
    UNION ALL SELECT 'dwd_user_uv_bitmap', COUNT(DISTINCT event_date), COUNT(*) FROM (SELECT DISTINCT event_date, CAST(FLOOR((user_id - 1) / 32768) AS BIGINT) FROM fact)
    UNION ALL SELECT 'dim_date', 1, SUM(CASE WHEN y % 4 = 0 THEN 366 ELSE 365 END)::BIGINT FROM (SELECT DISTINCT year(event_date) AS y FROM fact))""")
def _(t):
    """All tables built twice; the digests kept at write time are compared partition by partition."""
    wh = Warehouse(t.spark, scratch_path(t.spark, "rerun"), digests=True)
    events.ingest_bulk(wh, t.raw)
    jobs.build_range(wh, START, END, on_block="continue")
    kept = scratch_path(t.spark, "digests")
    wh.digests().write.parquet(kept)
    # the second run meets its rows in another order and partitioning
    events.ingest_bulk(wh, t.raw.repartition(5, "price"))
    jobs.build_range(wh, START, END, on_block="continue")
    changes = reconcile.digest_changes(t.spark.read.parquet(kept), wh.digests()).filter(F.col("table_name").isin(_EXACT))
    return changes.groupBy("table_name").agg(
        F.count("*").alias("parts"), F.sum("row_cnt").alias("row_cnt"), F.count_if(F.col("status") != "same").alias("changed"))


_BUILT: dict[tuple[str, str], object] = {}


def _built(t: Tables):
    """The whole warehouse, built once per application and data set and then read by several queries."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _BUILT:
        wh = t.warehouse("built")
        events.ingest_bulk(wh, t.raw)
        jobs.build_range(wh, START, END, on_block="continue")
        _BUILT[key] = wh
    return _BUILT[key]


@case("build_range", _values_sql(_VALUES))
def _(t):
    return _values(_built(t), _VALUES)


@case("check_only", """
    SELECT 'purchase_conservation' AS "check", 1 AS ok UNION ALL SELECT 'gmv_conservation', 1
    UNION ALL SELECT 'funnel', CASE WHEN COUNT(*) FILTER (WHERE view_uv < cart_uv OR view_uv < purchase_uv) = 0
                                    THEN 1 ELSE 0 END FROM funnel
    UNION ALL SELECT 'scd2_current', 1 UNION ALL SELECT 'hour_conservation', 1 UNION ALL SELECT 'retention', 1
    UNION ALL SELECT 'fact_present', 1""")
def _(t):
    return jobs.check(_built(t), START, END).select("check", "ok")


@case("dim_date_ensure", """
    SELECT CAST(SUM(CASE WHEN year(DATE '2024-12-31') = 2024 THEN 366 END) AS BIGINT) AS days,
           CAST(0 AS BIGINT) AS rows_of_second_build, MIN(d) AS first_day
    FROM (SELECT date_trunc('year', MIN(ts))::DATE AS d FROM events)""")
def _(t):
    wh = t.warehouse("date")
    first, last = t.parquet("events").agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    jobs.ensure_date_dim(wh, first, last)
    again = jobs.ensure_date_dim(wh, first, last)
    return wh.read("dim_date").agg(F.count("*").alias("days"), F.min("date_id").alias("first_day")).withColumn(
        "rows_of_second_build", F.lit(again.rows).cast("bigint")
    )


@case("build_day", _values_sql(_VALUES_BY_DAY))
def _(t):
    """All steps, the last day added to the days before: every table ends as the range build leaves it, but for what a merge keeps."""
    wh = t.warehouse("day")
    events.ingest_bulk(wh, t.raw)
    jobs.build_range(wh, START, BEFORE_MERGE, force=True, on_block="continue")
    jobs.build_day(wh, MERGE_DAY, START, on_block="continue")
    return _values(wh, _VALUES_BY_DAY)


_BACKFILL_SQL = f"""
    WITH m AS (SELECT event_date, COUNT(*) AS n, day(event_date) % 2 = 1 AS mended,
                      COUNT(*) - COUNT(user_id) AS u, COUNT(*) - COUNT(user_session) AS s, COUNT(*) - COUNT(price) AS p
               FROM tagged GROUP BY event_date),
    j AS (SELECT *, median(n) OVER (ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base FROM m),
    b AS (SELECT event_date, CASE WHEN n < 0.5 * base THEN ['row_count_drop'] ELSE [] END
                 || CASE WHEN NOT mended AND u / n > 0.001 THEN ['null_user_id'] ELSE [] END
                 || CASE WHEN NOT mended AND s / n > 0.001 THEN ['null_user_session'] ELSE [] END
                 || CASE WHEN NOT mended AND p / n >= 0.01 THEN ['price_invalid'] ELSE [] END AS codes,
                 event_date BETWEEN DATE '{SECOND_HALF[0]}' AND DATE '{END}' AS wanted FROM j)
    SELECT event_date, CASE WHEN NOT wanted THEN 'existing' WHEN len(codes) > 0 THEN 'failed' ELSE 'loaded' END AS status,
           CASE WHEN wanted THEN array_to_string(codes, ',') ELSE '' END AS codes FROM b"""


@case("backfill_range", _BACKFILL_SQL)
def _(t):
    wh = t.warehouse("backfill")
    # NULLs are mended on odd days only, so that some days pass the gate and others fail
    odd = F.dayofmonth("event_date") % 2 == 1
    mended = t.raw.withColumns({
        "user_id": F.when(odd, F.coalesce("user_id", F.lit(0))).otherwise(F.col("user_id")),
        "user_session": F.when(odd, F.coalesce("user_session", F.lit("none"))).otherwise(F.col("user_session")),
        "price": F.when(odd, F.coalesce("price", F.lit(0.0))).otherwise(F.col("price")),
    })
    events.ingest_bulk(wh, mended.filter(between_days(*FIRST_HALF)).drop("event_date"))
    report = jobs.backfill(wh, mended.drop("event_date"), START, END)
    loaded = {r.event_date for r in report.filter(F.col("status") != "failed").collect()}
    assert set(wh.missing_days(events.RAW, START, END)) == set(days_of_range()) - loaded
    return report
