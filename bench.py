"""Headline queries on local Spark; prints one JSON line.

The fact table, the product aggregate, the ranking and the categories are built
once and written, as the benchmark set reads tables. Every query is warmed up,
then timed; the best run counts. Results go to the ``noop`` sink, so all rows are
produced. A query whose number of rows is wrong is reported as null.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.operators import (  # noqa: E402
    benchset, bitmap, cleaning, daily, dims, insight, reconcile, reports, scd2, skew,
)
from tidemark.operators import logs  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.sources import attempts  # noqa: E402
from tidemark.sources.clickstream import clickstream, skewed_sales  # noqa: E402
from tidemark.sources.warehouse import Warehouse  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
START, END, DAY = "2024-01-01", "2024-01-30", "2024-01-05"
REPEAT = 2


def session() -> SparkSession:
    """The shipped settings, with as many shuffle partitions as cores."""
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": CPUS,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(make) -> float:
    best = None
    for run in range(REPEAT + 1):
        t = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t
        if run:  # the first run warms up
            best = took if best is None else min(best, took)
    return best


def main() -> None:
    spark = session()
    t = time.perf_counter()
    spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    start_up = time.perf_counter() - t  # classes, code generation, first scan
    t0 = time.perf_counter()
    wh = Warehouse(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/warehouse")
    wh.write_partitions("ods_event_log", clickstream(spark, SF_DIR))
    ingest = time.perf_counter() - t0
    t = time.perf_counter()
    wh.write_partitions("dwd_event_fact", cleaning.build_fact(wh.read("ods_event_log")))
    build_fact = time.perf_counter() - t
    wh.write_partitions("dws_product_daily", daily.product_daily(wh.read("dwd_event_fact")))
    wh.write_partitions("dws_user_behavior_daily", daily.user_behavior_daily(wh.read("dwd_event_fact")))
    wh.write_partitions("ads_product_hot_rank_daily", reports.hot_rank_daily(wh.read("dws_product_daily")))
    wh.write_partitions("dwd_user_uv_bitmap", bitmap.build_uv_bitmap(wh.read("dws_user_behavior_daily")))
    wh.write_partitions("dws_user_session_daily", daily.user_session_daily(wh.read("dwd_event_fact")))
    wh.write_partitions("dws_traffic_hour_daily", daily.traffic_hour_daily(wh.read("dwd_event_fact")))
    wh.overwrite("dim_user", dims.user_dim(wh.read("dwd_event_fact")))
    wh.overwrite("dim_category", dims.category_dim(wh.read("dwd_event_fact")))
    wh.overwrite("dim_product_scd2", scd2.scd2_build(wh.read("dwd_event_fact"), START, END))

    ods, fact, pd, ub = (
        wh.read(n) for n in ("ods_event_log", "dwd_event_fact", "dws_product_daily", "dws_user_behavior_daily")
    )
    hot, cat, bm, versions = (
        wh.read(n) for n in ("ads_product_hot_rank_daily", "dim_category", "dwd_user_uv_bitmap", "dim_product_scd2")
    )
    sales = skewed_sales(spark, SF_DIR)
    hot_rows = hot.filter(f"event_date = DATE '{DAY}'").count()
    queries = {
        "q1_sum_price": (lambda: benchset.q1_sum_price(fact), 1),
        "q1m_count": (lambda: benchset.q1m_count(fact), 1),
        "q2_one_day": (lambda: benchset.q2_one_day(fact, DAY), 1),
        "q3_group_type": (lambda: benchset.q3_group_type(fact), 4),
        "q4_day_gmv": (lambda: benchset.q4_day_gmv(fact), 30),
        "q5_uv": (lambda: benchset.q5_uv(fact), 1),
        "q6_group_product": (lambda: benchset.q6_group_product(fact), 100),
        "q7_funnel_day": (lambda: benchset.q7_funnel_day(fact, DAY), 1),
        "q8_rank_category": (lambda: benchset.q8_rank_category(hot, cat, DAY), hot_rows),
        "q9_buyers": (lambda: benchset.q9_buyers(fact), None),
        "q10_topn_window": (lambda: benchset.q10_topn_window(pd), None),
        "uv_total_bitmap": (lambda: bitmap.uv_total(bm), 1),
        "uv_daily_bitmap": (lambda: bitmap.uv_daily(bm), 30),
        "build_fact": (lambda: cleaning.build_fact(ods), None),
        "dws_user_session": (lambda: daily.user_session_daily(fact), None),
        "dws_product": (lambda: daily.product_daily(fact), None),
        "dws_user_behavior": (lambda: daily.user_behavior_daily(fact), None),
        "dws_traffic_hour": (lambda: daily.traffic_hour_daily(fact), 720),
        "ads_trade": (lambda: reports.trade_daily(ub), 30),
        "ads_funnel": (lambda: reports.funnel_daily(fact), 30),
        "ads_hot_rank": (lambda: reports.hot_rank_daily(pd), None),
        "ads_retention": (lambda: reports.retention_daily(ub, START, END), 30),
        "ads_rfm": (lambda: reports.rfm(fact, START, END, 7), None),
        "scd2_dominant": (lambda: scd2.dominant_attrs(fact), None),
        "scd2_asof": (lambda: scd2.scd2_asof(versions, pd), None),
        "strict_funnel_24h": (lambda: insight.strict_funnel(fact, 24), 1),
        "hour_coverage": (lambda: reconcile.hour_coverage(fact), 120),
        "ads_overview": (lambda: reports.daily_overview(
            fact, ub, wh.read("dws_user_session_daily"), wh.read("dws_traffic_hour_daily"), wh.read("dim_user"), bitmap.uv_daily(bm)), 30),
        "sql_errors": (lambda: logs.extract_sql_errors(attempts.task_logs(spark, SF_DIR)), None),
        "agg_naive": (lambda: skew.agg_naive(sales), None),
        "agg_salted_all": (lambda: skew.agg_salted(sales), None),
        "agg_salted_hot": (lambda: skew.agg_salted_hot(sales), None),
        "agg_rebalance": (lambda: skew.agg_rebalance(sales), None),
    }
    times = {}
    for name, (make, rows) in queries.items():
        if rows is not None and make().count() != rows:
            times[name] = None
            continue
        times[name] = round(timed(make), 4)
    times["write_ods"] = round(ingest, 3)
    times["write_fact"] = round(build_fact, 3)
    total = round(sum(v for v in times.values() if v), 3)
    facts = fact.count()
    rates = {n: round(facts / v) for n, v in times.items() if v and n.startswith("q")}
    print(json.dumps({
        "metric": "clickstream_query_set_total", "value": total, "unit": "sec", "queries": times,
        "start_up": round(start_up, 3), "facts": facts, "facts_per_second": rates,
        "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
