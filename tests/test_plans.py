"""What the physical plans must and must not contain."""

import re

import pytest

from tests.sample import FIRST, frame, sample_events
from tidemark.operators import benchset, bitmap, cleaning, daily, reports, scd2
from tidemark.sources.warehouse import Warehouse


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    wh = Warehouse(spark, str(tmp_path_factory.mktemp("plans")))
    fact = cleaning.build_fact(frame(spark, sample_events()))
    wh.write_partitions("dwd_event_fact", fact)
    wh.write_partitions("dws_product_daily", daily.product_daily(fact))
    wh.write_partitions("dws_user_behavior_daily", daily.user_behavior_daily(fact))
    return wh


def test_one_day_prunes_partitions(stored):
    for df in (benchset.q2_one_day(stored.read("dwd_event_fact"), FIRST), benchset.q7_funnel_day(stored.read("dwd_event_fact"), FIRST)):
        text = plan(df)
        assert re.search(r"PartitionFilters: \[[^\]]*event_date", text)
    ranged = daily.user_session_daily(stored.read("dwd_event_fact", FIRST, "2019-10-03"))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date[^\]]*>=", plan(ranged))


def test_only_needed_columns_are_read(stored):
    text = plan(benchset.q4_day_gmv(stored.read("dwd_event_fact")))
    assert "ReadSchema: struct<price:double>" in text
    buyers = plan(benchset.q9_buyers(stored.read("dwd_event_fact")))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in buyers


def test_duplicates_and_ranks_are_limited_before_the_shuffle(spark, stored):
    for df in (
        cleaning.dedup_events(cleaning.clean_events(frame(spark, sample_events()))),
        reports.hot_rank_daily(stored.read("dws_product_daily")),
        benchset.q10_topn_window(stored.read("dws_product_daily")),
    ):
        text = plan(df)
        assert text.index("Final") < text.index("Exchange") < text.index("Partial"), text


def test_daily_aggregates_use_no_expand_and_no_single_task(stored):
    fact = stored.read("dwd_event_fact")
    for df in (
        daily.product_daily(fact), daily.user_behavior_daily(fact), daily.traffic_hour_daily(fact),
        daily.type_users_daily(fact), reports.funnel_daily(fact),
        reports.retention_daily(stored.read("dws_user_behavior_daily"), FIRST, "2019-10-08"),
    ):
        text = plan(df)
        assert "Expand" not in text and "SinglePartition" not in text


def test_rfm_computes_the_buyers_once(stored):
    df = reports.rfm(stored.read("dwd_event_fact"), FIRST, "2019-10-08")
    text = final_plan(df)
    assert "ReusedExchange" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_product_history_shuffles_by_product_once(stored):
    text = plan(scd2.version_runs(scd2.dominant_attrs(stored.read("dwd_event_fact"))))
    assert len(re.findall("Exchange hashpartitioning", text)) == 2  # the count, and the placement by product
    assert "SinglePartition" not in text


def test_bitmaps_are_built_from_distinct_users(stored):
    text = plan(bitmap.build_uv_bitmap(stored.read("dwd_event_fact")))
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_no_python_and_no_nested_loops_in_composed_plans(spark):
    import __spark_entry__ as entry

    for name in ("ads_overview", "ads_rfm_dws", "overview_reconcile", "row_count_expectations", "uv_bitmap_vs_distinct",
                 "skew_equivalence", "window_kpis", "strict_funnel_24h", "attempt_kpis", "dqc_dwd", "scd2_asof"):
        text = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert not re.search("PythonUDF|EvalPython|MapInPandas|BroadcastNestedLoopJoin|CartesianProduct", text), name
