from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.sample import FIRST, LAST, event, frame, sample_events
from tidemark.operators import bitmap, cleaning, daily, quality, reconcile, reports


def dated(spark, rows):
    return cleaning.with_event_date(frame(spark, rows))


def clicks(day, n, **change):
    base = datetime(2019, 10, 1) + timedelta(days=day)
    rows = []
    for i in range(n):
        r = dict(event_time=base + timedelta(seconds=i), event_type="view", product_id=1, category_id=1,
                 category_code="c", brand="b", price=1.0, user_id=i, user_session="s")
        r.update(change)
        rows.append(tuple(r.values()))
    return rows


def statuses(gate):
    return {(str(r.event_date)[-2:], r.code): r.status for r in gate.collect()}


def test_source_gate_empty_day_and_null_rates(spark):
    rows = clicks(0, 2000) + clicks(1, 1999) + clicks(1, 1, user_id=None) + clicks(2, 10) + clicks(2, 1, user_session=None)
    got = statuses(quality.ods_gate(dated(spark, rows), FIRST, "2019-10-04"))
    assert got["01", "null_user_id"] == "PASS"
    assert got["02", "null_user_id"] == "WARN"      # one in two thousand
    assert got["03", "null_user_session"] == "BLOCK"
    assert got["04", "empty_partition"] == "BLOCK"
    assert ("04", "null_user_id") not in got        # an empty day has no rates


def test_price_gate(spark):
    rows = clicks(0, 99) + clicks(0, 1, price=float("nan"))
    rows += clicks(1, 200) + clicks(1, 1, price=float("inf"))
    rows += clicks(2, 1, price=None)
    got = statuses(quality.price_gate(dated(spark, rows), FIRST, "2019-10-03"))
    assert [got[d, "price_invalid"] for d in ("01", "02", "03")] == ["BLOCK", "PASS", "BLOCK"]


def test_volume_uses_the_median_of_existing_days_and_only_a_fall_blocks(spark):
    sizes = {0: 100, 1: 100, 3: 1000, 4: 100, 5: 151, 6: 49, 7: 50}
    rows = [r for d, n in sizes.items() for r in clicks(d, n)]
    got = statuses(quality.volume_gate(dated(spark, rows), FIRST, LAST))
    want = {"01": "PASS", "02": "PASS", "04": "WARN", "05": "PASS", "06": "WARN", "07": "BLOCK", "08": "PASS"}
    assert {d: s for (d, _), s in got.items()} == want


def test_fact_gate_finds_each_defect(spark):
    fact = cleaning.build_fact(frame(spark, sample_events()))
    ods = dated(spark, sample_events())
    dirty = cleaning.dirty_events(ods)

    def blocked(df, o=ods):
        gate = quality.dwd_gate(o, df, dirty, FIRST, FIRST)
        return {r.code for r in gate.filter("status = 'BLOCK'").collect()}

    assert blocked(fact) == set()
    day1 = fact.filter(F.col("event_date") == FIRST)
    assert blocked(fact.unionByName(day1)) == {"dup_key", "count_overflow"}
    assert blocked(fact.withColumn("event_type", F.lit("odd"))) >= {"bad_event_type"}
    assert blocked(fact.withColumn("price", F.lit(-1.0))) == {"negative_price"}
    assert blocked(fact.withColumn("user_id", F.lit(None).cast("bigint"))) >= {"null_core_field"}
    shifted = fact.withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 20 HOURS"))
    assert blocked(shifted) == {"timezone_offset"}
    assert blocked(fact.filter("false")) == {"empty_partition"}
    with pytest.raises(quality.QualityBlock, match="empty_partition"):
        quality.raise_on_block(quality.dwd_gate(ods, fact.filter("false"), dirty, FIRST, FIRST))


def test_gmv_gate(spark):
    def judged(today, history=(100.0,) * 7):
        rows = [(datetime(2019, 10, 1 + i).date(), g) for i, g in enumerate([*history, today])]
        day = str(rows[-1][0])
        return quality.gmv_gate(spark.createDataFrame(rows, "event_date date, gmv double"), day, day).first()

    assert judged(100.0).status == "PASS"
    assert judged(131.0).status == "WARN" and judged(1000.0).status == "WARN"
    assert judged(69.0).status == "WARN"
    assert judged(49.0).status == "BLOCK"
    assert judged(None).status == "BLOCK"
    assert "skipped" in judged(1.0, (100.0,) * 6).detail
    assert judged(1.0, (0.0,) * 7).status == "PASS"


def test_reports_on_days_without_data(spark):
    fact = cleaning.build_fact(frame(spark, [event(0, 1, "view", 1, "a", 1)]))
    end = "2019-10-02"
    trade = reports.trade_daily(daily.user_behavior_daily(fact), FIRST, end).orderBy("event_date").collect()
    assert (trade[1].gmv, trade[1].order_cnt, trade[1].avg_order_value) == (None, None, 0.0)
    funnel = reports.funnel_daily(fact, FIRST, end).orderBy("event_date").collect()
    assert tuple(funnel[1])[1:] == (0, 0, 0, 0.0, 0.0, 0.0)
    session = reports.session_behavior_daily(daily.user_session_daily(fact), FIRST, end).orderBy("event_date").collect()
    assert (session[1].session_cnt, session[1].avg_duration_sec, session[1].cart_purchase_rate) == (0, None, 0.0)


def test_retention_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    seen = {(u, d) for u in range(12) for d in range(8) if rng.random() < 0.5 and d != 5}
    fact = cleaning.build_fact(frame(spark, [event(d, 1, "view", 1, "a", u) for u, d in seen]))
    got = {r.event_date.day - 1: r for r in
           reports.retention_daily(daily.user_behavior_daily(fact), FIRST, LAST).collect()}
    assert len(got) == 8
    for d in range(8):
        base = {u for u, x in seen if x == d}
        assert got[d].d0_uv == len(base)
        for n in (1, 3, 7):
            want = len({u for u in base if (u, d + n) in seen}) if d + n < 8 else None
            assert got[d][f"d{n}_uv"] == want
            rate = got[d][f"d{n}_rate"]
            assert rate == (round(want / len(base) * 100, 4) if want is not None and base else None)


def test_rfm_from_facts_equals_rfm_from_daily(spark):
    rows = [event(d, h, "purchase", p, "a", u, price=float(p * u)) for u in range(1, 9) for d in range(0, u) for h in (1, 2)
            for p in (1, 2)] + [event(0, 5, "view", 1, "a", 99)]
    fact = cleaning.build_fact(frame(spark, rows))
    a = reports.rfm(fact, FIRST, LAST, 3)
    b = reports.rfm_from_daily(daily.user_behavior_daily(fact), FIRST, LAST, 3)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 8


def test_peak_hours_share_the_flag(spark):
    rows = [event(0, h, "view", 1, "a", u) for h in (3, 9) for u in (1, 2)] + [event(0, 20, "view", 1, "a", 1)]
    report = reports.traffic_hour_report(daily.traffic_hour_daily(cleaning.build_fact(frame(spark, rows))))
    got = {r.event_hour: (r.is_peak_hour, r.time_bucket, r.order_share) for r in report.collect()}
    assert got[3][0] == got[9][0] == 1 and got[20][0] == 0
    assert got[3][2] is None  # no orders that day


def test_bitmap_counts_equal_sets_for_scattered_ids(spark):
    import random

    rng = random.Random(9)
    a = {rng.randrange(-10**6, 10**12) for _ in range(300)}
    b = set(list(a)[:120]) | {rng.randrange(10**12) for _ in range(200)}
    rows = [(datetime(2019, 10, 1).date(), u) for u in a] + [(datetime(2019, 10, 2).date(), u) for u in b]
    bm = bitmap.build_uv_bitmap(spark.createDataFrame(rows, "event_date date, user_id bigint"))
    pair = bitmap.bitmap_partition_check(bm, FIRST, "2019-10-02").first()
    assert tuple(pair) == (len(a), len(a & b), len(a - b), 1)
    assert bitmap.uv_total(bm).first().uv == len(a | b)
    trap = bitmap.uv_inflation(bm).first()
    assert (trap.sum_daily_uv, trap.uv) == (len(a) + len(b), len(a | b))
    assert tuple(bitmap.bitmap_partition_check(bm, "2020-01-01", "2020-01-02").first()) == (0, 0, 0, 1)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    a = reconcile.fingerprint(df).first()
    assert reconcile.fingerprint(df.orderBy(F.desc("id")).repartition(3)).first() == a
    assert reconcile.fingerprint(df.withColumn("v", F.when(F.col("id") == 3, 9).otherwise(F.col("v")))).first() != a
    assert reconcile.fingerprint(df.unionByName(df.limit(1))).first() != a


def test_conservation_reports_a_lost_purchase(spark):
    fact = cleaning.build_fact(frame(spark, sample_events()))
    ub, pd, us = daily.user_behavior_daily(fact), daily.product_daily(fact), daily.user_session_daily(fact)
    trade = reports.trade_daily(ub)
    good = reconcile.purchase_conservation(fact, ub, pd, us, trade, FIRST, LAST).first()
    assert good.ok == 1 and good.fact_cnt == 12
    lost = reconcile.purchase_conservation(fact, ub, pd.filter("product_id <> 1001"), us, trade, FIRST, LAST).first()
    assert (lost.ok, lost.product_cnt) == (0, 0)


def test_aggregating_a_union_of_equally_partitioned_frames(spark):
    """The gate prepares the session, as Spark 4.1 can otherwise leave the groups of such a union split."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    ods = dated(spark, sample_events())
    fact = cleaning.build_fact(frame(spark, sample_events()))
    doubled = fact.unionByName(fact.filter(F.col("event_date") == FIRST))
    gate = quality.dwd_gate(ods, doubled, cleaning.dirty_events(ods), FIRST, FIRST)
    assert {r.detail for r in gate.filter("code = 'dup_key'").collect()} == {"groups=5"}
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
