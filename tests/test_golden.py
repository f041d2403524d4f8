"""The eight-day sample through the real tables: source file, all layers, checks, rerun, next day."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.sample import FIRST, LAST, frame, sample_events
from tidemark.operators import quality, reconcile, reports, scd2
from tidemark.plans import jobs
from tidemark.schemas import EVENT_TIME_FORMAT, TABLES
from tidemark.sources import events
from tidemark.sources.warehouse import Warehouse


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("golden")
    csv = str(root / "csv")
    frame(spark, sample_events()).write.csv(csv, header=True, timestampFormat=EVENT_TIME_FORMAT)
    wh = Warehouse(spark, str(root / "warehouse"))
    done = events.ingest_bulk(wh, events.read_events_csv(spark, csv))
    assert done.rows == 37 and len(done.partitions) == 8
    jobs.build_range(wh, FIRST, LAST)
    return wh


def digests(wh):
    return {n: tuple(reconcile.fingerprint(wh.read(n)).first()) for n in TABLES}


def test_counts_and_money(built):
    assert built.read("ods_event_log").count() == 37
    assert built.read("dwd_event_fact").count() == 32
    assert built.read("dwd_event_dirty").count() == 3
    row = built.read("dwd_event_fact").agg(
        F.sum("is_purchase"), F.sum(F.when(F.col("is_purchase") == 1, F.col("price")))
    ).first()
    assert tuple(row) == (12, 120.0)


def test_checks_pass(built):
    assert [r["check"] for r in jobs.check(built, FIRST, LAST).filter("ok = 0").collect()] == []


def test_product_versions(built):
    rows = built.read("dim_product_scd2").filter("product_id = 1001").orderBy("dw_start_date").collect()
    assert [r.brand for r in rows] == ["alpha", "beta"]
    assert rows[0].dw_end_date == date(2019, 10, 5) and rows[0].dw_is_current == 0
    assert rows[1].dw_end_date == date(9999, 12, 31) and rows[1].dw_is_current == 1


def test_retention_is_censored_not_zero(built):
    ret = built.read("ads_user_retention_daily")
    first = ret.filter(F.col("event_date") == FIRST).first()
    assert (first.d0_uv, first.d1_uv, first.d7_uv) == (3, 2, 2)
    assert ret.filter("d7_uv IS NULL").count() == 7
    short = reports.retention_daily(built.read("dws_user_behavior_daily"), FIRST, "2019-10-03")
    assert short.filter(F.col("event_date") == FIRST).first().d7_uv is None


def test_rfm_snapshot(built):
    snap = built.read("ads_user_rfm_snapshot").collect()
    assert len(snap) == 2 and {r.as_of_dt for r in snap} == {LAST}


def test_rerun_is_identical(built):
    before = digests(built)
    jobs.build_range(built, FIRST, LAST)
    assert digests(built) == before


def test_merge_same_day_changes_nothing_and_backfill_is_refused(built):
    dim, fact = built.read("dim_product_scd2"), built.read("dwd_event_fact")
    merged = scd2.scd2_merge(dim, fact, LAST)
    assert reconcile.fingerprint(merged).first() == reconcile.fingerprint(dim).first()
    with pytest.raises(ValueError, match="day_before_newest_version"):
        scd2.ensure_mergeable(dim, FIRST)


def test_missing_source_day_stops_the_build(built):
    with pytest.raises(ValueError, match="2019-10-09"):
        jobs.build_day(built, "2019-10-09", FIRST)
    gate = quality.dwd_gate(
        built.read("ods_event_log"), built.read("dwd_event_fact"), built.read("dwd_event_dirty"),
        "2019-10-09", "2019-10-09",
    )
    assert [r.code for r in gate.filter("status = 'BLOCK'").collect()] == ["empty_partition"]
    with pytest.raises(quality.QualityBlock):
        quality.raise_on_block(gate)


def test_narrow_rebuild_of_history_is_refused(built):
    with pytest.raises(ValueError, match="product versions"):
        jobs.build_range(built, "2019-10-02", LAST, steps=("dim_product_scd2",))


def test_unknown_step_is_refused(built):
    with pytest.raises(ValueError, match="unknown"):
        jobs.build_range(built, FIRST, LAST, steps=("no_such_step",))


def test_daily_builds_reach_the_same_reports_as_one_range_build(spark, built, folder):
    wh = Warehouse(spark, folder + "/wh")
    events.ingest_bulk(wh, built.read("ods_event_log").drop("event_date"))
    jobs.build_range(wh, FIRST, "2019-10-06")
    for day in ("2019-10-07", "2019-10-08"):
        jobs.build_day(wh, day, FIRST)
    for name in TABLES:
        if name in ("dim_product_scd2",):
            continue
        assert reconcile.fingerprint(wh.read(name)).first() == reconcile.fingerprint(built.read(name)).first(), name
    # no product skipped a day, so merged and rebuilt histories agree as well
    key = ["product_id", "brand", "dw_start_date", "dw_end_date", "dw_is_current"]
    a, b = (x.read("dim_product_scd2").select(*key) for x in (wh, built))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
