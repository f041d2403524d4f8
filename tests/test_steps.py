"""Steps and exports that do not need each other run side by side."""

import re
from threading import Barrier

import pytest

from tests.sample import frame, sample_events
from tidemark.operators import cleaning, daily
from tidemark.plans import jobs
from tidemark.sources import export
from tidemark.sources.warehouse import Warehouse
from verification import cases_jobs
from verification.registry import QUERIES


class _Steps:
    """Every step notes its end; those of one wave meet first."""

    def __init__(self, together, failing=None):
        self.ended, self.failing = [], failing
        self.meeting = {n: b for names in together for b in [Barrier(len(names))] for n in names}

    def __getattr__(self, name):
        def step():
            if name in self.meeting:
                self.meeting[name].wait(timeout=20)
            self.ended.append(name)
            if name == self.failing:
                raise ValueError(name)
            return name
        return step


_DWS = ("dws_user_session", "dws_product", "dws_user_behavior", "dws_traffic_hour")
_MIDDLE = ("uv_bitmap", "user_sketch", *jobs.STEPS["dim"], "ads_trade")


def test_steps_run_side_by_side_and_after_what_they_read():
    run = _Steps([_DWS, _MIDDLE, jobs.STEPS["ads"][1:]])
    done = jobs._execute(run, None, None)
    assert list(done) == [n for layer in jobs.LAYERS for n in jobs.STEPS[layer]]
    assert run.ended[:3] == list(jobs.STEPS["dwd"])
    assert set(run.ended[3:7]) == set(_DWS) and set(run.ended[7:15]) == set(_MIDDLE)


def test_a_gate_stops_the_steps_after_it():
    for gate, ended in (("dwd_event_fact_dqc", 3), ("ads_trade", 15)):
        run = _Steps([], failing=gate)
        with pytest.raises(ValueError, match=gate):
            jobs._execute(run, None, None)
        assert len(run.ended) == ended


def test_product_days_sort_no_events(spark):
    fact = cleaning.build_fact(frame(spark, sample_events()))
    text = daily.product_daily(fact)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortAggregate[^\n]*sum\(", text), text


def test_products_without_key_or_brand_keep_their_row(spark):
    rows = [tuple(r) for r in cleaning.build_fact(frame(spark, sample_events())).collect()]
    fact = spark.createDataFrame(rows, cleaning.TABLES["dwd_event_fact"].schema)
    none = fact.sparkSession.sql("select * from values (1) t(x)")  # one more row: no product, no brand
    extra = fact.limit(1).crossJoin(none).drop("x").selectExpr(*(
        f"cast(null as {f.dataType.simpleString()}) as {f.name}" if f.name in ("product_id", "brand") else f.name for f in fact.schema.fields))
    got = daily.product_daily(fact.unionByName(extra)).filter("product_id is null").collect()
    assert len(got) == 1 and got[0].brand is None and got[0].exposure_uv + got[0].purchase_uv == 1
    assert {(r.product_id, r.brand) for r in daily.product_daily(fact).filter("event_date = '2019-10-01'").collect()} == {
        (1001, "alpha"), (1002, "gamma")}


def test_tables_are_exported_side_by_side(spark, tmp_path):
    class Meeting(Warehouse):
        both = Barrier(2)

        def read(self, name, start=None, end=None):
            self.both.wait(timeout=20)
            return super().read(name, start, end)

    wh = Meeting(spark, str(tmp_path / "wh"))
    names = ["dim_user", "dim_category"]
    assert [(r.table_name, r.row_cnt) for r in export.export_csv(wh, str(tmp_path / "out"), names).collect()] == [(n, 0) for n in names]


def test_a_lost_column_is_found_without_the_other_tables(spark, monkeypatch):
    def build(t):
        raise AssertionError("only the exported table is needed")

    monkeypatch.setattr(cases_jobs, "_built", build)
    row = QUERIES["export_lost_column"](spark, "/root/testdata/sf0.001").first()
    assert row.row_cnt == row.rejected_rows > 0 and (row.columns_equal, row.values_equal, row.ok) == (0, 0, 0)
