"""Writes that a crash cannot leave half done, and digests kept at write time."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.sources import files
from tidemark.sources.warehouse import UnfinishedWrite, Warehouse

USER, DIM = "dws_user_behavior_daily", "dim_session"
START = date(2024, 1, 1)


def daily(spark, days, amount=1.0):
    rows = [(u, 1, amount + u / 3, 1, 1, START + timedelta(days=d)) for d in days for u in range(5)]
    return spark.createDataFrame(rows, "user_id bigint, active_action_cnt bigint, purchase_amount double, purchase_product_cnt bigint, "
                                       "purchase_cnt bigint, event_date date")


def days_in(wh):
    return {str(r[0]): r[1] for r in wh.read(USER).groupBy("event_date").agg(F.round(F.sum("purchase_amount"), 2)).collect()}


class Stopped(Exception):
    pass


def stop(*_):
    raise Stopped


def test_a_run_that_dies_before_the_removal_is_finished_by_the_next(spark, folder, monkeypatch):
    wh = Warehouse(spark, folder)
    wh.write_partitions(USER, daily(spark, range(6)))
    monkeypatch.setattr(Warehouse, "_remove_days", stop)
    with pytest.raises(Stopped):
        wh.write_partitions(USER, daily(spark, [1, 3], 2.0), covering=("2024-01-02", "2024-01-04"))
    monkeypatch.undo()
    assert "2024-01-03" in days_in(wh) and wh.unfinished(USER)["remove"] == ["2024-01-03"]
    wh.write_partitions(USER, daily(spark, [5], 3.0))  # of any day
    got = days_in(wh)
    assert sorted(got) == ["2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05", "2024-01-06"]
    assert got["2024-01-02"] == round(5 * 2.0 + 10 / 3, 2) and wh.unfinished(USER) is None


def test_a_run_that_dies_while_writing_must_be_repeated(spark, folder, monkeypatch):
    wh = Warehouse(spark, folder)
    wh.write_partitions(USER, daily(spark, range(4)))
    monkeypatch.setattr(Warehouse, "partitions", stop)  # between the write and the list of what goes
    with pytest.raises(Stopped):
        wh.write_partitions(USER, daily(spark, [1], 2.0), covering=("2024-01-01", "2024-01-03"))
    monkeypatch.undo()
    for attempt in (None, ("2024-01-02", "2024-01-03")):
        with pytest.raises(UnfinishedWrite, match="2024-01-01 to 2024-01-03"):
            wh.write_partitions(USER, daily(spark, [1], 2.0), covering=attempt)
    wh.write_partitions(USER, daily(spark, [1], 2.0), covering=("2024-01-01", "2024-01-03"))
    assert sorted(days_in(wh)) == ["2024-01-02", "2024-01-04"] and wh.unfinished(USER) is None


def test_a_marker_cut_off_while_it_was_replaced_is_read(spark, folder):
    files.write_text(spark, f"{folder}/m", "one")
    files.rename(spark, f"{folder}/m", f"{folder}/m.new")
    assert files.read_text(spark, f"{folder}/m") == "one"
    files.write_text(spark, f"{folder}/m", "two")
    assert files.read_text(spark, f"{folder}/m") == "two" and files.read_text(spark, f"{folder}/none") is None


@pytest.mark.parametrize("broken", ["append", "removal"])
def test_an_append_that_dies_adds_no_row_twice(spark, folder, monkeypatch, broken):
    wh = Warehouse(spark, folder, digests=True)
    schema = "user_session string, user_id bigint, session_start_time timestamp, session_end_time timestamp"
    new = spark.createDataFrame([(f"s{k}", k, None, None) for k in range(10)], schema)
    wh.overwrite(DIM, new.limit(3))
    fresh = lambda: new.join(wh.read(DIM).select("user_session"), "user_session", "left_anti")
    if broken == "append":  # the rows stand aside only
        fresh().write.parquet(f"{wh.path(DIM)}__new")
    else:
        monkeypatch.setattr(files, "remove", stop)
        with pytest.raises(Stopped):
            wh.append_new(DIM, fresh())
        monkeypatch.undo()
    wh.append_new(DIM, fresh())
    assert sorted(r.user_session for r in wh.read(DIM).collect()) == sorted(f"s{k}" for k in range(10))
    kept = wh.digests(DIM).select("part", "row_cnt", "hash_sum", "hash_xor").collect()
    assert kept == reconcile.partition_digests(wh.read(DIM), None).collect() and kept[0].row_cnt == 10


def test_digests_name_the_table_and_the_day(spark, folder):
    wh = Warehouse(spark, folder, digests=True)
    wh.write_partitions(USER, daily(spark, range(5)), covering=("2024-01-01", "2024-01-05"))
    wh.digests().write.parquet(f"{folder}/before")
    before = spark.read.parquet(f"{folder}/before")
    wh.write_partitions(USER, daily(spark, range(5)).repartition(3).orderBy(F.desc("user_id")))
    assert {r.status for r in reconcile.digest_changes(before, wh.digests()).collect()} == {"same"}
    one = daily(spark, [2]).withColumn("purchase_cnt", F.when(F.col("user_id") == 3, 9).otherwise(F.col("purchase_cnt")))
    wh.write_partitions(USER, one.unionByName(daily(spark, [7])))
    wh.write_partitions(USER, daily(spark, [0]), covering=("2024-01-01", "2024-01-02"))
    changes = {(r.table_name, r.part): r.status for r in reconcile.digest_changes(before, wh.digests()).filter("status <> 'same'").collect()}
    assert changes == {(USER, "2024-01-03"): "changed", (USER, "2024-01-08"): "added", (USER, "2024-01-02"): "removed"}
    whole = wh.digests(USER).agg(F.sum("row_cnt"), F.sum("hash_sum"), F.bit_xor("hash_xor")).first()
    assert tuple(whole) == tuple(reconcile.partition_digests(wh.read(USER), None).select("row_cnt", "hash_sum", "hash_xor").first())


def test_digests_do_not_depend_on_the_order_of_a_sum(spark):
    parts = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") / 100 + 0.01).alias("x"))
    sums = [parts.orderBy(o).coalesce(1).groupBy("k").agg(F.sum("x").alias("x")) for o in (F.asc("x"), F.desc("x"), F.rand(1))]
    assert len({tuple(reconcile.partition_digests(s, None).first()) for s in sums}) == 1


def test_forms_that_differ_are_named(spark):
    from tidemark.operators import benchset

    a = spark.range(10).select("id", (F.col("id") / 3).alias("x"))
    b = a.withColumn("x", F.when(F.col("id") == 4, 1.34).otherwise(F.col("x")))
    got = benchset.forms_agree({"p": a, "q": a, "r": a, "none": a.filter("false")}, {"p": a.orderBy(F.desc("id")), "q": b, "r": a.limit(9), "none": a.filter("false")})
    assert {r["query"]: r["equal"] for r in got.collect()} == {"p": 1, "q": 0, "r": 0, "none": 1}
    with pytest.raises(ValueError, match="different columns"):
        benchset.forms_agree({"p": a}, {"p": a.withColumn("y", F.lit(1))})
