import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.sample import event, frame
from tidemark.operators import cleaning, scd2
from tidemark.operators.numbering import number_rows

KEY = ["product_id", "brand", "dw_start_date", "dw_end_date", "dw_is_current"]


def facts(spark, rows):
    return cleaning.build_fact(frame(spark, rows))


def day(n):
    return f"2019-10-{n + 1:02d}"


def held(spark, dim):
    return spark.createDataFrame(dim.collect(), dim.schema)


GAP = [event(0, 1, "view", 1, "a", 1), event(1, 1, "view", 1, "a", 1), event(5, 1, "view", 1, "b", 1)]


def test_close_policies_differ_when_the_product_was_not_seen(spark):
    fact = facts(spark, GAP)
    ends = {
        close: scd2.scd2_build(fact, day(0), day(7), close).orderBy("dw_start_date").first().dw_end_date
        for close in ("last_seen", "change_day")
    }
    assert ends == {"last_seen": date(2019, 10, 3), "change_day": date(2019, 10, 6)}


def test_merging_day_by_day_equals_the_change_day_rebuild(spark):
    rng = random.Random(5)
    rows = [
        event(d, h, "view", p, rng.choice(["a", "b", None, ""]), 1)
        for d in range(5) for p in (1, 2, 3) for h in range(3) if rng.random() < 0.7
    ]
    fact = facts(spark, rows)
    dim = held(spark, scd2.scd2_build(fact, day(0), day(0)))
    for n in range(1, 5):
        scd2.ensure_mergeable(dim, day(n))
        dim = held(spark, scd2.scd2_merge(dim, fact, day(n)))
        assert tuple(scd2.scd2_validate(dim).first()) == (0, 0, 0)
    rebuilt = scd2.scd2_build(fact, day(0), day(4), close="change_day")
    assert dim.select(*KEY).exceptAll(rebuilt.select(*KEY)).isEmpty()
    assert dim.count() == rebuilt.count()
    keys = [r.dim_product_sk for r in dim.select("dim_product_sk").collect()]
    assert sorted(keys) == list(range(1, len(keys) + 1))


def test_null_and_empty_text_are_one_version(spark):
    rows = [event(d, 1, "view", 1, b, 1) for d, b in enumerate([None, "", None, "x"])]
    got = scd2.scd2_build(facts(spark, rows), day(0), day(3)).orderBy("dw_start_date").collect()
    assert [r.dw_start_date for r in got] == [date(2019, 10, 1), date(2019, 10, 4)]


def test_dominant_combination_and_ties(spark):
    rows = [event(0, h, "view", 1, b, 1) for h, b in enumerate(["b", "b", "a", "a", None])]
    assert scd2.dominant_attrs(facts(spark, rows)).first().brand == "a"  # tie by value, NULLs last
    rows = [event(0, h, "view", 1, b, 1) for h, b in enumerate([None, "a"])]
    assert scd2.dominant_attrs(facts(spark, rows)).first().brand == "a"


def test_lookup_is_half_open(spark):
    fact = facts(spark, [event(0, 1, "view", 1, "a", 1), event(1, 1, "view", 1, "b", 1)])
    dim = scd2.scd2_build(fact, day(0), day(1))
    got = scd2.scd2_asof(dim, fact.select("event_date", "product_id"))
    assert [(str(r.event_date), r.asof_brand) for r in got.orderBy("event_date").collect()] == [
        (day(0), "a"), (day(1), "b")]


def test_validate_finds_each_defect(spark):
    def row(sk, start, end, current, product=1):
        return (sk, product, 1, "c", "b", date.fromisoformat(start), date.fromisoformat(end), current)

    def found(*rows):
        dim = spark.createDataFrame(list(rows), scd2.TABLES["dim_product_scd2"].schema)
        return tuple(scd2.scd2_validate(dim).first()), dim

    assert found(row(1, "2019-01-01", "2019-01-05", 0), row(2, "2019-01-05", "9999-12-31", 1))[0] == (0, 0, 0)
    assert found(row(1, "2019-01-01", "2019-01-06", 0), row(2, "2019-01-05", "9999-12-31", 1))[0] == (0, 1, 0)
    assert found(row(1, "2019-01-01", "2019-01-05", 0))[0] == (1, 0, 0)
    counts, dim = found(row(1, "2019-01-01", "9999-12-31", 1), row(2, "2019-01-01", "9999-12-31", 1))
    assert counts == (1, 1, 1)
    with pytest.raises(ValueError, match="not_one_current_version"):
        scd2.ensure_mergeable(dim, "2019-02-01")
    with pytest.raises(ValueError, match="inconsistent"):
        scd2.ensure_valid(dim)
    with pytest.raises(ValueError, match="empty_table"):
        scd2.ensure_mergeable(dim.filter("false"), "2019-02-01")


def test_numbers_are_consecutive_in_order(spark):
    values = [(random.Random(i).randint(0, 500), i) for i in range(3000)]
    df = spark.createDataFrame(values, "a int, b int")
    got = number_rows(df, ["a", "b"], "n", after=F.lit(10)).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(values)
    assert [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(11, 3011))


def test_random_history_equals_brute_force(spark):
    rng = random.Random(11)
    seen = {(p, d): rng.choice("ab") for p in range(6) for d in range(12) if rng.random() < 0.6}
    rows = [event(d, 1, "view", p, b, 1) for (p, d), b in seen.items()]
    want = []
    for p in range(6):
        days = sorted(d for q, d in seen if q == p)
        runs = []
        for d in days:
            if runs and runs[-1][0] == seen[p, d]:
                runs[-1][2] = d
            else:
                runs.append([seen[p, d], d, d])
        for i, (brand, a, b) in enumerate(runs):
            last = i == len(runs) - 1
            end = date(9999, 12, 31) if last else date(2019, 10, 1) + timedelta(days=b + 1)
            want.append((p, brand, date(2019, 10, 1) + timedelta(days=a), end, int(last)))
    got = [tuple(r) for r in scd2.scd2_build(facts(spark, rows), day(0), day(11)).select(*KEY).collect()]
    assert sorted(got) == sorted(want)
