"""Sketches and containers of ids against sets."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitmap, sketches

DAYS = [date(2024, 1, 1) + timedelta(days=k) for k in range(4)]


def days_of(spark, users):
    """(event_date, user_id, active_action_cnt) for sets of users by day."""
    rows = [(d, u, abs(u) % 17) for d, s in zip(DAYS, users) for u in s]
    return spark.createDataFrame(rows, "event_date date, user_id bigint, active_action_cnt bigint").repartition(5)


@pytest.mark.parametrize("most", [0, 3, 40, 2048])
def test_containers_equal_sets(spark, most):
    pick = random.Random(most)
    near = [set(pick.sample(range(400), 300)) | {0, 32767, 32768} for _ in DAYS]
    far = [{pick.randrange(-10**9, 10**12) for _ in range(200)} for _ in DAYS]
    users = [n | f | set(list(far[0])[:50]) for n, f in zip(near, far)]
    users[3] = far[3]  # lists on one day, bitmaps on the others
    rows = days_of(spark, users)
    held = bitmap.build_uv_bitmap(rows.unionByName(rows.limit(7)), most_listed=most)
    assert held.filter("users <> coalesce(size(positions), bitmap_count(user_bitmap)) OR (positions IS NULL) = (user_bitmap IS NULL)").isEmpty()
    assert held.filter(F.size("positions") > most).isEmpty()
    assert bitmap.uv_total(held).first().uv == len(set().union(*users))
    assert {r.event_date: r.uv for r in bitmap.uv_daily(held).collect()} == {d: len(s) for d, s in zip(DAYS, users)}
    assert bitmap.uv_range(held, DAYS[1], DAYS[2]).first().uv == len(users[1] | users[2])
    for a, b in ((0, 1), (0, 3), (3, 1)):
        assert bitmap.bitmap_retained(held, DAYS[a], DAYS[b]).first()[0] == len(users[a] & users[b])
        assert bitmap.bitmap_churned(held, DAYS[a], DAYS[b]).first()[0] == len(users[a] - users[b])


def test_far_ids_take_two_bytes_each(spark):
    rows = days_of(spark, [set(range(0, 32768 * 5000, 32768))])
    held = bitmap.build_uv_bitmap(rows).agg(F.count("*"), F.sum(F.size("positions")), F.count("user_bitmap")).first()
    assert tuple(held) == (5000, 5000, 0)


@pytest.fixture(scope="module")
def many(spark):
    """50,000 users on each of four days, a third of them new every day; counts follow from the ranges."""
    ids = spark.range(4).select(F.explode(F.sequence(F.col("id") * 17000, F.col("id") * 17000 + 49999)).alias("user_id"), "id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    return ids.select(day.alias("event_date"), "user_id", (F.col("user_id") % 1000).alias("active_action_cnt"))


def test_estimates_lie_within_their_bounds(spark, many):
    stored = sketches.daily_sketches(many)
    uv = sketches.uv_approx(stored, DAYS[0], DAYS[3]).first()
    assert uv.low <= 101_000 <= uv.high and uv.high - uv.low < 0.1 * uv.uv
    again = sketches.uv_approx(many.agg(F.hll_sketch_agg("user_id", 12).alias("users_hll")).withColumn("event_date", F.lit(DAYS[0])), DAYS[0], DAYS[0]).first()
    assert again.uv == uv.uv
    kept, lost = sketches.retained_approx(stored, DAYS[0], DAYS[1]).first(), sketches.churned_approx(stored, DAYS[0], DAYS[1]).first()
    assert kept.low <= 33_000 <= kept.high and lost.low <= 17_000 <= lost.high and kept.high - kept.low < 6000
    none = sketches.retained_approx(stored, DAYS[0], DAYS[3]).first()
    assert none.low == 0 <= none.high < 200


def test_quantiles_of_a_range(spark, many):
    found = {r.share: r.events for r in sketches.event_quantiles(sketches.daily_sketches(many), DAYS[1], DAYS[2]).collect()}
    error = 1000 * sketches.rank_error()
    assert all(abs(found[p] - 1000 * p) <= error + 1 for p in (0.5, 0.9, 0.99))


def test_days_without_users(spark):
    stored = sketches.daily_sketches(days_of(spark, [{1, 2, 3}]))
    assert tuple(sketches.uv_approx(stored, "2025-01-01", "2025-01-02").first()) == (0, 0, 0)
    assert tuple(sketches.retained_approx(stored, DAYS[0], DAYS[1]).first()) == (0, 0, 0)
    assert tuple(sketches.churned_approx(stored, DAYS[0], DAYS[1]).first()) == (3, 3, 3)
    assert tuple(sketches.churned_approx(stored, DAYS[1], DAYS[0]).first()) == (0, 0, 0)
    assert sketches.event_quantiles(stored, "2025-01-01", "2025-01-02").isEmpty()
