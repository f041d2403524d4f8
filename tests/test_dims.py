from datetime import date

from pyspark.sql import functions as F

from tests.sample import FIRST, LAST, event, frame, sample_events
from tidemark.operators import cleaning, dims


def facts(spark, rows):
    return cleaning.build_fact(frame(spark, rows))


def same(a, b):
    return a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(b.columns))).isEmpty() and a.count() == b.count()


def test_user_dim_merged_day_by_day_equals_rebuild(spark):
    fact = facts(spark, sample_events())
    dim = spark.createDataFrame(
        dims.user_dim(fact.filter(F.col("event_date") == FIRST)).collect(), dims.user_dim(fact).schema
    )
    for n in range(2, 9):
        merged = dims.merge_user_dim(dim, fact, f"2019-10-0{n}")
        dim = spark.createDataFrame(merged.collect(), dim.schema)
    assert same(dim, dims.user_dim(fact))


def test_user_merge_same_day_again_and_users_not_seen(spark):
    fact = facts(spark, sample_events())
    dim = dims.user_dim(fact)
    again = dims.merge_user_dim(dim, fact, LAST)
    assert same(again, dim)
    user2 = again.filter("user_id = 2").first()
    assert (user2.active_days, user2.purchase_days, user2.last_seen_date) == (4, 4, date(2019, 10, 7))


def test_left_censored_buyers(spark):
    row = dims.left_censored(dims.user_dim(facts(spark, sample_events())), FIRST).first()
    assert tuple(row) == (3, 2, 2)


def test_known_session_is_not_extended(spark):
    rows = [event(0, 23, "view", 1, "a", 1, session="s"), event(1, 1, "view", 1, "a", 1, session="s"),
            event(1, 2, "view", 1, "a", 2, session="t")]
    fact = facts(spark, rows)
    first = dims.session_dim(fact.filter(F.col("event_date") == "2019-10-01"))
    new = dims.new_sessions(first, fact, "2019-10-02")
    assert [r.user_session for r in new.collect()] == ["t"]
    # so the incremental end of "s" stays at day one, while a rebuild extends it
    assert first.first().session_end_time < dims.session_dim(fact).filter("user_session = 's'").first().session_end_time


def test_missing_session_counts_as_a_shared_value_but_is_no_session(spark):
    rows = [event(0, 1, "view", 1, "a", 1), event(0, 2, "view", 1, "a", 2)]
    rows = [r[:8] + (None,) for r in rows] + [event(0, 3, "view", 1, "a", 3, session="x")]
    fact = facts(spark, rows)
    row = dims.multi_user_sessions(fact).first()
    assert (row.multi_user_sessions, row.sessions) == (1, 1)
    assert dims.session_dim(fact).count() == 1


def test_category_levels_and_todays_code_wins(spark):
    rows = [event(0, 1, "view", 1, "a", 1, code="z.y.x"), event(1, 1, "view", 1, "a", 1, code="a.b"),
            event(0, 2, "view", 1, "a", 1, code=None, category=11)]
    fact = facts(spark, rows)
    full = {r.category_id: r for r in dims.category_dim(fact).collect()}
    assert full[10].category_code == "z.y.x" and full[10].category_l3 == "x"
    assert full[11].category_l1 is None
    first = dims.category_dim(fact.filter(F.col("event_date") == "2019-10-01"))
    merged = dims.merge_category_dim(first, fact, "2019-10-02").filter("category_id = 10").first()
    assert (merged.category_code, merged.category_l1, merged.category_l2, merged.category_l3) == ("a.b", "a", "b", "x")


def test_calendar(spark):
    rows = {r.date_id: r for r in dims.date_dim(spark, "2019-01-01", "2019-12-31").collect()}
    assert len(rows) == 365
    sunday = rows[date(2019, 10, 6)]
    assert (sunday.day_of_week, sunday.is_workday, sunday.week_of_year) == (1, 0, 40)
