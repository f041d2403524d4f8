from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.sample import event, frame, sample_events
from tidemark.constants import BEHAVIOR_ZH
from tidemark.operators import cleaning
from tidemark.sources.warehouse import Warehouse


def test_prices_that_are_clean_and_dirty(spark):
    prices = [None, float("nan"), float("-inf"), float("inf"), -0.01, 0.0]
    rows = [event(0, i, "view", 1, "b", 1, price=p) for i, p in enumerate(prices)]
    got = {r.event_time.hour: r.dirty_reason for r in cleaning.with_dirty_reason(frame(spark, rows)).collect()}
    assert [got[i] for i in range(6)] == [None, None, "negative_price", None, "negative_price", None]


def test_first_reason_wins(spark):
    rows = [
        event(0, 0, "invalid", 1, "b", None, price=-1.0),
        event(0, 1, None, 1, "b", 1, price=-1.0),
        event(0, 2, "cart", 1, "b", 1, price=-1.0),
        event(0, 3, "cart", None, "b", 1),
    ]
    got = [r.dirty_reason for r in cleaning.with_dirty_reason(frame(spark, rows)).orderBy("event_time").collect()]
    assert got == ["null_key", "invalid_event_type", "negative_price", "null_key"]


def test_unreadable_time_is_quarantined_and_the_balance_closes(spark, folder):
    rows = sample_events() + [(None, "view", 1, 1, "c", "b", 1.0, 1, "s")]
    raw = cleaning.with_event_date(frame(spark, rows))
    balance = cleaning.account_balance(raw, cleaning.build_fact(raw), cleaning.dirty_events(raw))
    total = balance.agg(F.sum("source_cnt"), F.sum("clean_cnt"), F.sum("dirty_cnt"), F.sum("duplicate_cnt")).first()
    assert tuple(total) == (38, 32, 4, 2)
    assert balance.filter("balanced = 0").isEmpty()
    unreadable = balance.filter("event_date IS NULL").first()
    assert (unreadable.source_cnt, unreadable.dirty_cnt) == (1, 1)
    wh = Warehouse(spark, folder)
    wh.write_partitions("dwd_event_dirty", cleaning.dirty_events(raw))
    assert wh.read("dwd_event_dirty").filter("event_date IS NULL").count() == 1


def test_tie_break_takes_nulls_first_and_rejects_the_conflicting_copy(spark):
    rows = [event(0, 1, "view", 1, b, 1) for b in ("b", None, "a")] + [
        event(0, 2, "view", 1, b, 1) for b in ("z-conflicting", "alpha")
    ]
    got = {r.event_time.hour: r.brand for r in cleaning.dedup_events(frame(spark, rows)).collect()}
    assert got == {1: None, 2: "alpha"}


def test_summary_counts_most_first(spark):
    rows = sample_events() + [event(2, 16, "view", 1, "a", None)]
    got = [(r.dirty_reason, r.cnt) for r in cleaning.dirty_summary(frame(spark, rows)).collect()]
    assert got[0] == ("null_key", 2) and Counter(dict(got)).total() == 4


def test_labels_can_be_chinese(spark):
    fact = cleaning.build_fact(frame(spark, sample_events()), BEHAVIOR_ZH)
    assert {r.behavior_type for r in fact.select("behavior_type").distinct().collect()} == {"浏览", "购买"}


_row = st.tuples(
    st.integers(0, 1), st.sampled_from(["view", "cart"]), st.integers(1, 2),
    st.sampled_from([None, "a", "b"]), st.integers(1, 2), st.sampled_from([None, 1.0, 2.0]),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_row, min_size=1, max_size=25))
def test_dedup_equals_brute_force(spark, rows):
    events = [event(0, h, k, p, b, u, price=x, session="s") for h, k, p, b, u, x in rows]
    nulls_first = lambda v: (v is not None, v if v is not None else 0)
    best: dict = {}
    for e in events:
        key = (e[7], e[0], e[2], e[1])
        rest = (nulls_first(e[3]), (e[4] is not None, e[4] or ""), (e[5] is not None, e[5] or ""), nulls_first(e[6]),
                (True, e[8]))
        if key not in best or rest < best[key][0]:
            best[key] = (rest, e)
    want = sorted((e[0], e[1], e[2], str(e[5]), str(e[6]), e[7]) for _, e in best.values())
    got = sorted(
        (r.event_time, r.event_type, r.product_id, str(r.brand), str(r.price), r.user_id)
        for r in cleaning.dedup_events(frame(spark, events)).collect()
    )
    assert got == want


def test_many_copies_of_one_event_leave_one_row(spark):
    one = frame(spark, [event(0, 1, "view", 1, "a", 1)])
    copies = spark.range(0, 20000, 1, 8).crossJoin(one).drop("id")
    others = frame(spark, [event(0, h, "view", 2, "a", 1) for h in range(5)])
    assert cleaning.dedup_events(copies.unionByName(others)).count() == 6
