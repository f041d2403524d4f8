"""Similarity join, repeated strings and decontamination against plain versions."""

import pytest

from tests.llm import cases
from tidemark.llm import decontam, graph, jaccard, repeats
from tidemark.llm.store import Scratch

EMPTY = []


def test_components_equal_all_pairs(spark):
    rows = cases.documents()
    got = jaccard.jaccard_components(cases.frame(spark)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=str) == cases.jaccard(rows)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[5] == by_id[9] == by_id[12] == 3 and by_id[21] == 20 and by_id[7] == 7


def test_an_id_with_a_copy_and_a_text_of_its_own(spark):
    own, copied = cases.words(80, 21), cases.words(80, 22)
    rows = [(1, " ".join(copied)), (40, " ".join(copied)), (40, " ".join(own)), (41, " ".join([*own[:79], "changed"]))]
    got = jaccard.jaccard_components(cases.frame(spark, rows)).collect()
    assert sorted(((False, r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == cases.jaccard(rows)
    assert {r.component_id for r in got} == {1}


def test_components_of_many_near_copies(spark):
    """A chain of edits: ends are not alike, yet connected; unrelated texts that share a passage are not."""
    base = cases.words(90, 1)
    rows, now = [], list(base)
    for i in range(60):
        now[(i * 7) % 90] = f"edit{i}"
        rows.append((i, " ".join(now)))
    passage = " ".join(cases.words(30, 2))
    rows += [(100 + i, passage + " " + " ".join(cases.words(60, 50 + i))) for i in range(40)]
    got = jaccard.jaccard_components(cases.frame(spark, rows)).collect()
    assert sorted(((False, r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == cases.jaccard(rows)


def test_components_of_large_sets_and_groups(spark):
    """Sets beyond the 512 ranges on both sides of the limit, in groups of more than three rows, some of them copies or of one id."""
    rows, at = [], 0
    for family, size in enumerate((500, 520, 700, 1400)):
        base = cases.words(size, 300 + family, 100000)
        for k in range(9):
            now, step = list(base), 5 * (k + 3)
            for i in range(k * 7, size, max(5, 6 * step // 5)):
                now[i] = f"own{k}x{i}"
            rows.append((at, " ".join(now[k * size // 40:] if k % 2 else now)))
            at += 1
        rows += [(at, rows[-1][1]), (at, rows[-4][1]), (at + 1, rows[-2][1])]
        at += 2
    got = jaccard.jaccard_components(cases.frame(spark, rows)).collect()
    want = cases.jaccard(rows)
    assert sorted(((False, r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert 8 < len({w[3] for w in want}) < len({i for i, _ in rows}) - 4


def test_similarity_join_moves_little(spark):
    """Every passage stands in two texts that are no links: of what is shuffled, with joins as at size, most is the prefixes, once."""
    passages = [" ".join(cases.words(150, 1000 + i, 1000000)) for i in range(800)]
    rows = [(i, f"{passages[i - 1]} {passages[i]}") for i in range(800)]
    jvm = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        """Bytes by stage."""
        jvm.listenerBus().waitUntilEmpty(30_000)
        stages = jvm.statusStore().stageList(None, False, False, none, None)
        return {x.stageId(): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    docs = cases.frame(spark, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = max(shuffled(), default=-1)
        got = jaccard.jaccard_components(docs).collect()
        moved = sum(n for stage, n in shuffled().items() if stage > start)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(r.component_id == r.doc_id for r in got)
    assert 0 < moved < 14_000_000


def test_a_sieve_loses_no_row(spark):
    ids = spark.range(0, 4000, 7).withColumnRenamed("id", "doc_id")
    kept = {r.doc_id: r.maybe for r in jaccard.sieved(spark.range(4000).withColumnRenamed("id", "doc_id"), ids, ["doc_id"]).collect()}
    assert len(kept) == 4000 and all(kept[i] for i in range(0, 4000, 7)) and sum(kept.values()) < 600
    assert not any(r.maybe for r in jaccard.sieved(ids, ids.filter("doc_id < 0"), ["doc_id"]).collect())


def test_components_of_a_graph(spark):
    edges = [(1, 2), (2, 3), (3, 9), (4, 5), (5, 4), (7, 7), (None, 8), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert dict(map(tuple, got.collect())) == {2: 1, 3: 1, 9: 1, 5: 4, **{i: 20 for i in range(21, 26)}}


def test_removed_bytes_equal_window_by_window(spark):
    got = repeats.remove_repeats(cases.frame(spark)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == cases.repeats(cases.documents())
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)


@pytest.mark.parametrize("width", [1, 7, 24])
def test_other_widths(spark, width):
    rows = [(1, "abcabcabd xyz"), (2, "zabcabcab"), (3, "xyzxyzxyz abcabcabcabcabcabcabcabcabc"), (3, "xyz"), (4, "abcabcabcabcabcabcabcabcabc")]
    got = repeats.remove_repeats(cases.frame(spark, rows), width).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == cases.repeats(rows, width)


def test_contamination_equals_window_by_window(spark):
    passage = cases.words(70, 2)
    items = [(1, " ".join(passage[10:40])), (2, " ".join(passage[10:24])), (2, "One two"), (3, None), (4, ""), (5, "ßäö ein"), (None, "three"),
             (11, " ".join(passage[12:25]).upper()), (6, "never seen " * 9), (7, "three")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.contamination(cases.frame(spark), frame).collect()
    want = cases.contamination(cases.documents(), items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == want
    assert any(w[4] for w in want) and all(r.n_items == len(r["items"]) for r in got)


def test_empty_tables(spark):
    none, some = cases.frame(spark, EMPTY), cases.frame(spark, [(1, "a b c d e f")])
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert decontam.contamination(none, items).count() == 0
    assert [tuple(r)[1:4] for r in decontam.contamination(some, items).collect()] == [(6, 0, 0)]
