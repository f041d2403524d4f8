"""Classifier by held-out labels, pipeline by its stages, registered queries by their SQL."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import cases
from tidemark.llm import oracles, quality
from verification.compare import connect, differences, rows_of_spark, rows_of_sql

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality.classify(docs, labels, use_all_labels=False)
    seen = judged.join(labels.filter(quality._held_out(labels["doc_id"])), "doc_id").toPandas()
    bad = (seen["quality"] == 0) | (seen["toxic"] == 1)
    assert len(seen) > 40 and seen["keep"][~bad].mean() > 0.97
    assert (~seen["keep"][seen["quality"] == 0]).mean() >= 0.8


def test_expectation_maximisation_finds_the_accuracies():
    pick = np.random.default_rng(3)
    kind = pick.choice(4, p=[0.7, 0.1, 0.1, 0.1], size=20000)
    true = np.full((7, 4), 0.02)
    true[0, 1], true[1:5, 2], true[5, 3], true[6, 1:] = 0.9, 0.7, 0.8, 0.99
    votes = (pick.random((20000, 7)) < true[:, kind].T).astype(int)
    votes[pick.random(20000) < 0.7, 6] = -1
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, rate, share = quality.expectation_maximisation(patterns, count.astype(float))
    assert abs(1 - share[0] - 0.3) < 0.05 and abs(rate[0, 1] - 0.9) < 0.1
    # as good as the rule that knows the accuracies
    like = np.where(votes == 1, 1, 0) @ np.log(true) + np.where(votes == 0, 1, 0) @ np.log1p(-true) + np.log([0.7, 0.1, 0.1, 0.1])
    best = (np.exp(like[:, 1:]).sum(1) > np.exp(like[:, 0])) == (kind > 0)
    assert ((posterior[at.ravel()] > 0.5) == (kind > 0)).mean() > best.mean() - 0.01


def test_without_documents_the_beliefs_stay():
    posterior, rate, share = quality.expectation_maximisation(np.empty((0, 7), int), np.empty(0))
    assert len(posterior) == 0 and np.isfinite(rate).all() and share.sum() == 1


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    others = spark.range(10**6, 10**6 + 2000).selectExpr("id AS doc_id", "0 AS quality", "1 AS toxic")
    scores = [{r["doc_id"]: r["score"] for r in quality.classify(docs, known, sample=200).select("doc_id", "score").collect()}
              for known in (labels, labels.select("doc_id", "quality", "toxic").unionByName(others))]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 10


def test_odd_rows_are_judged(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, None), (9, None, None), (None, 0, 0), (33, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(cases.frame(spark), labels).collect()
    assert len(got) == len(cases.documents())
    assert all(r.keep and r.score == 0 for r in got if r.doc_id in (7, 8, 10))
    assert quality.classify(cases.frame(spark), labels.limit(0)).count() == len(cases.documents())
    assert quality.classify(cases.frame(spark, []), labels).count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    junk = "Buy!!! NOW!!! ### $$$ %%% &&& *** " * 8
    rows = cases.documents() + [(60, junk), (61, "token=b7db7aa4a5fcc78305 " + " ".join(cases.words(40, 9)))]
    frame = cases.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(60, 0, 0), (5, 1, 0), (33, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(cases.words(70, 2)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        path = f"{tables}/stage{n}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 60 not in kept["quality"] and {3, 5, 9, 31} <= kept["quality"]
    assert 3 in kept["near_duplicates"] and not kept["near_duplicates"] & {5, 9, 12} and {7, 8, 10, None} <= kept["near_duplicates"]
    assert not kept["decontamination"] & {30, 31, 32} and kept["decontamination"] == kept["near_duplicates"] - {30, 31, 32}
    assert kept["secrets"] == kept["decontamination"] == kept["tokens"]
    text = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{tables}/stage3").collect()}
    assert text[61][0].startswith("[assign] ") and text[61][1] == len(text[61][0])


def test_clean_rows_stay_beside_bad_ones_of_their_id(spark, tmp_path):
    """One rejected and one contaminated row under a null id and under id 70; every other row is clean."""
    junk = "Buy!!! NOW!!! ### $$$ %%% &&& *** "
    clean = [" ".join(cases.words(60, 100 + i)) for i in range(8)]
    passage = " ".join(cases.words(70, 2))
    rows = [(i, junk * (8 + i)) for i in range(900, 940)] + [(i, " ".join(cases.words(60, i))) for i in range(1000, 1040)]
    rows += [(i, t) for i in (None, 70) for t in (*clean, junk * 7, passage)] + [(None, None)]
    frame = cases.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    labels = [(i, int(i >= 1000), 0) for i, _ in rows if i is not None and i >= 900]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    under = lambda out: sorted(((r.doc_id, r.text) for r in out.collect() if r.doc_id in (None, 70)), key=str)
    good = corpus_pipeline.keep_good(spark, frame, str(tmp_path))
    assert under(good) == sorted([(i, t) for i in (None, 70) for t in (*clean, passage)] + [(None, None)], key=str)
    pure = corpus_pipeline.keep_uncontaminated(spark, frame, str(tmp_path))
    assert under(pure) == sorted([(i, t) for i in (None, 70) for t in (*clean, junk * 7)] + [(None, None)], key=str)


def test_run_equals_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == sorted(
        str(r.doc_id) for r in spark.read.parquet(f"{tables}/stage4").select("doc_id").collect())


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, con, name):
    got = rows_of_spark(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert differences(got, rows_of_sql(con, entry.oracle_sql()[name])) == []


def test_all_operators_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
