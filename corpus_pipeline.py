"""A training corpus from raw documents: quality, near duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, jaccard, quality, secrets
from tidemark.llm.store import Scratch


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``; a null id stays where it is in both."""
    wanted = ids.select(F.col("doc_id").alias("_wanted")).distinct()
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_wanted"]), "left_semi")


def _text_hash() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those whose id and text are in ``bad`` (doc_id, text_hash): other texts under the same or no id stay."""
    bad = bad.select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (_text_hash() == bad["_hash"]), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, each row judged by its own text."""
    judged = quality.classify(
        docs.withColumn("text_hash", _text_hash()), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_cols=("text_hash",))
    return _without(docs, judged.filter("NOT keep"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"))
    return _only(docs, groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id")))).dropDuplicates(["doc_id", "text"])


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows, each row judged by its own text."""
    found = decontam.contamination(
        docs.select("doc_id", "text", _text_hash().alias("text_hash")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_cols=("text_hash",))
    return _without(docs, found.filter("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets give way to their kind in brackets; copied examples stay. n_chars follows the text."""
    columns = docs.columns
    found = secrets.find_secrets(docs, keep=tuple(c for c in columns if c != "doc_id"))
    text = F.when(F.col("text").isNotNull(), secrets.redacted(F.col("text"), F.col("secrets")))
    live = F.col("n_live") > 0
    return found.withColumn("n_chars", F.when(live, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(*columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document left."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_first),
    ("decontamination", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

#: The stages rest on a trained scorer and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
