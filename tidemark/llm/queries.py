"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ans, bpe, crosstoken, decontam, jaccard, pages, quality, ratio, repeats, secrets, urlfilter, vafile, variants
from ..session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    ans.write_store(_table(spark, sf_dir, "documents"), path)
    return ans.read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents")).drop("secrets")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _fetched() -> Column:
    """The tables hold no fetch time: a day of 2024 by the page's id."""
    return F.expr("date_add(DATE '2024-01-01', CAST(page_id % 366 AS INT))")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of three lists, derived from the hosts and folders of the pages; days and choices by md5."""
    address = pages.select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path")).filter("host != ''")
    digit = lambda name, at: F.conv(F.substring(F.md5(name), at, 1), 16, 10).cast("int")
    day = lambda name, at: F.expr("DATE '2024-01-01'") + F.make_interval(days=digit(name, at) * 16 + digit(name, at + 1))

    def entry(keys: DataFrame, label: str, kind: str, verdict: str, upto: int) -> DataFrame:
        chosen = keys.distinct().filter(digit(F.col("pattern"), 1) < upto)
        return chosen.select(F.lit(label).alias("list"), F.lit(kind).alias("kind"), "pattern", F.lit(verdict).alias("verdict"), F.inline(F.array(
            F.struct(F.lit("add").alias("action"), day(F.col("pattern"), 2).cast("date").alias("dated")),
            F.struct(F.lit("remove").alias("action"), day(F.col("pattern"), 4).cast("date").alias("dated")),
            F.struct(F.lit("add").alias("action"), day(F.col("pattern"), 6).cast("date").alias("dated")))))

    folder = F.lower(F.concat("host", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit("/")))
    deep = address.filter("path LIKE '/%/%'")
    return (
        entry(address.select(F.col("host").alias("pattern")), "hosts", "domain", "block", 8)
        .unionAll(entry(address.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("pattern")).filter("pattern != ''"), "domains", "domain", "block", 12))
        .unionAll(entry(deep.select(folder.alias("pattern")), "folders", "prefix", "allow", 8))
    )


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "pages").select("page_id", "url")
    entries = list_entries(table)
    return urlfilter.judge(table.withColumn("fetched", _fetched()), entries)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents")).drop("ids")


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def op12_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.link_counts(_table(spark, sf_dir, "documents"))


def op13_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_vector_file, op2_quality, op3_ans, op4_secrets, op5_jaccard, op6_decontamination, op7_url_lists, op8_bpe, op9_pages, op10_repeats,
              op11_variants, op12_crosstoken, op13_ratio)
}

from .oracles import ORACLES  # noqa: E402,F401
