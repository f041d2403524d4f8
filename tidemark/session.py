"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Settings worth having on a cluster. Sizes, not counts: with AQE the number of
#: shuffle partitions follows the data, so the initial number may be generous.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.compression.codec": "snappy",
}


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in CLUSTER_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare_session(builder.getOrCreate())


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings that results depend on.

    Days are UTC days: another zone would move late events to the next day.

    Spark 4.1 may plan an aggregation over a union without a shuffle, trusting that
    both inputs are partitioned alike, and then run the union as a mere
    concatenation when one input is a reused exchange: groups stay split and counts
    are wrong. That optimization is switched off.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union by name, in a session where aggregating it is safe."""
    prepare_session(frames[0].sparkSession)
    return reduce(DataFrame.unionByName, frames)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of a job that ends in here are removed at once: what it wrote is on shared storage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so a rerun cannot meet old files."""
    return f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write ``df`` once to reliable storage and continue from the files.

    Two passes over the result then see the same rows, also after a lost executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
