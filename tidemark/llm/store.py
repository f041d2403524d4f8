"""Written intermediate tables, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.files import remove

#: Shuffle files of a finished write are of no further use: what was written is on shared storage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator run below ``spark.checkpoint.dir``. A lost executor costs no more than the running job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, scratch_path(spark, label)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and continue from the files; the shuffle files of the write are released at once."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.read(df, name)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*(f"{self.folder}/{n}" for n in names))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c
                                       for c, f in zip(columns, schema)], schema=schema)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers that do not have its folder on their path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in known or app in _shipped or (os.path.abspath(os.getcwd()) == root and "local[" in spark.sparkContext.master):
        return spark
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "tidemark_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "tidemark")):
            for name in files:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
    return spark
