"""Paths on the cluster file system: existence, removal, rename, partition folders. Metadata only."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, p = _open(spark, path)
    return fs.getContentSummary(p).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file; readers see the old or the new one."""
    aside = f"{path}.new"
    fs, p = _open(spark, aside)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    remove(spark, path)
    rename(spark, aside, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, also if its replacement was cut off between removal and rename."""
    for place in (path, f"{path}.new"):
        fs, p = _open(spark, place)
        if fs.exists(p):
            stream = fs.open(p)
            try:
                return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return None


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _open(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"cannot rename {old} to {new}")


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the non-empty partition folders, sorted. One listing per partition."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return []
    values = []
    for entry in fs.listStatus(p):
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith(column + "="):
            if any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(entry.getPath())):
                values.append(name.split("=", 1)[1])
    return sorted(values)
