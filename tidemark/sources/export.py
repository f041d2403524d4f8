"""CSV exports: for loading elsewhere (with manifest and verification), and report files."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import TABLES
from ..session import stack
from .warehouse import Warehouse

# The CSV dialect of the receiving side
CSV_OPTIONS = {
    "header": "false",
    "sep": ",",
    "nullValue": r"\N",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
    "dateFormat": "yyyy-MM-dd",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": "\\",
    "emptyValue": "",
}
REPORTS = (
    "ads_trade_daily", "ads_conversion_funnel_daily", "ads_product_hot_rank_daily", "ads_session_behavior_daily",
    "ads_user_rfm_snapshot", "dim_category",
)
EXPORTABLE = tuple(n for n, s in TABLES.items() if all(t != "binary" for _, t, _ in s.columns))
WRITERS = 6  # tables written at a time
_REJECTED = "_rejected_line"
_READ_OPTIONS = {k: v for k, v in CSV_OPTIONS.items() if k not in ("emptyValue",)}
_MANIFEST = "db string, table_name string, partition_col string, columns string, row_cnt bigint"


def export_csv(wh: Warehouse, out: str, names=EXPORTABLE) -> DataFrame:
    """Each table as CSV part files, partition column last, and a manifest with columns and rows.

    Rows are counted while writing. The files keep the parallelism of the table; a few tables are written
    side by side, as most are small.
    """
    def write(name: str) -> tuple:
        spec = wh.spec(name)
        observed, result = wh.observed(wh.read(name).select(*spec.column_names), None)
        observed.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{out}/{name}")
        return wh.database(spec.layer), name, spec.partition, json.dumps(spec.column_names), result().rows

    with ThreadPoolExecutor(WRITERS) as pool:
        entries = list(pool.map(write, names))
    manifest = wh.spark.createDataFrame(entries, _MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")  # one line per table
    return manifest


def _digest(df: DataFrame, schema: StructType):
    """One number for the values of all rows, whatever their order. Times count to the second, as they are written."""
    def text(f):
        value = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") if f.dataType.typeName() == "timestamp" else F.col(f.name).cast("string")
        return F.coalesce(value, F.lit(""))

    return F.coalesce(F.sum(F.xxhash64(*map(text, schema.fields)).cast("decimal(38,0)")), F.lit(0)).cast("string")


def verify_export(wh: Warehouse, out: str) -> DataFrame:
    """The files against table and manifest: columns, rows, values.

    ``rejected_rows`` are lines that do not have the table's columns: too few or too many fields, or a
    value that is none of the column's type. Columns are equal if the manifest names them in order and no line is rejected.
    """
    entries = wh.spark.read.schema(_MANIFEST).json(f"{out}/manifest")
    checked = []
    for row in entries.collect():  # one row per table
        schema = wh.spec(row.table_name).schema
        loaded = wh.spark.read.schema(StructType([*schema.fields, StructField(_REJECTED, StringType())])).csv(
            f"{out}/{row.table_name}", mode="PERMISSIVE", columnNameOfCorruptRecord=_REJECTED, **_READ_OPTIONS)
        named = int(json.loads(row.columns) == schema.fieldNames())
        found = loaded.agg(
            F.count("*").alias("loaded_rows"), F.count(_REJECTED).alias("rejected_rows"), _digest(loaded, schema).alias("digest"))
        table = wh.read(row.table_name)
        checked.append(found.select(
            F.lit(row.table_name).alias("table_name"), "loaded_rows", "rejected_rows",
            F.when((F.lit(named) == 1) & (F.col("rejected_rows") == 0), 1).otherwise(0).alias("columns_equal"),
            F.when(F.col("digest") == table.agg(_digest(table, schema).alias("d")).scalar(), 1).otherwise(0).alias("values_equal"),
        ))
    good = (F.col("columns_equal") == 1) & (F.col("values_equal") == 1) & (F.col("row_cnt") == F.col("loaded_rows"))
    return entries.select("table_name", "row_cnt").join(stack(checked), "table_name").withColumn("ok", F.when(good, 1).otherwise(0))


def export_reports(wh: Warehouse, out: str, names=REPORTS) -> list[str]:
    """Report files with a header; of the RFM table only the newest snapshot."""
    paths = []
    for name in names:
        df = wh.read(name)
        if name == "ads_user_rfm_snapshot":
            df = df.filter(F.col("as_of_dt") == wh.read(name).agg(F.max("as_of_dt")).scalar())
        df.write.mode("overwrite").csv(f"{out}/{name}", header=True, encoding="UTF-8")
        paths.append(f"{out}/{name}")
    return paths
