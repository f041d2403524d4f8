"""Tables on disk: reading, partition-wise overwrite, append, rewrite, snapshot, catalog registration."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import between_days
from ..operators.reconcile import partition_digests
from ..schemas import LAYERS, TABLES, TableSpec
from ..session import prepare_session
from . import files

SNAPSHOTS = ("ads_user_rfm_snapshot",)


@dataclass(frozen=True)
class Written:
    """What a write produced, observed while writing rather than by reading the result again."""

    rows: int
    partitions: tuple


class UnfinishedWrite(RuntimeError):
    """A write of the table broke off; the days it covered must be written again first."""


class Warehouse:
    """All tables below one root. Tables are Parquet folders; the catalog is optional.

    With ``digests=True`` every write also keeps a digest of each partition written, so two
    runs are compared, and a changed day is named, without reading the tables.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = "", digests: bool = False):
        self.spark = prepare_session(spark)
        self.root = root.rstrip("/")
        self.prefix = prefix
        self.keep_digests = digests

    # --- names ---------------------------------------------------------------
    def spec(self, name: str) -> TableSpec:
        return TABLES[name]

    def path(self, name: str) -> str:
        return f"{self.root}/{self.spec(name).layer}/{name}"

    def database(self, layer: str) -> str:
        return self.prefix + layer

    def full_name(self, name: str) -> str:
        return f"{self.database(self.spec(name).layer)}.{name}"

    # --- reading -------------------------------------------------------------
    def read(self, name: str, start=None, end=None) -> DataFrame:
        """The table, or its days ``[start, end]``; a table never written is empty."""
        schema = self.spec(name).schema
        if not files.exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self.path(name))
        return df if start is None else df.filter(between_days(start, end))

    def partitions(self, name: str) -> list[str]:
        return files.partition_values(self.spark, self.path(name), self.spec(name).partition)

    def missing_days(self, name: str, start, end) -> list[date]:
        """Days of the range without a partition. Compares two lists of days; no data is read."""
        have = set(self.partitions(name))
        first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
        wanted = (first + timedelta(days=i) for i in range((last - first).days + 1))
        return [d for d in wanted if d.isoformat() not in have]

    # --- digests -------------------------------------------------------------
    def _digest_path(self, name: str) -> str:
        return f"{self.root}/_digests/{name}.json"

    def _kept_digests(self, name: str) -> dict[str, list]:
        return json.loads(files.read_text(self.spark, self._digest_path(name)) or "{}")

    def digests(self, *names: str) -> DataFrame:
        """(table_name, part, row_cnt, hash_sum, hash_xor) as kept at write time, one row per partition; all tables by default."""
        rows = [(n, part, cnt, Decimal(total), xor) for n in names or TABLES for part, (cnt, total, xor) in self._kept_digests(n).items()]
        return self.spark.createDataFrame(rows, "table_name string, part string, row_cnt bigint, hash_sum decimal(30,0), hash_xor bigint")

    def _keep_digests(self, name: str, df: DataFrame, gone: Iterable[str] | None = None) -> None:
        """Digests of what was written, read back from the files: partitions of ``df`` replace their own and those of ``gone`` go; all, if None."""
        if not self.keep_digests:
            return
        kept = {} if gone is None else self._kept_digests(name)
        for part in gone or ():
            kept.pop(part, None)
        for r in partition_digests(df, self.spec(name).partition).toLocalIterator():  # a row per partition written
            kept[r.part] = [r.row_cnt, str(r.hash_sum), r.hash_xor]
        files.write_text(self.spark, self._digest_path(name), json.dumps(kept))

    # --- unfinished writes -----------------------------------------------------
    def _mark_path(self, name: str) -> str:
        return f"{self.root}/_unfinished/{name}"

    def unfinished(self, name: str) -> dict | None:
        """The write that broke off, if any: its range, and the days it still had to remove."""
        text = files.read_text(self.spark, self._mark_path(name))
        return json.loads(text) if text else None

    def _mark(self, name: str, **state) -> None:
        files.write_text(self.spark, self._mark_path(name), json.dumps(state))

    def _unmark(self, name: str) -> None:
        files.remove(self.spark, self._mark_path(name))
        files.remove(self.spark, self._mark_path(name) + ".new")

    def _remove_days(self, name: str, days: Iterable[str]) -> None:
        for day in days:
            files.remove(self.spark, f"{self.path(name)}/{self.spec(name).partition}={day}")

    def mend(self, name: str, start=None, end=None) -> None:
        """Finish a write that broke off after its rows were in place. One that broke off before is
        refused, unless ``[start, end]``, about to be written, covers all of its days."""
        state = self.unfinished(name)
        if state is None:
            return
        if state["remove"] is not None:
            self._remove_days(name, state["remove"])
            day = F.col(self.spec(name).partition)
            self._keep_digests(name, self.read(name).filter(day.between(state["start"], state["end"]) | day.isNull()), state["remove"])
            self._unmark(name)
        elif start is None or str(start) > state["start"] or str(end) < state["end"]:
            raise UnfinishedWrite(f"{name}: a write of {state['start']} to {state['end']} broke off; write these days again")

    # --- writing -------------------------------------------------------------
    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spec(name).schema.fields))

    def observed(self, df: DataFrame, partition: str | None) -> tuple[DataFrame, Callable[[], Written]]:
        seen = Observation()
        values = F.collect_set(partition) if partition else F.collect_set(F.lit(None).cast("string"))
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), values.alias("partitions"))

        def result() -> Written:
            got = seen.get
            return Written(got["rows"], tuple(sorted(str(v) for v in got["partitions"])))

        return observed, result

    def write_partitions(self, name: str, df: DataFrame, covering: tuple | None = None) -> Written:
        """Overwrite exactly the partitions present in ``df``.

        The overwrite mode is set on this write, so a session default cannot turn
        it into an overwrite of the whole table. The rebalance gathers each day
        into few files and splits days that are too large for one task. With
        ``covering=(start, end)``, old days of that range which ``df`` no longer
        has are removed. The range is marked as unfinished until then: a run that dies
        in between is finished, or refused, by the next one (``mend``).
        """
        spec = self.spec(name)
        self.mend(name, *(covering or ()))
        if covering:
            self._mark(name, start=str(covering[0]), end=str(covering[1]), remove=None)
        placed = self._shaped(name, df).hint("rebalance", spec.partition)
        observed, result = self.observed(placed, spec.partition)
        (
            observed.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .partitionBy(spec.partition)
            .parquet(self.path(name))
        )
        written = result()
        gone = []
        if covering:
            start, end = (str(d) for d in covering)
            gone = [d for d in self.partitions(name) if start <= d <= end and d not in written.partitions]
            self._mark(name, start=start, end=end, remove=gone)
            self._remove_days(name, gone)
        if self.keep_digests:
            day = F.col(spec.partition)
            self._keep_digests(name, self.read(name).filter(day.isin(list(written.partitions)) | day.isNull()), gone)
        if covering:
            self._unmark(name)
        return written

    def overwrite(self, name: str, df: DataFrame) -> Written:
        """Replace an unpartitioned table by a result that does not read it."""
        observed, result = self.observed(self._shaped(name, df).hint("rebalance"), None)
        observed.write.mode("overwrite").option("compression", "snappy").parquet(self.path(name))
        self._keep_digests(name, self.read(name))
        return result()

    def append_new(self, name: str, df: DataFrame) -> Written:
        """Add rows that an anti-join found to be new. The rows are written aside first, as ``df`` reads the table.

        A run that dies on the way leaves the table with some of the new rows, or all; the next one finds the rest to be new.
        """
        aside = f"{self.path(name)}__new"
        observed, result = self.observed(self._shaped(name, df).hint("rebalance"), None)
        observed.write.mode("overwrite").parquet(aside)
        self.spark.read.schema(self.spec(name).schema).parquet(aside).write.mode("append").option(
            "compression", "snappy"
        ).parquet(self.path(name))
        self._keep_digests(name, self.read(name))  # the whole table: after a run that died, its new rows are more than those of ``df``
        files.remove(self.spark, aside)
        return result()

    def rewrite(self, name: str, change: Callable[[DataFrame], DataFrame]) -> Written:
        """Replace a table by a function of itself: write the new state aside, then swap the folders.

        The data is written once. Until the swap the old table is untouched; if the
        process dies between the two renames, the next call puts the old one back.
        """
        path, new, old = self.path(name), f"{self.path(name)}__new", f"{self.path(name)}__old"
        if not files.exists(self.spark, path) and files.exists(self.spark, old):
            files.rename(self.spark, old, path)
        observed, result = self.observed(self._shaped(name, change(self.read(name))).hint("rebalance"), None)
        observed.write.mode("overwrite").option("compression", "snappy").parquet(new)
        files.remove(self.spark, old)
        if files.exists(self.spark, path):
            files.rename(self.spark, path, old)
        files.rename(self.spark, new, path)
        files.remove(self.spark, old)
        self._keep_digests(name, self.read(name))
        return result()

    def replace_snapshot(self, name: str, df: DataFrame) -> Written:
        """Keep only this snapshot: every older partition goes, with its files."""
        spec = self.spec(name)
        observed, result = self.observed(self._shaped(name, df).hint("rebalance"), spec.partition)
        (
            observed.write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .option("compression", "snappy")
            .partitionBy(spec.partition)
            .parquet(self.path(name))
        )
        self._keep_digests(name, self.read(name))
        return result()

    # --- catalog -------------------------------------------------------------
    def create_tables(self, drop: bool | Iterable[str] = False) -> list[str]:
        """Register all tables over their folders. ``drop`` re-registers all, or the named ones; files stay."""
        for layer in LAYERS:
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS {self.database(layer)} LOCATION '{self.root}/_db/{layer}'"
            )
        dropped = set(TABLES) if drop is True else set(drop or ())
        for name, spec in TABLES.items():
            if name in dropped:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.full_name(name)}")
            self.spark.sql(spec.ddl(self.database(spec.layer), self.path(name)))
        return [self.full_name(n) for n in TABLES]

    def recover_partitions(self) -> list[str]:
        """Register partitions found on disk. Snapshot tables are skipped: an old snapshot must not come back."""
        done = []
        for name, spec in TABLES.items():
            if spec.partition and name not in SNAPSHOTS and files.exists(self.spark, self.path(name)):
                self.spark.catalog.recoverPartitions(self.full_name(name))
                done.append(name)
        return done
