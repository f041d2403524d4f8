"""Removal of byte strings that an earlier document already holds, by depth-limited radix passes over suffixes.

Suffixes are ordered only as deep as the threshold (``width`` bytes), and only as
far as needed: a pass deals them by one digit, and what stands alone drops out
before the next. Equal groups after the last pass are exactly the repeated windows.

1. First digit: of the ``K``-byte strings inside a window the one with the smallest
   hash. Equal windows share it wherever they stand, and neighbouring windows
   share it too, so one row stands for a run of about 14 suffixes.
2. Second digit, within a group of the first that spans documents: the whole
   string that the run's windows cover. Where it is equal, all windows of the run
   are repeated at once.
3. Last digit, for the runs left (the edges of repeated passages): the windows
   themselves.

Dealing every suffix by its own first bytes would shuffle some 10 bytes for each
byte of text; the runs keep that near two.

Before a shuffle every batch settles what repeats inside it: a run whose string
also stands in an earlier document of the batch is covered already and is dealt
by its place, not by its digit. So a passage in a third of all documents brings
one row per batch to its group.

Rows: a null or empty text has 0 bytes. A null id takes no part: its text is kept
and covers nothing. Rows that share an id are one document, so they do not cover
each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, batch, ship
from .textkernel import BYTE_VALUES, flat, mix, powers, steps

K = 24  # bytes of the first digit; a run of windows grows with width - K

_LAST = np.int64(np.iinfo(np.int64).max)


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up, out=total[1:])
    return total


def _strings(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the bytes [a, b)."""
    _, down = powers(len(total) - 1)
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _smallest_within(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(data: np.ndarray, off: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, number of windows, first digit, second digit) of all runs, in steps of texts."""
    k = min(K, width)
    for a, b in steps(off):
        part = off[a : b + 1] - off[a]
        text = data[off[a] : off[b]]
        if len(text) < width:
            continue
        total = _sums(text)
        at = np.arange(len(text) - k + 1)
        digit = _smallest_within(_strings(total, at, at + k), width - k + 1)
        begin, end = part[:-1], part[1:] - width + 1
        fits = np.flatnonzero(end > begin)
        if not len(fits):
            continue
        sizes = (end - begin)[fits]
        text_of = np.repeat(fits, sizes)
        window = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[text_of]
        digit = digit[window]
        new = np.ones(len(window), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (text_of[1:] != text_of[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(window)))
        start = window[head]
        whole = _strings(total, start, start + count - 1 + width)
        yield text_of[head] + a, start - part[text_of[head]], count, digit[head], whole


def _earlier_in_batch(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the same key stands at a smaller document of the batch."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    first = d[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
    out = np.empty(len(k), bool)
    out[order] = first < d
    return out


_RUN = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()),
                  ("digit", pa.int64()), ("whole", pa.int64())])
_RUN_SQL = "doc_id long, row long, at long, windows int, digit long, whole long"
_OUT_ROWS = 200_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _emit(doc, row, at, windows, digit, whole, covered) -> Iterator[pa.RecordBatch]:
    """Rows of a batch; covered ones are merged per text and dealt by their place, with ``whole`` = 0."""
    open_, c = np.flatnonzero(~covered), np.flatnonzero(covered)
    for i in range(0, len(open_), _OUT_ROWS):
        s = open_[i : i + _OUT_ROWS]
        yield batch(_RUN, doc[s], row[s], at[s], windows[s].astype(np.int32), _signed(digit[s]), _signed(whole[s]))
    if len(c):
        new = np.ones(len(c), bool)
        new[1:] = (row[c][1:] != row[c][:-1]) | (doc[c][1:] != doc[c][:-1]) | (at[c][1:] != (at[c] + windows[c])[:-1])
        head = np.flatnonzero(new)
        long, c = np.add.reduceat(windows[c], head), c[head]
        place = mix(row[c].astype(np.uint64) + at[c].astype(np.uint64))
        for i in range(0, len(c), _OUT_ROWS):
            s = slice(i, i + _OUT_ROWS)
            yield batch(_RUN, doc[c[s]], row[c[s]], at[c[s]], long[s].astype(np.int32), _signed(place[s]), np.zeros(len(c[s]), np.int64))


def _known(rows: pa.RecordBatch) -> pa.RecordBatch:
    return rows.filter(rows.column(0).is_valid())


def _all_runs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rows = _known(rows)
            found = list(runs(*flat(rows.column(2)), width)) if rows.num_rows else []
            if not found:
                continue
            text, at, windows, digit, whole = (np.concatenate(x) for x in zip(*found))
            del found
            doc, row = (rows.column(i).to_numpy()[text] for i in (0, 1))
            whole |= np.uint64(1)  # 0 marks what is settled
            covered = _earlier_in_batch(mix(digit + whole), doc)
            yield from _emit(doc, row, at, windows, digit, whole, covered)

    return run


def _windows_of_runs(width: int):
    """The windows of the runs listed for each text; the digit of the run stays the first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = flat(rows.column(2))
            lists = rows.column(3)
            listed = lists.flatten()
            upto = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            starts, counts, digits = (listed.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            hold = []
            for i in range(rows.num_rows):
                s = slice(upto[i], upto[i + 1])
                n = counts[s].astype(np.int64)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
                key = _strings(_sums(data[off[i] : off[i + 1]]), at, at + width)
                hold.append((np.full(len(at), i), at, np.repeat(digits[s], n).view(np.uint64), key | np.uint64(1)))
            text, at, digit, whole = (np.concatenate(x) for x in zip(*hold))
            doc, row = (rows.column(i).to_numpy()[text] for i in (0, 1))
            covered = _earlier_in_batch(mix(digit + whole), doc)
            yield from _emit(doc, row, at, np.ones(len(at), np.int32), digit, whole, covered)

    return run


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = flat(rows.column(1))
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for i in range(rows.num_rows):
                text = data[off[i] : off[i + 1]]
                lists = rows.column(2)[i]
                change = np.zeros(len(text) + 1, np.int32)
                if lists.is_valid and len(lists):
                    at = lists.values.field(0).to_numpy(zero_copy_only=False)
                    n = lists.values.field(1).to_numpy(zero_copy_only=False)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n - 1 + width, -1)
                gone = np.cumsum(change)[:-1] > 0
                left = text[~gone].tobytes()
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")),
                 pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())],
                names=["doc_id", *out],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and the remaining bytes ``kept``.

    A byte goes when a ``width``-byte string over it also starts in a document with a smaller id.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("text"))  # tells texts apart that share an id

    alike, group = Window.partitionBy("digit", "whole"), Window.partitionBy("digit")

    def settled(rows: DataFrame) -> DataFrame:
        """Adds the smallest document per group of equal strings (both digits), and what its group of the first digit holds."""
        return (
            rows.repartition("digit").withColumn("first", F.min("doc_id").over(alike))
            .withColumn("low", F.min("doc_id").over(group)).withColumn("high", F.max("doc_id").over(group))
            .withColumn("kinds", F.when(F.max("whole").over(group) > F.min("whole").over(group), 2).otherwise(1))
        )

    covered = (F.col("whole") == 0) | (F.col("first") < F.col("doc_id"))
    found = settled(docs.select("doc_id", "row", "text").mapInArrow(_all_runs(width), _RUN_SQL))
    found = scratch.keep(
        found.filter(covered | ((F.col("low") < F.col("high")) & (F.col("kinds") > 1)))
        .select("doc_id", "row", "at", "windows", "digit", covered.alias("covered")), "runs")

    # runs that are the first of their kind in a group that spans documents: their windows one by one
    todo = found.filter("NOT covered").groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "windows", "digit")).alias("runs"))
    single = (
        docs.join(todo, ["doc_id", "row"]).select("doc_id", "row", "text", "runs")
        .mapInArrow(_windows_of_runs(width), _RUN_SQL).withColumn("first", F.min("doc_id").over(alike))
    )
    scratch.keep(found.filter("covered").select("doc_id", "row", "at", "windows"), "covered_runs")
    spans = scratch.keep(single.filter(covered).select("doc_id", "row", "at", "windows"), "covered_windows")
    scratch.drop("runs")
    spans = (
        scratch.read(spans, "covered_runs", "covered_windows").distinct()
        .groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "windows")).alias("spans"))
    )
    return (
        docs.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
        .mapInArrow(_kept(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
