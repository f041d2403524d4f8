"""Quality rules: plain limits, then a likelihood ratio of hashed n-grams, trusted documents against the corpus.

1. Each word has an id of 28 bits (md5); runs of one and two words fall into ``BUCKETS``
   buckets. All documents are counted as they are (the raw multinomial), documents
   labelled good and not toxic as the target.
2. A bucket's weight is ln((target + 1) / (expected + 1)) in units of 2**-16, where
   ``expected`` is its raw count scaled to the target's size, so a bucket that is rare
   anywhere says next to nothing.
3. A document's score is the sum of its n-grams' weights divided by their number,
   rounded down to a whole unit.
4. The target comes from half of the trusted documents (by hash). The threshold is the
   score that a share ``lost`` of the other half, as far as it passes the limits, stays
   below. Every document is held against this one number; nothing is drawn by lot.

The target and the threshold rest on all trusted documents that are in the table, the raw
counts on all rows. Counts are whole numbers, so the result does not depend on their order.
Trusted ids meet the texts of those rows only whose id's hash is one for fitting, and the
scores of the others: neither the ids nor the scores pass through the driver.

Rows: a null or empty text has no words and fails the limits. Null ids are never trusted;
an id with several label rows is trusted if all agree; each row is judged by its own text.
Without labels or trusted documents the limits alone decide. Other columns are
ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, batch, ship
from .textkernel import NOT_SPACE, STEP, Words, flat, joined, shingle_ranges, steps

BUCKETS = 1 << 18
UNIT = 1 << 16
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _by_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _again(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items are equal to any other, and which to an earlier one, of the same text."""
    order = np.lexsort((value, text))
    same = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, any_ = np.zeros(len(text), bool), np.zeros(len(text), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


class Kernel:
    """Everything about some texts: counts for the limits, buckets of their n-grams."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        words = Words(data, off, NOT_SPACE)
        words.low = data  # words are compared as they are
        total = words.sums()
        hashes, self.first, n = words.hashes(total=total), words.first, len(off) - 1
        self.n_words = np.diff(self.first)
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, words.start, 1)
        np.add.at(inside, words.end, -1)
        in_word = np.cumsum(inside)[:-1] > 0
        self.word_chars = _by_text(in_word & ((data & 0xC0) != 0x80), off)
        self.n_symbols = _by_text(_SYMBOL[data], off)
        self.n_dup_lines = self._dup_lines(data, off, words, total)
        self.n_repeat_words = self._repeat_words(hashes, n)
        self._hashes, self._words, self._data = hashes, words, data

    def _dup_lines(self, data, off, words, total) -> np.ndarray:
        ends = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate([off[:-1], ends + 1]))
        start = start[start < len(data)]
        end = np.append(start, len(data))[1:]
        text = np.searchsorted(off, start, side="right") - 1
        end = np.where((end > start) & (data[np.maximum(end, 1) - 1] == 10), end - 1, end)
        has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
        keep = np.flatnonzero(has_word)
        line = Words.__new__(Words)
        line.low, line.start, line.end = data, start[keep], end[keep]
        _, later = _again(text[keep], line.hashes(total=total))
        return np.bincount(text[keep][later], minlength=len(off) - 1)

    def _repeat_words(self, hashes, n) -> np.ndarray:
        runs = joined(hashes, WINDOW)
        a, b = shingle_ranges(self.first, WINDOW)
        b = np.maximum(np.minimum(b, len(runs)), np.minimum(a, len(runs)))
        count = b - np.minimum(a, len(runs))
        text = np.repeat(np.arange(n), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        twice, _ = _again(text, runs[at])
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        return _by_text(np.cumsum(cover)[:-1] > 0, self.first)

    def failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of every n-gram, and the text it belongs to."""
        _, at, code = np.unique(self._hashes, return_index=True, return_inverse=True)
        raw, start, end = self._data.tobytes(), self._words.start, self._words.end
        ids = np.array([int(hashlib.md5(raw[start[i]:end[i]]).hexdigest()[:7], 16) for i in at], np.int64)[code] if len(at) else np.empty(0, np.int64)
        text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        pair = np.flatnonzero(text[1:] == text[:-1])
        return np.concatenate([ids % buckets, (31 * ids[pair] + ids[pair + 1] + 1) % buckets]), np.concatenate([text, text[pair]])


def _kernels(texts: pa.Array) -> Iterator[tuple[int, int, Kernel]]:
    data, off = flat(texts)
    for a, b in steps(off, STEP):
        yield a, b, Kernel(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _for_fitting(doc_id: Column) -> Column:
    return F.substring(F.md5(doc_id.cast("string")), 32, 1).isin(*"02468ace")


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id): the trusted documents, each once."""
    return (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min("quality").alias("low"), F.max("toxic").alias("toxic"), F.count_if(F.col("quality").isNull() | F.col("toxic").isNull()).alias("open"))
            .filter("low = 1 AND toxic = 0 AND open = 0").select("doc_id"))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over ``rows`` (text); a task emits each of its buckets once."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in batches:
            for _, _, kernel in _kernels(part.column(0)):
                total += np.bincount(kernel.grams(buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        for k in range(0, len(used), 1 << 16):
            some = used[k : k + (1 << 16)]
            yield batch(schema, some, total[some])

    return rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def weights(raw: pa.Table, target: pa.Table, buckets: int = BUCKETS) -> np.ndarray:
    """Whole units per bucket, from (bucket, n) of all rows and of the target; at most ``buckets`` rows each come to the driver."""
    def dense(counts: pa.Table) -> np.ndarray:
        out = np.zeros(buckets)
        out[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
        return out

    raw, target = dense(raw), dense(target)
    if not target.sum():
        return np.zeros(buckets, np.int64)
    return np.rint(UNIT * np.log((target + 1) / (raw * target.sum() / raw.sum() + 1))).astype(np.int64)


BIN = 10  # bits of a score that are left out in the first look


def lowest_kept(scores: DataFrame, lost: float) -> int | None:
    """The score that a share ``lost`` of the rows stays below, exactly: first its range of 2**BIN scores, then within it.

    A score lies between logarithms of counts in units of 2**-16, so there are a few thousand ranges at most.
    """
    def counted(rows: DataFrame, by: Column) -> list[tuple[int, int]]:
        return sorted((r.at, r.n) for r in rows.groupBy(by.alias("at")).agg(F.count("*").alias("n")).collect())

    def reach(counts: list[tuple[int, int]], left: int) -> tuple[int, int]:
        for at, n in counts:
            if left < n:
                return at, left
            left -= n
        raise ValueError("fewer scores than places")

    ranges = counted(scores, F.shiftright("score", BIN))
    if not ranges:
        return None
    at, left = reach(ranges, int(lost * sum(n for _, n in ranges)))
    return reach(counted(scores.filter(F.shiftright("score", BIN) == at), F.col("score")), left)[0]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, labels: DataFrame, lost: float = 0.002, buckets: int = BUCKETS,
          id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the five counts, base_failed, n_grams, score, threshold, kept, and the columns in ``keep``."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "quality-ratio")
    known = scratch.keep(trusted(labels), "trusted")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         *(F.col(c).alias(f"_keep_{n}") for n, c in enumerate(keep)))
    # Spark broadcasts the ids while they are few; beyond that half of the texts are shuffled, none of the others
    target = narrow.filter(_for_fitting(F.col("doc_id"))).join(known, "doc_id", "left_semi")
    counts = (bucket_counts(x, buckets).toArrow() for x in (narrow, target))
    weight = weights(*counts, buckets).astype(np.int32)
    shared = spark.sparkContext.broadcast(weight)  # ``buckets`` numbers
    others = [f"_keep_{n}" for n in range(len(keep))]
    rows = narrow.select("text", "doc_id", *others)
    out = rows.drop("text").schema.add("n_words", "long").add("word_chars", "long").add("n_symbols", "long").add("n_dup_lines", "long").add(
        "n_repeat_words", "long").add("base_failed", "boolean").add("n_grams", "long").add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = shared.value.astype(np.int64)
        for part in batches:
            for a, b, kernel in _kernels(part.column(0)):
                at, text = kernel.grams(len(worth))
                n = b - a
                total = np.zeros(n, np.int64)
                np.add.at(total, text, worth[at])
                grams = np.bincount(text, minlength=n)
                score = np.floor(total / np.maximum(grams, 1)).astype(np.int64)
                made = [pa.array(getattr(kernel, c), pa.int64()) for c in _COUNTS] + [pa.array(kernel.failed()), pa.array(grams, pa.int64()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in part.columns[1:]), *made], names=out.names)

    judged = scratch.keep(rows.mapInArrow(run, out), "judged")
    held = judged.filter(~F.col("base_failed") & ~_for_fitting(F.col("doc_id"))).select("doc_id", "score").join(known, "doc_id", "left_semi")
    lowest = lowest_kept(scratch.keep(held.select("score"), "held"), lost)
    threshold = F.lit(lowest).cast("long")
    return judged.select(
        "doc_id", *_COUNTS, "base_failed", "n_grams", "score", threshold.alias("threshold"),
        (~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True))).alias("kept"),
        *(F.col(f"_keep_{n}").alias(c) for n, c in enumerate(keep)))
