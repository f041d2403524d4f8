"""Benchmark passages in documents: prefix-filtered join of shingles, verified window by window.

A window is ``window`` consecutive words of an item (all words of a shorter item).
A document holds it exactly if it holds all its shingles in a row, so one shingle
is a necessary prefix: the rarest one of the window, counted over all documents.

1. Documents are read once. A word run is kept where a bit table of fixed size says
   that a benchmark shingle may stand there; its words go along.
2. Those runs are joined with the windows' rarest shingles. The place of the shingle
   gives the place of the window, which must fit into the document.
3. Every shingle of such a window is looked up at its place, by its words.

The bit table is all that is sent to the executors, whatever the benchmark's size.

Rows: a null or empty text has no words and is never contaminated. Null ids are
kept. Rows equal in id and text give equal rows. Items without id or words are
ignored; items that share an id count once. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, ship
from .textkernel import LETTERS, Words, flat, joined, shingle_ranges, steps

SHINGLE = 5
BITS = 22  # the table has 2**22 bits, half a megabyte


def _words_of(rows: pa.RecordBatch, column: int) -> Iterator[tuple[int, Words]]:
    data, off = flat(rows.column(column))
    for a, b in steps(off):
        part = off[a : b + 1]
        yield a, Words(data[part[0] : part[-1]], part - part[0], LETTERS)


def _text(words: Words, first: int, n: int) -> str:
    return b" ".join(words.low[words.start[i] : words.end[i]].tobytes() for i in range(first, first + n)).decode()


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """A row per item, window and shingle in it: the window's words as its key, its length, the shingle's place, hash and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {"item_id": [], "win": [], "length": [], "grams": [], "place": [], "token": [], "words": []}
            names = rows.column(0).to_pylist()
            for a, words in _words_of(rows, 1):
                h = words.hashes()
                for i in range(len(words.first) - 1):
                    n = int(words.first[i + 1] - words.first[i])
                    length, size = min(window, n), min(shingle, n)
                    for at in range(int(words.first[i]), int(words.first[i + 1]) - length + 1) if n else ():
                        key = _text(words, at, length)
                        tokens = joined(h[at : at + length], size).view(np.int64)
                        for k, token in enumerate(tokens.tolist()):
                            for name, v in zip(out, (names[a + i], key, length, size, k, token, _text(words, at + k, size))):
                                out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()))],
                names=list(out))

    return items.mapInArrow(run, "item_id long, win string, length int, grams int, place int, token long, words string")


def _bit_table(tokens: DataFrame) -> np.ndarray:
    slot = F.col("token").bitwiseAND((1 << BITS) - 1)
    table = np.zeros(1 << (BITS - 6), np.int64)
    filled = tokens.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    for row in filled.collect():  # 65,536 rows at most
        table[row["at"]] = row["bits"]
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


_READ = "doc_id long, row long, n_words long, hits array<struct<pos:int,token:long,words:string>>"


def _hits(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    packed = np.packbits(table)
    kept = docs.columns[3:]
    passed = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        mask = np.uint64((1 << BITS) - 1)
        kind = pa.struct([("pos", pa.int32()), ("token", pa.int64()), ("words", pa.string())])
        for rows in batches:
            n_words, pos, token, text, upto = [], [], [], [], [0]
            for _, words in _words_of(rows, 2):
                h = words.hashes()
                found = []
                for size in sizes:
                    runs = joined(h, size)
                    at = np.flatnonzero(bits[(runs & mask).astype(np.int64)])
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    inside = at + size <= words.first[doc + 1]
                    found.append((doc[inside], at[inside], runs[at[inside]], np.full(inside.sum(), size)))
                doc, at, runs, size = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 4
                order = np.lexsort((at, doc))
                doc, at, runs, size = doc[order], at[order], runs[order], size[order]
                pos += (at - words.first[doc]).tolist()
                token += runs.astype(np.uint64).view(np.int64).tolist()
                text += [_text(words, int(x), int(n)) for x, n in zip(at, size)]
                n_words += np.diff(words.first).tolist()
                upto += (upto[-1] + np.cumsum(np.bincount(doc, minlength=len(words.first) - 1))).tolist()
            values = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(token, pa.int64()), pa.array(text, pa.string())], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values),
                 *rows.columns[3:]], names=["doc_id", "row", "n_words", "hits", *kept])

    return docs.mapInArrow(run, _READ + passed)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, shingle: int = SHINGLE,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated: n_hit > 0 and share * n_hit >= n_words.

    ``keep_cols`` passes columns of the row on.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "decontam")
    kept = [f"_keep{i}" for i in range(len(keep_cols))]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(k) for c, k in zip(keep_cols, kept)])
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text", *kept)
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))

    parts = scratch.keep(item_windows(items.filter("item_id IS NOT NULL"), window, shingle), "windows")
    grams = parts.drop("item_id").distinct()
    sizes = sorted(r["grams"] for r in parts.select("grams").distinct().collect())  # at most ``shingle`` numbers
    read = scratch.keep(_hits(docs, _bit_table(parts), sizes), "read")

    hits = read.select("doc_id", "row", "n_words", F.inline("hits")).distinct()
    seen = hits.groupBy("token", "words").agg(F.count("*").alias("seen"))
    rarest = Window.partitionBy("win").orderBy("seen", "token", "place")
    prefix = (
        grams.join(seen, ["token", "words"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        .withColumn("nth", F.row_number().over(rarest)).filter("nth = 1 AND seen > 0")
        .select("win", "length", "grams", "place", "token", "words")
    )
    placed = (
        hits.join(prefix, ["token", "words"])
        .withColumn("start", F.col("pos") - F.col("place"))
        .filter("start >= 0 AND start + length <= n_words")
        .select("doc_id", "row", "win", "length", "grams", "start").distinct()
    )
    wanted = placed.join(grams.select("win", "place", "token", "words"), "win").withColumn("pos", F.col("start") + F.col("place"))
    there = hits.select(F.col("doc_id").alias("d"), "row", "pos", "token", "words")
    whole = (
        wanted.join(there, ["row", "pos", "token", "words"]).filter(F.col("doc_id").eqNullSafe(F.col("d")))
        .groupBy("doc_id", "row", "win", "length", "grams", "start").agg(F.count("*").alias("found"))
        .filter("found = length - grams + 1")
    )
    whole = scratch.keep(whole.select("doc_id", "row", "win", "length", "start"), "whole")

    covered = whole.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select(
        "doc_id", "row",
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
        .cast("long").alias("n_hit"))
    held = (
        whole.select("doc_id", "row", "win").distinct().join(parts.select("win", "item_id").distinct(), "win")
        .groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = covered.alias("c").join(held.alias("h"), F.expr("c.row = h.row AND c.doc_id <=> h.doc_id")).selectExpr(
        "c.doc_id AS found_id", "c.row AS found_row", "n_hit", "items")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return read.join(found, (F.col("row") == F.col("found_row")) & F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        *[F.col(k).alias(c) for c, k in zip(keep_cols, kept)],
    )
