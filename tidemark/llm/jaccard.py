"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

Any total order of the shingles makes prefix filtering exact; rare-first keeps the
groups small. Rarity comes from a table of counts of fixed size over all documents (a
shingle's slot), kept as a byte each, so that what is sent to the executors never grows.
Documents with equal sets are one class; the join runs over class representatives.

* Two sets with J >= t share a shingle within their first n - ceil(t n) + 1 ones.
* Length: the smaller holds at least t of the larger.
* Positional: the first shingle that two sets share, and what lies behind it in
  both, must suffice for the overlap. A pair passes at its first common shingle if
  it is a link; that it may fail at later ones costs nothing.
* Suffix: the parity of every set is kept for 512 ranges of shingles, and for as
  many ranges as shingles of a larger set; parities that differ bound the
  symmetric difference from below.

Links are wanted for components, so pairs that are known to be connected need no
check: first every group's rows meet the shortest row of their chunk and the one
before them by length, which are mostly the same for all shingles of a text (a group of
up to three rows is settled by that); then
rows of other components meet a row by chance, another one for each shingle; then,
of the rows that are still in another component than most of the group, every one
meets all rows of the group that pass the filters. Each pair is verified once, on the
whole sets. No group is enumerated, none sits in memory. Rows of groups travel as
ids, lengths and places; parities and texts only join the pairs that are left.

Rows: a null or empty text, or one without words, has ``n_shingles`` 0 and is its
own component. A null id is linked with nothing and has a null component. Rows
that share an id are one node. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import Scratch, batch, ship
from .textkernel import NOT_SPACE, Words, flat, joined, mix, shingle_ranges, steps

SLOTS = 1 << 21   # counts of the rarity table; a task's share of them is compressed, and one byte each is sent back
SLICES = 16       # it is added up in so many parts
LANES = 8         # parity bits: 8 longs of 64
CHUNK = 4096      # rows of a group that share a first row
TOKEN = (1 << 48) - 1  # bits of a shingle that its group goes by; that two shingles may share them costs a look, not a result
SIEVE = 1 << 24   # bits of the table that tells which rows need not be joined


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    data, off = flat(column)
    for a, b in steps(off):
        part = off[a : b + 1]
        words = Words(data[part[0] : part[-1]], part - part[0], NOT_SPACE)
        h = words.hashes()
        runs = joined(h, size)
        begin, end = shingle_ranges(words.first, size)
        for i in range(b - a):
            n = words.first[i + 1] - words.first[i]
            if n >= size:
                yield np.unique(runs[begin[i] : end[i]])
            else:
                yield joined(h[words.first[i] : words.first[i + 1]], n) if n else np.empty(0, np.uint64)


def _slot(sets: np.ndarray) -> np.ndarray:
    return (sets & np.uint64(SLOTS - 1)).astype(np.int64)


_COUNTS = "slice int, part int, counts binary"
_WIDTH = SLOTS // SLICES
_STEP = np.log(1.15)  # counts this far apart get another rank


def _packed(counts: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(counts.astype(np.int64).tobytes(), asbytes=True)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(counts, 8 * _WIDTH, asbytes=True), np.int64)


def rarity(docs: DataFrame, size: int, scratch: Scratch) -> np.ndarray:
    """A byte per slot, larger for shingles in more documents, on a log scale: ``SLOTS`` bytes, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for rows in batches:
            hold, n = [], 0
            for s in shingle_sets(rows.column(0), size):
                hold.append(s)
                n += len(s)
                if n > 1 << 21:
                    total += np.bincount(_slot(np.concatenate(hold)), minlength=SLOTS)
                    hold, n = [], 0
            if hold:
                total += np.bincount(_slot(np.concatenate(hold)), minlength=SLOTS)
        part = TaskContext.get().partitionId()
        schema = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
        yield batch(schema, list(range(SLICES)), [part] * SLICES, [_packed(x) for x in np.split(total, SLICES)])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(_WIDTH, np.int64)
        for x in rows["counts"]:
            total += _unpacked(x.as_py())
        return pa.table({"slice": rows["slice"].slice(0, 1), "part": pa.array([0], pa.int32()),
                         "counts": pa.array([_packed(total)], pa.binary())})

    parts = docs.select("text").mapInArrow(count, _COUNTS)
    some = parts.groupBy("slice", F.pmod("part", F.lit(64)).alias("at")).applyInArrow(add, _COUNTS)
    rank = np.zeros(SLOTS, np.uint8)
    for row in scratch.keep(some.groupBy("slice").applyInArrow(add, _COUNTS), "rarity").collect():  # SLICES rows of a fixed size
        seen = np.minimum(np.log1p(_unpacked(row["counts"])) / _STEP, 255)
        rank[row["slice"] * _WIDTH : (row["slice"] + 1) * _WIDTH] = seen.astype(np.uint8)
    return rank


_BITS = [f"b{k}" for k in range(LANES)]
_SIGNED = f"doc_id long, n int, s1 long, s2 long, {', '.join(f'{b} long' for b in _BITS)}, wide binary, prefix array<long>"


def _parities(s: np.ndarray, k: int) -> np.ndarray:
    """How many shingles each of 2^k ranges holds, modulo 2, packed."""
    return np.packbits(np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint8) & 1)


def signed_sets(docs: DataFrame, size: int, percent: int, rank: np.ndarray) -> DataFrame:
    """Per document: set size, two sums that name the set, parity bits, for sets beyond 512 as many again as shingles, and the prefix in rare-first order."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()),
                            *((b, pa.int64()) for b in _BITS), ("wide", pa.binary()), ("prefix", pa.list_(pa.int64()))])
        for rows in batches:
            n, s1, s2, bits, wide, prefix, at = [], [], [], [], [], [], [0]
            for s in shingle_sets(rows.column(1), size):
                n.append(len(s))
                scrambled = mix(s)
                s1.append(np.add.reduce(scrambled))
                s2.append(np.bitwise_xor.reduce(scrambled))
                bits.append(_parities(s, 9).view(np.int64))
                wide.append(_parities(s, (len(s) - 1).bit_length()).tobytes() if len(s) > 512 else None)
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                prefix.append(s[np.argsort(rank[_slot(s)], kind="stable")[:keep]] & np.uint64(TOKEN))
                at.append(at[-1] + keep)
            if n:
                longs = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
                yield batch(
                    schema, rows.column(0).cast(pa.int64()), pa.array(n, pa.int32()), longs(s1), longs(s2),
                    *(pa.array(x) for x in np.stack(bits).T.copy()), pa.array(wide, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.array(at, np.int32)), longs(np.concatenate(prefix))),
                )

    return docs.select("doc_id", "text").mapInArrow(sign, _SIGNED)


def _overlap(percent: int, n: Column, m: Column) -> Column:
    """Shingles in common that J >= percent/100 needs."""
    return F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))


def _may(percent: int, x: str, y: str) -> Column:
    """Length and positional filter for two rows of a group."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - i, m - j) >= _overlap(percent, n, m))


def _similar(percent: int, x: str, y: str) -> Column:
    """Length and suffix filter for two sets. Columns, not Python, so they run inside a join."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k])) for k in range(LANES)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (n + m - 2 * _overlap(percent, n, m) >= differ)


def _close(percent: int):
    """The pairs (a, b) of ``a, b, n, m, x, y`` whose wide parities do not rule them out; without them a pair stays."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            good = []
            for n, m, x, y in zip(*(rows.column(k).to_pylist() for k in range(2, 6))):
                differ = 0
                if x is not None and y is not None:
                    few, many = sorted((np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y)), key=len)
                    differ = int((few ^ np.bitwise_xor.reduce(many.reshape(len(few), -1), axis=1)).sum())
                good.append(n + m - 2 * -(-(n + m) * percent // (100 + percent)) >= differ)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return close


def sieved(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``maybe``, false only where their keys are not among ``ids``: such rows need not travel to a join with them.

    A table of ``SIEVE`` bits is broadcast, whatever the input; a fuller one lets more rows through.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SIEVE))
    mask = F.expr("shiftleft(1L, CAST(_slot & 63 AS INT))")
    table = (
        ids.select(slot.alias("_slot")).select(F.shiftright("_slot", 6).alias("_word"), mask.alias("_bit"))
        .groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    )
    placed = rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(table), "_word", "left")
    return placed.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))).drop("_slot", "_word", "_bits")


_TEXTS = "doc_id long, first int, second int, packed binary, bytes long"


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity. Only texts that occur in a pair are read again.

    What travels to a pair is the compressed text, about a quarter of its set of hashes.
    """
    sides = F.array(F.struct(F.col("a").alias("doc_id"), F.lit(1).alias("first"), F.lit(0).alias("second")),
                    F.struct(F.col("b").alias("doc_id"), F.lit(0).alias("first"), F.lit(1).alias("second")))
    ids = pairs.select(F.inline(sides)).groupBy("doc_id").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    ids = scratch.keep(ids, f"{label}_ids")
    wanted = sieved(docs.select("doc_id", "text"), ids, ["doc_id"]).filter("maybe").join(ids, "doc_id").select("doc_id", "text", "first", "second")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 6)
        for rows in batches:
            raw = [x.as_buffer() for x in rows.column(1).cast(pa.large_binary()).fill_null(b"")]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), *rows.columns[2:],
                 pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()), pa.array([x.size for x in raw], pa.int64())],
                names=["doc_id", "first", "second", "packed", "bytes"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for rows in batches:
            good = []
            for x, nx, y, ny in zip(*(rows.column(k) for k in range(2, 6))):
                both = [codec.decompress(t.as_buffer(), n.as_py(), asbytes=True) for t, n in ((x, nx), (y, ny))]
                x, y = shingle_sets(pa.array(both, pa.large_binary()), size)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = scratch.keep(wanted.mapInArrow(pack, _TEXTS), f"{label}_texts")
    return (
        # a text goes only to the side of the pairs on which it stands
        pairs.join(texts.filter("first = 1").select(F.col("doc_id").alias("a"), F.col("packed").alias("x"), F.col("bytes").alias("nx")), "a")
        .join(texts.filter("second = 1").select(F.col("doc_id").alias("b"), F.col("packed").alias("y"), F.col("bytes").alias("ny")), "b")
        .select("a", "b", "x", "nx", "y", "ny").mapInArrow(compare, "a long, b long").distinct()
    )


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links) for every row of ``docs``.

    Links: 100 * |intersection| >= percent * |union| of the sets of ``size``-word shingles.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(signed_sets(docs, size, percent, rarity(docs, size, scratch)), "signed")

    # classes of equal sets: partial minima, so a group of copies does not gather
    key = ["doc_id", "n", "s1", "s2"]  # by row: an id may have other sets
    some = signed.filter("doc_id IS NOT NULL AND n > 0")
    named = some.select(*key)
    of_class = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    copies = scratch.keep(
        named.join(of_class, ["n", "s1", "s2"]).filter("doc_id != rep").select("doc_id", "rep", "n", "s1", "s2").distinct(), "copies"
    )
    # prefixes are the bulk of a row: only those that may be copies travel to the join that settles it
    checked = sieved(some.select(*key, "prefix"), copies, key)
    spread = lambda x: x.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    first = spread(checked.filter("NOT maybe")).union(spread(checked.filter("maybe").join(copies, key, "left_anti")))

    # groups: shingles that stand in the prefix of two or more representatives; rows next to each other by length tell
    # whether a row has any partner of a length that its place allows
    group = Window.partitionBy("token")
    by_length = group.orderBy("n", "doc_id")
    shorter, longer = F.lag("n").over(by_length), F.lead("n").over(by_length)
    lined = (
        first.withColumn("partner", (shorter * 100 >= F.col("n") * percent) | (F.col("n") - F.col("pos") >= _overlap(percent, F.col("n"), longer)))
        .filter("partner").drop("partner")
        .withColumn("chunk", F.floor((F.row_number().over(by_length) - 1) / CHUNK)).withColumn("rows", F.count("*").over(group))
    )
    bits = some.select("doc_id", "n", F.array(*_BITS).alias("bits"), "wide")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def meet(rows: DataFrame, *order) -> DataFrame:
        """``head`` and ``last``: the first of a row's chunk and the one before it, in an order, where they may be linked.

        A group is in one partition already, so its chunks need no shuffle.
        """
        chunk = Window.partitionBy("token", "chunk").orderBy(*order, "doc_id")
        met = rows.withColumn("row", F.struct("doc_id", "n", "pos", "component"))
        for name, other in (("head", F.first("row")), ("last", F.lag("row"))):
            met = met.withColumn(name, other.over(chunk))
        link = lambda x: F.when((F.col("component") != F.col(f"{x}.component")) & _may(percent, "row", x), F.col(f"{x}.doc_id")).alias(x)
        return met.select(*rows.drop("component").columns, link("head"), link("last"))

    def pairs(met: DataFrame) -> DataFrame:
        return met.select("doc_id", F.explode(F.array("head", "last")).alias("other")).filter("other IS NOT NULL").select(*pair("doc_id", "other")).distinct()

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that pass the suffix filter, for large sets with as many parities as shingles; only here do they travel, once per pair."""
        wanted = sieved(bits, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), ["doc_id"]).filter("maybe")
        side = lambda name: wanted.select(F.col("doc_id").alias(name), F.struct("n", "bits", "wide").alias(f"set_{name}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(_similar(percent, "set_a", "set_b"))
        sets = near.select("a", "b", F.col("set_a.n"), F.col("set_b.n").alias("m"), F.col("set_a.wide").alias("x"), F.col("set_b.wide").alias("y"))
        return sets.mapInArrow(_close(percent), "a long, b long").distinct()

    def split_groups(rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows with their components, of the groups that still hold several."""
        placed = (
            rows.drop("head", "last").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("component", F.coalesce("component", "doc_id"))
        )
        ends = [F.min("component").over(group), F.max("component").over(group)]
        return placed.withColumn("mixed", ends[0] < ends[1]).filter("mixed").drop("mixed")

    groups = scratch.keep(meet(lined.withColumn("component", F.col("doc_id")), "n"), "groups")
    near = scratch.keep(pairs(groups), "met_near")
    near = scratch.keep(similar(near), "pairs_near")
    links = scratch.keep(verified(docs, near, size, percent, scratch, "near"), "links_near")
    scratch.drop("near_texts", "near_ids", "met_near")
    # of up to three rows all have met; links only join components: a group that is whole now stays so
    known = components(links, Scratch(spark, "jaccard-near"))
    mixed = scratch.keep(meet(split_groups(groups.filter("rows > 3").drop("rows"), known), F.xxhash64("token", "doc_id")), "mixed")
    scratch.drop("groups")
    by_chance = scratch.keep(pairs(mixed).join(near, ["a", "b"], "left_anti"), "met_chance")
    by_chance = scratch.keep(similar(by_chance), "pairs_chance")
    by_chance = scratch.keep(verified(docs, by_chance, size, percent, scratch, "chance"), "links_chance")
    scratch.drop("chance_texts", "chance_ids", "met_chance")
    stars = lambda known: known.select(F.col("node").alias("a"), F.col("component").alias("b"))  # noqa: E731  # in place of the links they stand for
    known = components(stars(known).union(by_chance), Scratch(spark, "jaccard-chance"))

    # what is not in the main component of its group meets the whole group
    split = split_groups(mixed, known).withColumn("rows", F.count("*").over(Window.partitionBy("token", "component")))
    split = split.withColumn("main", F.max(F.struct("rows", "component")).over(group)["component"])
    split = scratch.keep(split.select("doc_id", "n", "pos", "token", "component", "main"), "split")
    scratch.drop("mixed")
    full = split.join(bits.select("doc_id", F.col("n").alias("size"), "bits"), "doc_id").filter("n = size")
    row = F.struct("doc_id", "n", "pos", "bits")
    odd = full.filter("component != main").select("token", row.alias("x"), F.col("component").alias("cx"))
    rest = full.select("token", row.alias("y"), F.col("component").alias("cy"))
    left = (
        odd.join(rest, (odd["token"] == rest["token"]) & (F.col("cx") != F.col("cy")) & _may(percent, "x", "y") & _similar(percent, "x", "y"))
        .select(*pair("x.doc_id", "y.doc_id")).distinct()
    )
    left = scratch.keep(left, "pairs_left")
    left = left.join(scratch.read(near, "pairs_near", "pairs_chance"), ["a", "b"], "left_anti")
    left = scratch.keep(similar(left), "left")
    far = scratch.keep(verified(docs, left, size, percent, scratch, "left"), "links_far")
    found = components(stars(known).union(far).union(copies.select("rep", "doc_id")), scratch)
    return (
        signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
