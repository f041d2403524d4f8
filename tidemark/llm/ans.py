"""Token ids as files: static range asymmetric numeral system over blocks of documents.

A store is a folder of three tables, written and read by Spark:

* ``model``: one row per token id that occurs, with its share of 2**PRECISION. It is
  counted over all documents and shared by all blocks.
* ``blocks``: whole documents in ascending id order, about ``BLOCK`` ids each. A
  block is coded on its own by interleaved lanes (id i goes to lane i mod lanes);
  ``states`` are the lanes' checkpoints, ``words`` the common stream, ``crc32`` the
  checksum of the decoded ids. ``part`` and ``before`` give its place.
* ``parts``: the number of ids before each part, one row per write task.

Any block can be read alone, so decoding is as parallel as there are blocks. A
coder step handles one id of every lane with numpy; there is no step per id.

Encoding: the text is cut before single spaces between two solid characters,
where the tokenizer's split always starts anew; equal cuts have equal ids, so each
distinct one goes through the tokenizers library once per worker while it is
remembered. The result does not depend on what is remembered.

Strings of special tokens in a text are treated as the library treats them: one id each.

Rows: a null or empty text holds only the end id. Null ids sort first and rows
that share an id by the hash of their text. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .store import Scratch, batch, ship
from .textkernel import flat, steps

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BLOCK = 1 << 17       # ids after which a block is closed
LANES = 512
PRECISION = 20        # shares add up to 2**20
LOW = np.uint64(1 << 31)
REMEMBERED = 3 << 19  # distinct cuts a worker remembers
STEP = 16 << 20       # bytes of text encoded at once

# ---------------------------------------------------------------- tokens

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)      # first byte of a two-byte letter; none of these is white space
_LEAD[0xC3:0xE0] = True
_NEXT = np.zeros(256, bool)
_NEXT[0x80:0xC0] = True


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a solid character ends right before each position (at >= 1)."""
    last = data[at - 1]
    return _SOLID[last] | (_NEXT[last] & _LEAD[data[np.maximum(at - 2, 0)]])


class Encoder:
    """Ids of many texts. Lives as long as its Python worker."""

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain  # the strings of special tokens are then ordinary text
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.zeros(self.size, np.int64)   # bytes of each id: one character of its name per byte
        for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(name)
        self.forget()

    def forget(self) -> None:
        self.cuts = pa.array([], pa.large_binary())
        self.ids, self.off = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, cuts: pa.Array) -> None:
        """Ids of new distinct cuts. Those that begin with a space before, and end in, a solid character may stand in a row."""
        data, off = flat(cuts)
        first, end = off[:-1], off[1:]
        long = end - first >= 2
        second = data[np.minimum(first + 1, len(data) - 1)]
        row = long & (data[np.minimum(first, len(data) - 1)] == 32) & (_SOLID[second] | _LEAD[second])
        row &= _solid_before(data, np.maximum(end, 1))
        chosen, alone = np.flatnonzero(row), np.flatnonzero(~row)
        in_row, apart = cuts.take(pa.array(chosen)), cuts.take(pa.array(alone))
        data, off = flat(in_row)
        got: list[np.ndarray] = [np.empty(0, np.uint32)]
        for a, b in steps(off, 1 << 12):  # the library is fastest on short texts without positions
            text = data[off[a] : off[b]].tobytes().decode()
            got.append(np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        # ids cover the bytes one after the other, and none reaches over the end of a cut
        upto = np.searchsorted(np.cumsum(self.width[np.concatenate(got)]), off[1:]) + 1
        count = [np.diff(upto, prepend=0)]
        apart_texts = [x.decode() for x in apart.to_pylist()]
        for a in range(0, len(apart_texts), 1024):
            for x in self.tokenizer.encode_batch_fast(apart_texts[a : a + 1024], add_special_tokens=False):
                got.append(np.asarray(x.ids, np.uint32))
                count.append(np.array([len(x.ids)]))
        if len(self.cuts) + len(cuts) > REMEMBERED:
            self.forget()
        self.cuts = pa.concat_arrays([self.cuts, in_row, apart])
        self.ids = np.concatenate([self.ids, *got])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.concatenate(count))])

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, ``end_id`` after each text, and their offsets by text."""
        space = np.flatnonzero(data == 32)
        inner = np.ones(len(data) + 1, bool)
        inner[off] = False               # not the first byte of a text
        inner[np.maximum(off - 1, 0)] = False  # nor the last
        space = space[inner[space]]
        after = data[space + 1]
        space = space[_solid_before(data, space) & (_SOLID[after] | _LEAD[after])]
        start = np.sort(np.concatenate([off[:-1][np.diff(off) > 0], space]), kind="stable")  # two sorted lists, none twice
        bounds = np.append(start, len(data)).astype(np.int64)
        cuts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = cuts.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.cuts)
        if known.null_count:
            if len(self.cuts) + known.null_count > REMEMBERED:
                self.forget()
                self._learn(coded.dictionary)
            else:
                self._learn(coded.dictionary.filter(known.is_null()))
            known = pc.index_in(coded.dictionary, value_set=self.cuts)
        at = known.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()].astype(np.int64)
        count = self.off[at + 1] - self.off[at]
        total = np.append(0, np.cumsum(count))
        text = np.searchsorted(off, start, side="right") - 1
        source = np.arange(total[-1]) + np.repeat(self.off[at] - total[:-1], count)
        ids = np.full(total[-1] + len(off) - 1, end_id, np.uint32)
        ids[np.arange(total[-1]) + np.repeat(text, count)] = self.ids[source]
        return ids, total[np.searchsorted(start, off)] + np.arange(len(off))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


# ---------------------------------------------------------------- coder


def shares(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Whole shares of 2**precision, at least 1 for every id that occurs; the same for equal counts everywhere."""
    total = 1 << precision
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    if 2 * len(seen) > total:
        raise ValueError("more distinct ids than the precision can tell apart")
    out[seen] = np.maximum(1, np.floor(counts[seen] * (total / counts[seen].sum())).astype(np.int64))
    by_size = seen[np.lexsort((seen, -out[seen]))]
    excess = int(out.sum()) - total
    while excess > 0:
        for i in by_size:
            less = min(excess, int(out[i]) // 2)
            out[i] -= less
            excess -= less
            if not excess:
                break
    out[by_size[0]] -= excess
    return out


class Coder:
    """Shares with their running sums, and the id of every slot."""

    def __init__(self, share: np.ndarray, precision: int = PRECISION):
        self.precision = precision
        self.share = share.astype(np.uint64)
        self.below = (np.cumsum(share) - share).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(share), dtype=np.uint32), share)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, words): the lanes start at LOW with the last ids; the words stand in reading order."""
        lanes = max(1, min(LANES, len(ids) // 16))
        x, hold = np.full(lanes, LOW), []
        bits, room = np.uint64(self.precision), np.uint64(63 - self.precision)
        for at in reversed(range(0, len(ids), lanes)):
            s = ids[at : at + lanes]
            f, y = self.share[s], x[: len(s)]
            full = y >= f << room
            hold.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            y = np.where(full, y >> np.uint64(32), y)
            whole = y // f
            x[: len(s)] = (whole << bits) + (y - whole * f) + self.below[s]
        return x, np.concatenate(hold[::-1]) if hold else np.empty(0, "<u4")

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        lanes, x = len(states), states.copy()
        out, pos = np.empty(n, np.uint32), 0
        bits, mask = np.uint64(self.precision), np.uint64((1 << self.precision) - 1)
        for at in range(0, n, lanes):
            y = x[: min(lanes, n - at)]
            slot = y & mask
            s = self.slots[slot]
            out[at : at + len(y)] = s
            y = self.share[s] * (y >> bits) + slot - self.below[s]
            low = y < LOW
            more = int(np.count_nonzero(low))
            y[low] = (y[low] << np.uint64(32)) | words[pos : pos + more]
            pos += more
            x[: len(y)] = y
        if pos != len(words) or (x != LOW).any():
            raise ValueError("damaged block: the lanes do not end where they began")
        return out


# ---------------------------------------------------------------- the store

_PLAIN = "part int, block int, before long, doc_ids array<long>, counts array<long>, ids binary"
_BLOCK = ("part int, block int, before long, doc_ids array<long>, counts array<long>, n_ids long, "
          "states binary, words binary, crc32 long")


def _tokenized(path: str, end_id: int, block: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        narrow = np.uint16 if coder.size <= 1 << 16 else np.uint32
        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        hold: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal number, before, size
            row = batch(schema, [part], [number], [before], pa.array([docs], pa.list_(pa.int64())),
                        pa.array([[len(x) for x in hold]], pa.list_(pa.int64())), [np.concatenate(hold).astype(narrow).tobytes()])
            number, before, size = number + 1, before + size, 0
            docs.clear()
            hold.clear()
            return row

        for rows in batches:
            data, off = flat(rows.column(1))
            names = rows.column(0).to_pylist()
            for a, b in steps(off, STEP):
                ids, upto = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a], end_id)
                for i in range(b - a):
                    docs.append(names[a + i])
                    hold.append(ids[upto[i] : upto[i + 1]])
                    size += len(hold[-1])
                    if size >= block:
                        yield closed()
        if docs:
            yield closed()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 0, block: int = BLOCK,
                id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, ``end_id`` after each, and write the store below ``path``."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "ans")
    placed = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    plain = scratch.keep(placed.mapInArrow(_tokenized(tokenizer, end_id, block), _PLAIN), "plain")
    size = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    narrow = np.uint16 if size <= 1 << 16 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for rows in batches:
            for ids in rows.column(0):
                seen += np.bincount(np.frombuffer(ids.as_buffer(), narrow), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["id", "seen"])

    counted = plain.select("ids").mapInArrow(count, "id int, seen long").groupBy("id").agg(F.sum("seen").alias("seen"))
    counts = np.zeros(size, np.int64)
    for row in counted.collect():  # one row per id of the vocabulary at most
        counts[row["id"]] = row["seen"]
    share = shares(counts)
    used = np.flatnonzero(share)
    spark.createDataFrame([(int(i), int(share[i])) for i in used], "id int, share int").coalesce(1).write.parquet(f"{path}/model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(share)
        for rows in batches:
            n, states, words, crc = [], [], [], []
            for raw in rows.column(5):
                ids = np.frombuffer(raw.as_buffer(), narrow)
                x, w = coder.encode(ids)
                n.append(len(ids))
                states.append(x.astype("<u8").tobytes())
                words.append(w.tobytes())
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:5], pa.array(n, pa.int64()), pa.array(states, pa.binary()), pa.array(words, pa.binary()), pa.array(crc, pa.int64())],
                names=["part", "block", "before", "doc_ids", "counts", "n_ids", "states", "words", "crc32"])

    plain.mapInArrow(encode, _BLOCK).write.parquet(f"{path}/blocks")
    scratch.drop("plain")
    blocks = spark.read.parquet(f"{path}/blocks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per write task
    (
        blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ``ids`` (little-endian unsigned 32-bit) of every document of a store.

    A block whose checksum or lanes are wrong raises.
    """
    ship(spark)
    rows = spark.read.parquet(f"{path}/model").collect()  # one row per id of the vocabulary at most
    share = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        share[r["id"]] = r["share"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(share)
        for rows in batches:
            for i in range(rows.num_rows):
                first, docs, counts, n, states, words, crc = (c[i] for c in rows.columns)
                ids = coder.decode(n.as_py(), np.frombuffer(states.as_buffer(), "<u8"), np.frombuffer(words.as_buffer(), "<u4")).astype("<u4")
                if zlib.crc32(ids.tobytes()) != crc.as_py():
                    raise ValueError("damaged block: wrong checksum")
                size = counts.values.to_numpy()
                upto = np.append(0, np.cumsum(size))
                raw = [ids[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:])]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(first.as_py() + upto[:-1]), counts.values,
                     pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # the table of parts has one row per write task, a number set by configuration
    placed = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")
    return placed.select((F.col("start") + F.col("before")).alias("first"), "doc_ids", "counts", "n_ids", "states", "words", "crc32").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
