"""Two tokenizers over the same texts: which tokens overlap, where both end, how common each link is.

A is byte-level BPE (tokenizers library), B a piece model (sentencepiece). Both read
space + text, so their tokens cover the same bytes. A batch of documents is merged in
lockstep: one state vector holds the pointer into A and into B of every document (long
ones in stretches of ``STRETCH`` A tokens, each begun at the B token that holds its first
byte). A step emits one link per live state, moves the pointer of the token that ends
first, or both, which is a cut; states that are through are compacted away.

The path of a document, one code per link (1: A moves, 2: B moves, 3: both, a cut), holds
links and groups in order.

Counts. A block of documents names its distinct id pairs once, with the number of its
documents that hold them. These are summed by pair over the corpus; the sums come back
once per block and pair and meet the block's documents, which wait in sparse rows
(place in the block's list, multiplicity). No text and no token crosses the network.

Rows: null and empty texts, and texts that either tokenizer does not give back byte by
byte, have no tokens: zeros and ''. Rows that share an id, repeated rows and null ids
stay apart. Strings of special tokens are ordinary text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ans import encoder
from .store import Scratch, ship
from .textkernel import flat, steps

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
MODEL_B = public_tokenizers.path("piece_bpe_32k.model")
STRETCH = 256         # A tokens that one state walks
STEP = 4 << 20        # bytes of text merged at once (a longer text alone)
BLOCK = 16 << 20      # bytes of text whose pairs are named together
_PAIRS = 1 << 32      # a pair is a * _PAIRS + b


def _byte_of_letter() -> dict[str, int]:
    """The alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Side:
    """Bytes and printed forms of one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.off = np.cumsum([0, *map(len, tokens)])
        self.width = np.diff(self.off)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.text = {sep: np.array([sep + str(i) for i in range(len(tokens))], object) for sep in ("", ",", ";", "|")}

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.width[ids]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.off[ids], size)
        return self.data[at]


class Pair:
    """Both tokenizers. Lives as long as its Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.coder = encoder(path_a, plain=True)
        letters = _byte_of_letter()
        names = [b""] * self.coder.size
        for name, i in self.coder.tokenizer.get_vocab(with_added_tokens=True).items():
            names[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.a = Side(names)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets by text, of A over space + text and of B over text."""
        raw = data.tobytes()
        texts = [raw[off[i] : off[i + 1]].decode() for i in range(len(off) - 1)]
        spaced, upto = np.insert(data, off[:-1], 32), off + np.arange(len(off))
        ids_a, off_a = self.coder.encode(spaced, upto, 0)
        end = np.zeros(len(ids_a), bool)
        end[off_a[1:] - 1] = True  # the coder's end marks
        ids_a, off_a = ids_a[~end], off_a - np.arange(len(off_a))
        coded = [np.asarray(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]
        return ids_a, off_a, np.concatenate([*coded, np.empty(0, np.uint32)]), np.cumsum([0, *map(len, coded)])


_pairs: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, off_a: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of token sequences in a row that cover the same bytes: A index, B index, code, in order.

    ``end_a`` and ``end_b`` are the byte positions after each token, ``off_a`` where each
    document begins among the A tokens.
    """
    size = np.diff(off_a)
    parts = -(-size // stretch)
    doc = np.repeat(np.arange(len(size)), parts)
    i = off_a[:-1][doc] + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * stretch
    stop = np.minimum(i + stretch, off_a[1:][doc])
    j = np.searchsorted(end_b, np.where(i > 0, end_a[np.maximum(i, 1) - 1], 0), side="right")
    # both pointers together grow with every step, so i + j is a link's place in the path
    code, first = np.zeros(len(end_a) + len(end_b), np.uint8), np.zeros(len(end_a) + len(end_b), np.int32)
    while len(i):
        a, b = end_a[i], end_b[j]
        move_a, move_b = a <= b, b <= a
        code[i + j], first[i + j] = move_a + 2 * move_b, i
        i, j = i + move_a, j + move_b
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    at = np.flatnonzero(code)
    link_a = first[at].astype(np.int64)
    return link_a, at - link_a, code[at]


class Merged:
    """Some texts, encoded and merged. Texts without tokens have empty ranges."""

    def __init__(self, two: Pair, data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        ids_a, off_a, ids_b, off_b = two.encode(data, off)
        want = np.diff(off) + 1
        size = lambda side, ids, upto: np.diff(np.concatenate([[0], np.cumsum(side.width[ids])])[upto])
        good = (np.diff(off) > 0) & (size(two.a, ids_a, off_a) == want) & (size(two.b, ids_b, off_b) == want)
        good &= self._same(two, data, off, good, ids_a, off_a, ids_b, off_b)
        self.ids_a, self.off_a = self._only(good, ids_a, off_a)
        self.ids_b, self.off_b = self._only(good, ids_b, off_b)
        self.good = good
        self.link_a, self.link_b, self.code = lockstep(np.cumsum(two.a.width[self.ids_a]), np.cumsum(two.b.width[self.ids_b]), self.off_a)
        self.off_link = np.searchsorted(self.link_a, self.off_a)
        cut = np.concatenate([[0], np.cumsum(self.code == 3)])
        self.n_groups = np.diff(cut[self.off_link])
        self.n = n

    @staticmethod
    def _only(good, ids, off):
        size = np.where(good, np.diff(off), 0)
        return ids[np.repeat(good, np.diff(off))], np.concatenate([[0], np.cumsum(size)])

    @classmethod
    def _same(cls, two, data, off, good, ids_a, off_a, ids_b, off_b) -> np.ndarray:
        """Which texts of right length have the right bytes on both sides."""
        out = np.zeros(len(good), bool)
        if not good.any():
            return out
        spaced, upto = np.insert(data, off[:-1], 32), off + np.arange(len(off))
        text, at = cls._only(good, spaced, upto)
        wrong = np.zeros(len(text), bool)
        for side, ids, o in ((two.a, ids_a, off_a), (two.b, ids_b, off_b)):
            wrong |= side.spell(cls._only(good, ids, o)[0]) != text
        bad = np.concatenate([[0], np.cumsum(wrong)])
        return good & (np.diff(bad[at]) == 0)

    def groups(self, two: Pair) -> list[str]:
        """Per text ``a1,a2|b1;a3|b2``."""
        cut = np.flatnonzero(self.code == 3)
        upto_a, upto_b = self.link_a[cut] + 1, self.link_b[cut] + 1  # tokens up to each cut
        group_a = np.repeat(np.arange(len(cut)), np.diff(upto_a, prepend=0))
        group_b = np.repeat(np.arange(len(cut)), np.diff(upto_b, prepend=0))
        place_a = np.arange(len(self.ids_a)) + np.concatenate([[0], upto_b])[group_a]
        place_b = np.arange(len(self.ids_b)) + upto_a[group_b]
        first_a, first_b = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
        out = np.empty(len(self.ids_a) + len(self.ids_b), object)
        out[place_a] = two.a.text[","][self.ids_a]
        out[place_b] = two.b.text[","][self.ids_b]
        if len(cut):
            out[place_a[first_a]] = two.a.text[";"][self.ids_a[first_a]]
            out[place_b[first_b]] = two.b.text["|"][self.ids_b[first_b]]
        start = self.off_a[:-1][self.good]
        out[place_a[start]] = two.a.text[""][self.ids_a[start]]
        off = (self.off_a + self.off_b).tolist()
        return ["".join(out[off[i] : off[i + 1]].tolist()) for i in range(self.n)]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text: text, pair, multiplicity; by text, then pair."""
        text = np.repeat(np.arange(self.n, dtype=np.int64), np.diff(self.off_link))
        a, b = self.ids_a[self.link_a].astype(np.int64), self.ids_b[self.link_b].astype(np.int64)
        span_b = int(b.max(initial=0)) + 1
        span = (int(a.max(initial=0)) + 1) * span_b
        code, times = np.unique((text * span) + a * span_b + b, return_counts=True)
        left = code % span
        return code // span, (left // span_b) * _PAIRS + left % span_b, times


class Block:
    """Sparse rows of documents over the distinct pairs that they hold."""

    def __init__(self, number: int):
        self.number, self.bytes, self.docs, self.parts = number, 0, 0, []

    def add(self, texts: int, size: int, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        text, key, times = rows
        distinct, place, holding = np.unique(key, return_inverse=True, return_counts=True)
        self.parts.append((distinct, holding, place.astype(np.uint32), times.astype(np.uint32), np.bincount(text, minlength=texts).astype(np.uint32)))
        self.bytes += size
        self.docs += texts

    def close(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Pairs, documents that hold each, and the sparse rows: counts per document, places, multiplicities."""
        keys = np.unique(np.concatenate([p[0] for p in self.parts]))
        holding, places = np.zeros(len(keys), np.int64), []
        for distinct, held, place, _, _ in self.parts:
            at = np.searchsorted(keys, distinct)
            holding[at] += held
            places.append(at[place])
        per = np.concatenate([p[4] for p in self.parts])
        place, times = np.concatenate(places), np.concatenate([p[3] for p in self.parts])
        step = np.diff(place, prepend=0)  # ascending within a document: small steps pack well
        raw = b"".join(x.tobytes() for x in (np.array([len(per), len(place)], np.int64), per, step.astype("<i4"), times))
        return keys, holding, np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def read(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = int(np.frombuffer(packed, np.int64, 1)[0])
        raw = pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True)
        docs, n = np.frombuffer(raw, np.int64, 2)
        per = np.frombuffer(raw, np.uint32, docs, 16)
        step = np.frombuffer(raw, "<i4", n, 16 + 4 * docs)
        return per, np.cumsum(step, dtype=np.int64), np.frombuffer(raw, np.uint32, n, 16 + 4 * docs + 4 * n)


def _texts(rows: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = flat(rows.column(1))
    for a, b in steps(off, STEP):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def align(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = MODEL_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, a_ids, b_ids, the tokens of every link (link_a, link_b: positions), cut_a, cut_b (tokens before each cut), groups."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b")), ("groups", pa.string())])

    def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair(path_a, path_b)
        for rows in batches:
            for a, b, data, off in _texts(rows):
                m = Merged(two, data, off)
                text = np.repeat(np.arange(m.n), np.diff(m.off_link))
                cut = np.flatnonzero(m.code == 3)
                off_cut = np.concatenate([[0], np.cumsum(m.n_groups)])
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).slice(a, b - a), lists(m.ids_a, m.off_a), lists(m.ids_b, m.off_b),
                    lists(m.link_a - m.off_a[text], m.off_link), lists(m.link_b - m.off_b[text], m.off_link),
                    lists(m.link_a[cut] + 1 - m.off_a[text[cut]], off_cut), lists(m.link_b[cut] + 1 - m.off_b[text[cut]], off_cut),
                    pa.array(m.groups(two), pa.string())], schema=schema)

    ship(docs.sparkSession)
    return _narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cut_a array<int>, cut_b array<int>, groups string")


_ROWS = pa.schema([
    ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("holding", pa.list_(pa.int64())), ("rows", pa.binary())])
_SQL = ("block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "pairs array<long>, holding array<long>, rows binary")


def _column(field: pa.Field, values, n: int) -> pa.Array:
    return pa.nulls(n, field.type) if values is None else values if isinstance(values, pa.Array) else pa.array(values, field.type)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document (place not null) and one per block of documents (place null)."""

    def emit(n: int, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column(f, values.get(f.name), n) for f in _ROWS], schema=_ROWS)

    def closed(block: Block) -> pa.RecordBatch:
        pairs, holding, rows = block.close()
        return emit(1, block=[block.number], pairs=[pairs], holding=[holding], rows=[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair(path_a, path_b)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        block = Block(number)
        for rows in batches:
            for a, b, data, off in _texts(rows):
                m, n = Merged(two, data, off), b - a
                yield emit(n, block=np.full(n, block.number), place=np.arange(block.docs, block.docs + n), doc_id=rows.column(0).slice(a, n),
                           n_a=np.diff(m.off_a), n_b=np.diff(m.off_b), n_groups=m.n_groups, n_links=np.diff(m.off_link), groups=m.groups(two))
                block.add(n, len(data), m.keys())
                if block.bytes >= BLOCK:
                    yield closed(block)
                    block = Block(block.number + 1)
        if block.docs:
            yield closed(block)

    return docs.mapInArrow(run, _SQL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair, and whether no pair of the same A id is held by more."""
    named = blocks.filter("place IS NULL").select(F.explode(F.arrays_zip("pairs", "holding")).alias("x")).select(
        F.col("x.pairs").alias("pair"), F.col("x.holding").alias("held"))
    counts = named.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = MODEL_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "cross-tokens")
    found = aligned_blocks(_narrow(docs, id_col, text_col), path_a, path_b)
    groups = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    blocks = scratch.keep(found.withColumn("groups_sha256", groups).drop("groups"), "blocks")
    counts = scratch.keep(pair_counts(blocks), "counts")
    asked = scratch.read(blocks, "blocks").filter("place IS NULL").select("block", F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select("block", "pair", "count", "best")
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def gather(rows: pa.Table, answer: pa.Table) -> pa.Table:
        order = np.argsort(answer.column("pair").to_numpy())
        count = answer.column("count").to_numpy()[order].astype(np.int64)
        best = answer.column("best").to_numpy()[order].astype(np.int64)
        out = []
        for number, packed in zip(rows.column("block").to_pylist(), rows.column("rows").to_pylist()):
            per, place, times = Block.read(packed)
            upto = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
            by_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(times * x[place], dtype=np.int64)])[upto])
            n = len(per)
            out.append(pa.Table.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(by_doc(best)), pa.array(by_doc(count))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    waiting = blocks.filter("place IS NULL").select("block", "rows")
    sums = waiting.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(gather, "block long, place int, n_best long, count_sum long")
    sums = scratch.keep(sums, "sums").select(F.col("block").alias("_block"), F.col("place").alias("_place"), "n_best", "count_sum")
    rows = blocks.filter("place IS NOT NULL").join(sums, (F.col("block") == F.col("_block")) & (F.col("place") == F.col("_place")))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
