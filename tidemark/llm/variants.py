"""Spelling variants: words one letter apart, found in a trie of letter-group counts.

Letters are dealt to ``GROUPS`` groups of about equal weight. A word's path is its length
and then how many of its letters fall into each group. One inserted, deleted or
replaced letter changes the path by at most one more in one group and one less in another,
so a depth-first search follows, from each word, only branches within a budget
of one surplus and one deficit:

* to words of its own length with a surplus first, then a deficit (each pair is met from
  one side only; equal paths from the smaller word);
* to words one letter shorter with one deficit.

The top of the trie (length and ``TOP`` counts) is laid out as blocks over the cluster: a word
lies in its own block and is sent with its budget to the blocks, among those that exist,
that the search enters. Below, each task walks its block node by node with all visitors
at once. A block of more than ``HELD`` words is split by hash and visited in every part; visitors
stream past. Words at the leaves are compared letter by letter; where many visitors
meet many words, only those that share a half (one half of two words one letter apart is
equal) are compared.

``form`` is the near word of largest count if that is twice the word's or more, ``root`` the
end of the chain of forms. A count at least doubles at every step, so chains end.

Rows: null and empty texts have no words; a null id is written as '' before the colon.
Repeated rows count again. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, batch, ship

RUN = "[A-Za-zÀ-ÿ]+"
GROUPS = 9
TOP = 3
HELD = 1 << 16     # words of a block held by one task
LEAF = 24          # a node of so few words is compared at once
AT_ONCE = 1 << 20  # letters compared at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, damage: int = 97) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lowered, one letter deleted from every ``damage``-th by hash (0: from none)."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if damage:
        runs = runs.withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "run")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length("run")))).otherwise(word)
    return runs.select(word.alias("word")).filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """Letters dealt to groups, the next most frequent one to the lightest group. One row per letter of the alphabet is fetched."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    dealt, weight = [""] * groups, [0] * groups
    for letter, n in sorted(((r.letter, r.n) for r in letters.toLocalIterator()), key=lambda x: (-x[1], x[0])):
        g = weight.index(min(weight))
        dealt[g] += letter
        weight[g] += n
    return dealt


def _node(length, counts):
    return F.concat_ws(",", length, *counts)


def _entered(length, counts) -> list:
    """Blocks that the search from a word enters, with the budget left: (block, surplus, deficit)."""
    def at(by: int, change: dict[int, int], more: int, less: int):
        node = _node(length + by, [c + change.get(k, 0) for k, c in enumerate(counts)])
        return F.struct(node.alias("block"), F.lit(more).cast("tinyint").alias("more"), F.lit(less).cast("tinyint").alias("less"))

    levels = range(len(counts))
    return [at(0, {}, 1, 0), *(at(0, {k: 1}, 0, 1) for k in levels), *(at(0, {k: 1, m: -1}, 0, 0) for k in levels for m in levels if m > k),
            at(-1, {}, 0, 1), *(at(-1, {k: -1}, 0, 0) for k in levels)]


class Words:
    """Words of one length as a matrix of letters (one byte each), their group counts and numbers of occurrences."""

    def __init__(self, column: pa.Array, n: np.ndarray, group_of: np.ndarray, groups: int):
        text = column.to_pylist()
        self.n, self.size = n, len(text[0])
        self.letters = np.frombuffer("".join(text).encode("latin-1"), np.uint8).reshape(len(text), self.size)
        code = group_of[self.letters]
        self.paths = np.stack([(code == g).sum(1, dtype=np.int32) for g in range(groups)], 1)

    def take(self, at: np.ndarray) -> "Words":
        out = Words.__new__(Words)
        out.n, out.size, out.letters, out.paths = self.n[at], self.size, self.letters[at], self.paths[at]
        return out

    def text(self, at: np.ndarray) -> pa.Array:
        """Letters back to UTF-8: those from 0xC0 on are two bytes, 0xC3 and the letter less 0x40."""
        data = self.letters[at].ravel()
        wide = data >= 0xC0
        end = np.cumsum(1 + wide)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        out[end - 1] = np.where(wide, data - 0x40, data)
        out[end[wide] - 2] = 0xC3
        off = np.concatenate([[0], end])[:: self.size].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(off), pa.py_buffer(out)])


def one_apart(longer: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Row by row: equal length and one letter replaced, or ``other`` is ``longer`` without one letter."""
    size = other.shape[1]
    if longer.shape[1] == size:
        return (longer != other).sum(1) == 1
    lead = np.logical_and.accumulate(longer[:, :size] == other, axis=1).sum(1)
    tail = np.logical_and.accumulate((longer[:, 1:] == other)[:, ::-1], axis=1).sum(1)
    return lead + tail >= size


def _equal_halves(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with equal rows a[i], b[j]."""
    if not a.shape[1]:
        return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    key = lambda x: np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1]))).ravel()
    names, code = np.unique(np.concatenate([key(a), key(b)]), return_inverse=True)
    left, right = code[: len(a)], code[len(a):]
    order = np.argsort(right, kind="stable")
    lo, hi = (np.searchsorted(right[order], left, side=s) for s in ("left", "right"))
    count = hi - lo
    i = np.repeat(np.arange(len(a)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return i, order[j]


class Trie:
    """The words of a block below its top, as a list sorted by path: a node is a range."""

    def __init__(self, words: Words):
        self.words = words.take(np.lexsort(words.paths.T[::-1]))

    def _compare(self, seen: Words, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(q):
            return q, w
        step = max(1, AT_ONCE // self.words.size)
        good = np.concatenate([one_apart(seen.letters[q[k : k + step]], self.words.letters[w[k : k + step]]) for k in range(0, len(q), step)])
        return q[good], w[good]

    def _leaf(self, seen: Words, lo: int, hi: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(q) * (hi - lo) <= 1 << 14 or hi - lo <= LEAF:
            return self._compare(seen, np.repeat(q, hi - lo), np.tile(np.arange(lo, hi), len(q)))
        half, letters = self.words.size // 2, self.words.letters[lo:hi]
        i, j = _equal_halves(seen.letters[q][:, :half], letters[:, :half])
        m, k = _equal_halves(seen.letters[q][:, half + seen.size - self.words.size :], letters[:, half:])
        both = np.unique(np.concatenate([i, m]) * (hi - lo) + np.concatenate([j, k]))
        return self._compare(seen, q[both // (hi - lo)], lo + both % (hi - lo))

    def search(self, seen: Words, more: np.ndarray, less: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, word) one letter apart: depth first, all visitors that can still enter a node at once."""
        paths, depth = self.words.paths, self.words.paths.shape[1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(level, 0, len(paths), np.arange(len(seen.letters)), more.astype(bool), less.astype(bool))]
        while stack:
            level, lo, hi, q, more, less = stack.pop()
            if level == depth or hi - lo <= LEAF:
                found.append(self._leaf(seen, lo, hi, q))
                continue
            branch = paths[lo:hi, level]
            cuts = lo + np.concatenate([[0], np.flatnonzero(branch[1:] != branch[:-1]) + 1, [hi - lo]])
            own = seen.paths[q, level]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                off = paths[a, level] - own
                up, down = (off == 1) & more, (off == -1) & less
                at = np.flatnonzero((off == 0) | up | down)
                if len(at):
                    # a deficit is allowed once a surplus is spent
                    stack.append((level + 1, a, b, q[at], (more & ~up)[at], ((less & ~down) | up)[at]))
        q, w = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        if seen.size == self.words.size and len(q):
            # a small node is compared before its path is at an end: keep the side from which the pair is met
            off = self.words.paths[w] - seen.paths[q]
            lead = off[np.arange(len(q)), (off != 0).argmax(1)]
            step = self.words.letters[w].astype(np.int16) - seen.letters[q]
            after = step[np.arange(len(q)), (step != 0).argmax(1)] > 0
            keep = (lead > 0) | ((lead == 0) & after)
            q, w = q[keep], w[keep]
        return q, w


def near_pairs(words: DataFrame, dealt: list[str], held: int = HELD) -> DataFrame:
    """(word, n, near, near_n), both ways, of all words one letter apart."""
    spark, groups = ship(words.sparkSession), len(dealt)
    group_of = np.full(256, 255, np.uint8)  # a letter not dealt out is on no level
    for g, letters in enumerate(dealt):
        for letter in letters:
            group_of[ord(letter)] = g
    length = F.char_length("word")
    counts = [length - F.char_length(F.translate("word", letters, "")) if letters else F.lit(0) for letters in dealt[:TOP]]
    inside = words.select("word", "n", _node(length, counts).alias("block"))
    sizes = inside.groupBy("block").agg(F.ceil(F.count("*") / held).cast("int").alias("parts"))
    visits = words.select("word", "n", F.inline(F.array(*_entered(length, counts))))
    lies = inside.join(sizes, "block").select("block", F.pmod(F.xxhash64("word"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "word", "n",
                                              F.lit(0).cast("tinyint").alias("more"), F.lit(0).cast("tinyint").alias("less"))
    # joined with the blocks that exist: other branches are never entered
    comes = visits.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                               (F.char_length("word")).alias("kind"), "word", "n", "more", "less")
    rows = lies.unionAll(comes).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, trie = None, [], None
        for part in batches:
            names = part.column(0).dictionary_encode()
            key = np.stack([names.indices.to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                some, here, kind = part.slice(a, b - a), (names[a].as_py(), int(key[a, 1])), int(key[a, 2])
                if here != now:
                    now, waiting, trie = here, [], None
                got = Words(some.column(3), some.column(4).to_numpy(), group_of, groups)
                if not kind:
                    waiting.append(got)
                    continue
                if trie is None:
                    whole = waiting[0]
                    for field in ("letters", "paths", "n"):
                        setattr(whole, field, np.concatenate([getattr(w, field) for w in waiting]))
                    trie, waiting = Trie(whole), []
                q, w = trie.search(got, some.column(5).to_numpy(), some.column(6).to_numpy(), TOP)
                for k in range(0, len(q), 1 << 15):
                    i, j = q[k : k + (1 << 15)], w[k : k + (1 << 15)]
                    x, y, nx, ny = got.text(i), trie.words.text(j), got.n[i], trie.words.n[j]
                    yield batch(schema, x, nx, y, ny)
                    yield batch(schema, y, ny, x, nx)

    return rows.select("block", "part", "kind", "word", "n", "more", "less").mapInArrow(run, "word string, n long, near string, near_n long")


def chain_ends(spark, scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each round follows twice as many forms, until none has a further one."""
    ends = scratch.keep(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "ends-0")
    turn = 0
    while True:
        after = scratch.read(ends, f"ends-{turn}").select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = ends.join(after, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        turn += 1
        done = scratch.keep(moved, f"moved-{turn}")
        if done.filter("moved").isEmpty():
            return ends
        ends = scratch.keep(done.select("word", "root"), f"ends-{turn}")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, damage: int = 97, held: int = HELD) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "variants")
    words = scratch.keep(corpus_words(docs, id_col, text_col, shortest, fewest, damage), "words")
    pairs = scratch.keep(near_pairs(words, letter_groups(words), held), "pairs")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    forms = scratch.keep(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = chain_ends(spark, scratch, forms).select(F.col("word").alias("_word"), "root")
    joined = forms.join(ends, F.col("word") == F.col("_word"), "left")
    return joined.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
