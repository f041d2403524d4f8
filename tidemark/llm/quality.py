"""Quality classifier from weak labels: EM over overlapping labellers, then a hashed linear scorer.

1. A bounded sample of labelled documents (``sample`` rows, by hash of the id) gives
   a lexicon: hashed words and word beginnings that stand almost only in bad ones.
2. Every document gets a vote (bad, good or none) from each labeller: five look at
   its shape, one at the lexicon, one is the label where there is one.
3. The number of documents per pattern of votes (3**7 at most, over all documents)
   goes through expectation-maximisation: the shares of good documents and of
   those bad by repeats, by marks and by words, and how often each labeller says "bad" of
   each. Every pattern gets a posterior.
4. The posteriors of the sample train a logistic scorer on hashed features: words,
   beginnings of words and classes of shape.
5. The scorer judges every document by its whole text.

Bad: quality 0 or toxic 1. Labels whose id hash falls into ``held_out`` are shown to
nobody here and serve for tests.

Rows: a null or empty text, or one without words, has no votes and score 0 and is
kept. Null ids have no label. Of several labels of an id the worst counts. Equal
rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, ship
from .textkernel import LETTERS, NOT_SPACE, Words, flat, steps

SAMPLE = 5_000            # labelled documents that are fitted on
SLOTS = 1 << 22           # hashed features
BEGINNINGS = (4, 5, 6)    # bytes
LEXICON_ROWS, LEXICON_SHARE = 8, 0.97
MOST_FEATURES = 4096      # features with a weight
LABELLERS = ("repeats", "symbols", "capitals", "lists", "odd_words", "lexicon", "label")

#: (labeller, share from which it says bad, share up to which it says good)
SHAPES = (("repeats", 0.20, 0.05), ("symbols", 0.12, 0.07), ("capitals", 0.50, 0.20), ("lists", 0.15, 0.02), ("odd_words", 0.40, 0.15))
_CLASSES = 12

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_ENDS = _LETTER.copy()
_ENDS[[ord(c) for c in ".,;:!?"]] = True


def _upto(mask: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(mask))


def shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, texts x five shares): repeated words, symbols, capitals, list marks, words that are not plain."""
    words = Words(data, off, NOT_SPACE)
    n = np.diff(words.first)
    h = words.hashes()
    again = np.zeros(len(h), bool)
    for lag in (1, 2, 3):
        again[lag:] |= h[lag:] == h[:-lag]
    per = lambda upto, at: upto[at[1:]] - upto[at[:-1]]
    letters = np.maximum(1, per(_upto(_LETTER[data]), off))
    no_letter = _upto(~_LETTER[data])
    plain = (no_letter[words.end - 1] == no_letter[words.start]) & _ENDS[data[words.end - 1]]
    some = np.maximum(1, n)
    return n, np.stack([
        per(_upto(again), words.first) / some,
        per(_upto(_SYMBOL[data]), off) / letters,
        per(_upto(_UPPER[data]), off) / letters,
        per(_upto(data == ord("|")), off) / some,
        per(_upto(~plain), words.first) / some,
    ], axis=1)


def word_slots(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word and of the beginnings of longer words."""
    words = Words(data, off, LETTERS)
    total = words.sums()
    text = np.searchsorted(words.first, np.arange(len(words.start)), side="right") - 1
    at, slots = [text], [words.hashes(total=total)]
    for k in BEGINNINGS:
        long = words.end - words.start > k
        slots.append(words.hashes(k, total)[long] + np.uint64(k))
        at.append(text[long])
    return np.concatenate(at), (np.concatenate(slots) & np.uint64(SLOTS - 1)).astype(np.int64)


def shape_slots(shares: np.ndarray) -> np.ndarray:
    """One slot per share and its class; classes are finer near zero."""
    level = np.minimum(_CLASSES - 1, np.floor(np.sqrt(np.clip(shares, 0, 1)) * _CLASSES)).astype(np.int64)
    return SLOTS + level + _CLASSES * np.arange(shares.shape[1])


ALL_SLOTS = SLOTS + _CLASSES * len(SHAPES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        data, off = flat(rows.column(1))
        out, votes = [], []
        for a, b in steps(off):
            part, text = off[a : b + 1] - off[a], data[off[a] : off[b]]
            at, slot = word_slots(text, part)
            key = np.unique(at * ALL_SLOTS + slot)
            at, slot = key // ALL_SLOTS, (key % ALL_SLOTS).astype("<i4")
            n, shares = shapes(text, part)
            shape = shape_slots(shares).astype("<i4")
            bounds = np.searchsorted(at, np.arange(b - a + 1))
            out += [np.concatenate([slot[bounds[i] : bounds[i + 1]], shape[i]]).tobytes() for i in range(b - a)]
            votes += _shape_votes(n, shares).tolist()
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.binary()), pa.array(votes, pa.list_(pa.int32()))],
                                         names=["bad", "slots", "votes"])


def _hits(slots: tuple[np.ndarray, np.ndarray], n: int, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of the distinct words and beginnings in each of n texts."""
    at, slot = slots
    some = weight[slot] != 0
    key = np.unique(at[some] * SLOTS + slot[some])
    return np.bincount(key // SLOTS, weights=weight[key % SLOTS], minlength=n)


def _dense(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(ALL_SLOTS, np.float32)
    out[slots] = weights
    return out


def lexicon(bad: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Word slots of some documents (LEXICON_ROWS, or 0.25 % of the sample if that is more) that nearly only bad ones hold."""
    words = slots < SLOTS
    seen = np.bincount(slots[words], minlength=SLOTS)
    in_bad = np.bincount(slots[words], weights=bad[rows[words]], minlength=SLOTS)
    return np.flatnonzero((seen >= max(LEXICON_ROWS, len(bad) // 400)) & (in_bad >= LEXICON_SHARE * seen))


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of bad per pattern, labellers x classes: how often each says bad, shares of the classes).

    ``votes``: patterns x labellers of 1 (bad), 0 (good), -1 (none). Documents are good, or bad by
    repeats, by marks or by words: within one class the labellers err on their own, which they don't within all bad ones.
    A labeller is believed beforehand to be right, with the weight of 2 % of the documents.
    """
    says, silent = votes == 1, votes == -1
    repeats, marks, words, label = says[:, 0], says[:, 1:-2].any(1), says[:, -2], votes[:, -1]
    p = np.full((len(votes), 4), 0.03)
    p[np.arange(len(votes)), np.select([marks, repeats, (words & (label != 0)) | (label == 1)], [2, 1, 3], 0)] = 0.91
    before = np.full((votes.shape[1], 4), 0.01)
    before[0, 1], before[1:-2, 2], before[-2, 3], before[-1, 1:] = 0.9, 0.5, 0.8, 0.99
    prior = 0.02 * count.sum()
    rate, share = before, np.ones(4) / 4
    for _ in range(rounds if count.sum() else 0):  # without documents the beliefs stay
        weight = p * count[:, None]
        rate = (says.T @ weight + prior * before) / ((~silent).T @ weight + prior)
        rate[-1] = before[-1]
        share = (weight.sum(0) + 1) / (count.sum() + 4)
        like = np.where(says, 1, 0) @ np.log(rate) + np.where(votes == 0, 1, 0) @ np.log1p(-rate) + np.log(share)
        p = np.exp(like - like.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    return 1 - p[:, 0], rate, share


def train(target: np.ndarray, rows: np.ndarray, slots: np.ndarray, rounds: int = 300, keep_small: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of a logistic scorer for soft targets; only slots that tell bad from good get a weight."""
    n = len(target)
    used, column = np.unique(slots, return_inverse=True)  # only slots of the sample, not all there are
    seen = np.bincount(column, minlength=len(used)).astype(float)
    bad = np.bincount(column, weights=target[rows], minlength=len(used))
    share = target.mean()
    z = (bad - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    # shape classes always take part; of the words those with the clearest difference
    z[used >= SLOTS] = np.inf
    chosen = np.flatnonzero((seen >= LEXICON_ROWS) & (np.abs(z) >= 4) | (z == np.inf))
    chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")][:MOST_FEATURES])
    place = np.full(len(used), -1)
    place[chosen] = np.arange(len(chosen))
    column = place[column]
    row, column = rows[column >= 0], column[column >= 0]
    w, bias = np.zeros(len(chosen)), 0.0
    step = np.full(len(chosen), 1e-8)
    bias_step = 1e-8
    for _ in range(rounds):  # steps by the size of past gradients
        score = np.bincount(row, weights=w[column], minlength=n) + bias
        miss = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - target
        g = np.bincount(column, weights=miss[row], minlength=len(chosen)) / n + keep_small * w
        step += g * g
        bias_step += miss.mean() ** 2
        w -= 0.5 * g / np.sqrt(step)
        bias -= 0.5 * miss.mean() / np.sqrt(bias_step)
    return used[chosen], w, bias


_READ = "doc_id long, n_words long, score double, " + ", ".join(f"v{i} int" for i in range(len(LABELLERS) - 1))
_READ_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()),
                          *((f"v{i}", pa.int32()) for i in range(len(LABELLERS) - 1))])


def _shape_votes(n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    votes = np.full(shares.shape, -1, np.int32)
    for i, (_, bad, good) in enumerate(SHAPES):
        votes[shares[:, i] >= bad, i] = 1
        votes[shares[:, i] <= good, i] = 0
    votes[n == 0] = -1
    return votes


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(5)) == 0


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, use_all_labels: bool = True,
             id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, posterior (of bad, by the votes), score (of bad, by the scorer), keep.

    ``use_all_labels`` False leaves the held-out labels (``held_out``) aside. ``keep_cols`` passes columns of the row on.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "quality")
    kept = [f"_keep{i}" for i in range(len(keep_cols))]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(k) for c, k in zip(keep_cols, kept)])
    passed = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in kept)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad")
    ).filter("doc_id IS NOT NULL AND bad IS NOT NULL")
    if not use_all_labels:
        known = known.filter(~_held_out(F.col("doc_id")))

    # the sample: its size is a parameter, so it may go to the driver and to every task
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of other documents take no place in it
    chosen = scratch.keep(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")
    fitted = docs.join(F.broadcast(chosen), "doc_id").select(F.col("bad").cast("int"), "text", "doc_id")
    fitted = fitted.dropDuplicates(["bad", "text"])  # copies are no further evidence
    fitted = scratch.keep(
        fitted.orderBy("doc_id").limit(2 * sample).select("bad", "text").mapInArrow(_features, "bad int, slots binary, votes array<int>"), "features").toArrow()
    bad = fitted["bad"].to_numpy().astype(float)
    lists = [np.frombuffer(x.as_buffer(), "<i4") for x in fitted["slots"]]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    slots = np.concatenate(lists) if lists else np.empty(0, np.int64)
    telling = lexicon(bad, rows, slots)
    names = [f"v{i}" for i in range(len(LABELLERS))]

    def read(at: np.ndarray, weights: np.ndarray, bias: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed = _dense(telling, np.ones(len(telling)))[:SLOTS]
            weight = _dense(at, weights) if len(at) else None
            for part in batches:
                data, off = flat(part.column(1))
                words, votes, score = [np.empty(0, np.int64)], [np.empty((0, len(SHAPES) + 1), np.int32)], [np.empty(0)]
                for a, b in steps(off):
                    place, text = off[a : b + 1] - off[a], data[off[a] : off[b]]
                    n, shares = shapes(text, place)
                    slots = word_slots(text, place)
                    words.append(n)
                    votes.append(np.column_stack([_shape_votes(n, shares), np.where(n > 0, _hits(slots, b - a, listed) > 0, -1)]))
                    total = _hits(slots, b - a, weight[:SLOTS]) + weight[shape_slots(shares)].sum(1) + bias if weight is not None else np.full(b - a, bias)
                    score.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(total, -50, 50))), 0.0))
                v = np.concatenate(votes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(score), pa.float64()),
                     *(pa.array(v[:, i], pa.int32()) for i in range(v.shape[1])), *part.columns[2:]], names=[*_READ_SCHEMA.names, *kept])

        rows = docs.mapInArrow(run, _READ + passed).join(known, "doc_id", "left")
        return rows.withColumn(names[-1], F.when(F.col("n_words") == 0, -1).otherwise(F.coalesce(F.col("bad").cast("int"), F.lit(-1))))

    voted = read(np.empty(0, np.int64), np.empty(0), 0.0)
    patterns = voted.groupBy(*names).agg(F.count("*").alias("rows")).toPandas()  # 3 ** 7 rows at most
    votes = patterns[names].to_numpy()
    posterior, rate, share = expectation_maximisation(votes, patterns["rows"].to_numpy(float))
    by_pattern = dict(zip(map(tuple, votes.tolist()), posterior.tolist()))

    # the votes on the sample were collected with its features
    seen = np.bincount(rows, weights=np.isin(slots, telling), minlength=len(bad)) > 0
    own = np.column_stack([np.array(fitted["votes"].to_pylist(), int).reshape(len(bad), len(SHAPES)), seen, bad]).astype(int)
    target = np.array([by_pattern.get(tuple(v), b) for v, b in zip(own.tolist(), bad)])
    at, weights, bias = train(target, rows, slots) if len(bad) else (np.empty(0, np.int64), np.empty(0), -5.0)

    table = spark.createDataFrame([(*v, p) for v, p in by_pattern.items()], ", ".join(f"{n} int" for n in names) + ", posterior double")
    return (
        read(at, weights, bias).join(F.broadcast(table), names, "left")
        .select("doc_id", F.coalesce("posterior", F.lit(1 - float(share[0]))).alias("posterior"), "score", (F.col("score") < threshold).alias("keep"),
                *[F.col(k).alias(c) for c, k in zip(keep_cols, kept)])
    )
