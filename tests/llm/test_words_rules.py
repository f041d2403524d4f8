"""Spelling variants, cross-tokenizer alignment and the likelihood ratio against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from tidemark.llm import crosstoken, oracles, ratio, variants
from verification.compare import connect, differences, rows_of_spark, rows_of_sql

# ---------------------------------------------------------------- variants


def plain_words(rows, damage=97, shortest=5, fewest=3):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(cases.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= fewest}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def plain_variants(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w], form[w] and words[form[w]], root(w)) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def spelled(seed, n):
    """Texts of few letters with accents, so that many words are one letter apart."""
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcé×Àñ") for _ in range(pick.randrange(3, 9))) for _ in range(n)]
    return [(k, " ".join(pick.choices(words, k=60)) + pick.choice(["", " ABCAB", ". bbbbb-bbbbb"])) for k in range(40)]


@pytest.mark.parametrize("damage", [97, 3, 0])
def test_variants_equal_comparing_all_words(spark, damage):
    rows = cases.documents() + spelled(1, 300) + spelled(2, 60)
    got = variants.variants(cases.frame(spark, rows), damage=damage)
    assert rows_of(got) == plain_variants(plain_words(rows, damage))


def test_split_blocks_and_large_leaves(spark):
    """Anagrams have one path: a block beyond its size is split, and a leaf of many words compared by halves."""
    pick = random.Random(7)
    words = {"".join(pick.sample("abcdefgh", 8)) for _ in range(1500)}
    words |= {w[:3] + w[4:] for w in list(words)[:300]} | {w[:2] + "x" + w[3:] for w in list(words)[:200]}
    counted = {w: 3 + zlib.crc32(w.encode()) % 50 for w in words}
    table = spark.createDataFrame(list(counted.items()), "word string, n long").repartition(3)
    dealt = variants.letter_groups(table)
    got = [tuple(r) for r in variants.near_pairs(table, dealt, held=200).collect()]
    want = [(a, counted[a], b, counted[b]) for a in words for b in words if abs(len(a) - len(b)) <= 1 and a != b and one_apart(a, b)]
    assert sorted(got) == sorted(want)
    assert sorted(tuple(r) for r in variants.near_pairs(table, [*"abcdefgh", "x"][:3] + [""] * 2).collect()) == sorted(want)


def test_halves_find_all_pairs():
    pick = np.random.default_rng(3)
    for longer in (6, 7):
        a, b = pick.integers(97, 100, (400, longer)).astype(np.uint8), pick.integers(97, 100, (300, 6)).astype(np.uint8)

        def words(x):
            out = variants.Words.__new__(variants.Words)
            out.letters, out.size, out.n, out.paths = x, x.shape[1], np.zeros(len(x), np.int64), np.zeros((len(x), 1), np.int32)
            return out

        trie = variants.Trie(words(b))
        q, w = trie._leaf(words(a), 0, 300, np.arange(400))
        text = [bytes(x).decode() for x in a], [bytes(x).decode() for x in b]
        assert sorted(zip(q.tolist(), w.tolist())) == [(i, j) for i in range(400) for j in range(300) if one_apart(text[0][i], text[1][j])]


def test_chains_of_forms(spark):
    """Each word is half as common as the next: one long chain."""
    words = ["aaaaaaaaaa"[: 10 - k] + "b" * k for k in range(11)]
    rows = [(n, " ".join([w] * (3 << k))) for n, (k, w) in enumerate(enumerate(words))]
    got = {r.word: r.root for r in variants.variants(cases.frame(spark, rows), damage=0).collect()}
    assert set(got.values()) == {"bbbbbbbbbb"}


def test_variants_of_nothing(spark):
    assert variants.variants(cases.frame(spark, [])).count() == 0
    assert variants.variants(cases.frame(spark, [(1, None), (2, ""), (None, "abcde abcde abcde")])).count() == 1


# ---------------------------------------------------------------- two tokenizers


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {chr(b): b for b in plain}, 256
    for b in range(256):
        if chr(b) not in out or b not in plain:
            out[chr(more)] = b
            more += 1
    return out


def plain_alignment(rows):
    """Tokens with positions, groups between common ends, and links by comparing byte ranges."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    name, byte = {i: s for s, i in first.get_vocab().items()}, letters()

    def spans(tokens):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return list(zip([0, *ends[:-1]], ends))

    out, held = [], Counter()
    for i, t in rows:
        a = b = []
        links, groups = [], []
        if t:
            a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
            bytes_a = [bytes(byte[c] for c in name[x]) for x in a]
            bytes_b = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                at_a, at_b = spans(bytes_a), spans(bytes_b)
                low = 0
                for x, (s, e) in enumerate(at_a):
                    while at_b[low][1] <= s:
                        low += 1
                    y = low
                    while y < len(at_b) and at_b[y][0] < e:
                        links.append((a[x], b[y]))
                        y += 1
                both = sorted({e for _, e in at_a} & {e for _, e in at_b})
                group = {"a": defaultdict(list), "b": defaultdict(list)}
                for side, ids, at in (("a", a, at_a), ("b", b, at_b)):
                    for token, place in zip(ids, np.searchsorted(both, [e for _, e in at])):
                        group[side][place].append(str(token))
                groups = [",".join(group["a"][k]) + "|" + ",".join(group["b"][k]) for k in range(len(both))]
            else:
                a = b = []
        held.update(set(links))
        out.append((i, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(i, a, b, len(g), len(p), sum(held[x] == most[x[0]] for x in p), sum(held[x] for x in p),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, p in out]


ODD = [(900, "x▁y"), (901, "<s> a</s> <unk>  <0x0A> "), (902, "  lead"), (903, "trail  "), (904, "tab\tand\nline"), (905, "\U0001f469‍\U0001f680 한글 ไทย"), (906, " ")]


def test_alignment_equals_byte_ranges(spark, monkeypatch):
    monkeypatch.setattr(crosstoken, "BLOCK", 3000)
    rows = cases.documents() + ODD
    got = crosstoken.link_counts(cases.frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_alignment(rows), key=str)


def test_outputs_of_an_alignment(spark):
    text = "Lockstep merging of tokenizers, ça va?"
    r = crosstoken.align(cases.frame(spark, [(1, text), (2, None)])).orderBy("doc_id").collect()
    assert r[1].a_ids == [] and r[1].groups == ""
    groups, a, b = [], 0, 0
    for x, y in zip(r[0].cut_a, r[0].cut_b):
        groups.append(",".join(map(str, r[0].a_ids[a:x])) + "|" + ",".join(map(str, r[0].b_ids[b:y])))
        a, b = x, y
    assert ";".join(groups) == r[0].groups
    assert len(set(zip(r[0].link_a, r[0].link_b))) == len(r[0].link_a) and r[0].link_a[-1] == len(r[0].a_ids) - 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.randoms()), max_size=5), st.integers(1, 7))
def test_lockstep_equals_overlaps(docs, stretch):
    size_a, size_b, off_a = [], [], [0]
    for widths, pick in docs:
        total, own = sum(widths), []
        while sum(own) < total:
            own.append(min(pick.randrange(1, 5), total - sum(own)))
        size_a += widths
        size_b += own
        off_a.append(len(size_a))
    end_a, end_b = np.cumsum(size_a, dtype=np.int64), np.cumsum(size_b, dtype=np.int64)
    a, b, code = crosstoken.lockstep(end_a, end_b, np.array(off_a), stretch)
    want = [(i, j) for i in range(len(size_a)) for j in range(len(size_b)) if end_a[i] - size_a[i] < end_b[j] and end_b[j] - size_b[j] < end_a[i]]
    assert list(zip(a.tolist(), b.tolist())) == want
    assert [i for i, c in zip(a.tolist(), code.tolist()) if c == 3] == [i for i, e in enumerate(end_a.tolist()) if e in set(end_b.tolist())]


def test_alignment_of_an_empty_table(spark):
    assert crosstoken.link_counts(cases.frame(spark, [])).count() == 0
    assert [tuple(r) for r in crosstoken.link_counts(cases.frame(spark, [(None, None)])).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


# ---------------------------------------------------------------- likelihood ratio


def plain_counts(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), (text or "").split("\n")
    runs = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    again = {k + m for k in range(len(words) - 4) if runs[tuple(words[k:k + 5])] > 1 for m in range(5)}
    full = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(again))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t#|é\r "), max_size=150), max_size=5))
def test_limits_equal_a_plain_count(texts):
    raw = [t.encode() for t in texts]
    kernel = ratio.Kernel(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64))
    got = list(zip(kernel.n_words, kernel.word_chars, kernel.n_symbols, kernel.n_dup_lines, kernel.n_repeat_words))
    assert [tuple(map(int, x)) for x in got] == [plain_counts(t) for t in texts]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_ratio_equals_its_sql_on_odd_rows(spark, folder):
    pick = random.Random(5)
    good = [(1000 + n, " ".join(cases.words(pick.randrange(8, 60), 100 + n, 90))) for n in range(120)]
    bad = [(2000 + n, " ".join(f"junk{pick.randrange(30)} |" for _ in range(30))) for n in range(20)]
    docs = cases.frame(spark, cases.documents() + good + bad + [(1000, "the same id with another text of more than ten words in it")])
    labels = labelled(spark, [(i, 1, 0, None) for i, _ in good[:100]] + [(i, 0, 1, None) for i, _ in bad] + [(None, 1, 0, None), (1001, None, 0, None), (1002, 0, 0, None), (77777, 1, 0, None)])
    docs.coalesce(1).write.parquet(f"{folder}/a/documents")
    labels.coalesce(1).write.parquet(f"{folder}/a/labels")
    import glob
    import os
    for name in ("documents", "labels"):
        os.link(glob.glob(f"{folder}/a/{name}/part-*.parquet")[0], f"{folder}/{name}.parquet")
    got = ratio.judge(docs, labels)
    assert differences(rows_of_spark(got), rows_of_sql(connect(folder), oracles.ORACLES["op13_ratio"])) == []
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert not any(kept[i] for i, _ in bad) and sum(kept[i] for i, t in good[100:] if len(t.split()) >= 10) >= 15


def test_ratio_without_labels(spark):
    docs = cases.frame(spark)
    got = ratio.judge(docs, labelled(spark, []), keep=("text",)).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 and r.threshold is None for r in got)
    for r in got:
        n = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert ratio.judge(cases.frame(spark, [(1, None), (2, "")]), labelled(spark, [(1, 1, 0, None)])).filter("base_failed AND NOT kept").count() == 2
    assert ratio.judge(cases.frame(spark, []), labelled(spark, [(1, 1, 0, None)])).count() == 0


def test_ratio_takes_every_trusted_document(spark):
    """21,000 of them: no word of the target and no held-out score may be left out."""
    pick = random.Random(8)
    docs = [(n, " ".join(pick.choice(("as", "ok", "it", f"w{n % 7}", f"rare{n // 300}")) for _ in range(11))) for n in range(21000)]
    got = {r.doc_id: r for r in ratio.judge(cases.frame(spark, docs), labelled(spark, [(n, 1, 0, None) for n, _ in docs])).collect()}

    def buckets(text):
        ids = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in text.split()]
        return [i % ratio.BUCKETS for i in ids] + [(31 * a + b + 1) % ratio.BUCKETS for a, b in zip(ids, ids[1:])]

    grams = {n: buckets(t) for n, t in docs}
    fit = {n for n, _ in docs if hashlib.md5(str(n).encode()).hexdigest()[-1] in "02468ace"}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for n in fit for b in grams[n])
    share = sum(target.values()) / sum(raw.values())
    worth = {b: round(ratio.UNIT * float(np.log((target[b] + 1) / (c * share + 1)))) for b, c in raw.items()}
    score = {n: sum(worth[b] for b in g) // len(g) for n, g in grams.items()}
    held = sorted(score[n] for n in score if n not in fit and not got[n].base_failed)
    assert all(got[n].score == score[n] for n in score)
    assert {r.threshold for r in got.values()} == {held[int(0.002 * len(held))]}
