"""Documents with everything that may go wrong, and plain versions of the operators."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, component_id string, spans string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed, size=400):
    pick = random.Random(seed)
    return [f"w{pick.randrange(size)}" + pick.choice(["", "", ".", ","]) for _ in range(n)]


def documents():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, repeated rows and ids, very long and odd texts."""
    base = words(120, 1)
    near = [w if i != 60 else "changed" for i, w in enumerate(base)]
    chain = [w if i not in (5, 110) else "other" for i, w in enumerate(near)]
    passage = " ".join(words(70, 2))
    rows = [
        (5, " ".join(base)), (3, " ".join(base)), (9, " ".join(near)), (12, " ".join(chain)), (12, " ".join(chain)),
        (7, None), (8, ""), (10, " \t\n "), (None, " ".join(base)), (None, None),
        (20, "one two three"), (21, "One  TWO\nthree"), (22, "one two"), (23, "ein Wort ßäö " * 3),
        (30, " ".join(words(50, 3)) + " " + passage + " tail"), (31, passage), (32, "head " + passage + " " + " ".join(words(40, 4))),
        (33, " ".join(words(9000, 5, 3000))), (34, "a" * 5000), (35, "ab" * 3000 + " " + "a" * 200),
        (40, "same id " + " ".join(words(60, 6))), (40, "other text " + " ".join(words(60, 7))), (41, "same id " + " ".join(words(60, 6))),
        (50, "   quote \U0001f600 \U0001f600 end"), (51, "line\r\nbreaks and\x00zero"), (52, "<|endoftext|> !! !"),
    ]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", f"s{n % 3}" if n % 5 else None, None if t is None else len(t), "x", "y", "z") for n, (i, t) in enumerate(rows)], SCHEMA
    ).repartition(3)


def jaccard(rows, size=5):
    """{(doc_id, text): (n_shingles, component)} by comparing all pairs."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i is None, i or 0, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def repeats(rows, width=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking at every window."""
    first = {}
    for i, t in rows:
        x = (t or "").encode()
        for k in range(len(x) - width + 1 if i is not None else 0):
            w = x[k:k + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - width + 1 if i is not None else 0):
            if first[x[k:k + width]] < i:
                gone[k:k + width] = b"\1" * width
        left = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def contamination(rows, items, window=13):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    held = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            held.setdefault(tuple(w[k:k + n]), set()).add(i)
    sizes = {len(k) for k in held}
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in held:
                    found |= held[tuple(w[k:k + n])]
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)
