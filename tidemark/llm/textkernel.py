"""Words and hashes of many texts at once, with numpy over the UTF-8 bytes of an Arrow batch.

Hashes are 64 bits wide: a polynomial over scrambled bytes modulo 2**64, then a
finalizer. A word's hash is taken from running sums, so a batch costs a few
passes over its bytes and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text is handled alone).
STEP = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One 64-bit value per byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _JOIN)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Word bytes: digits, small letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept up to a few STEPs."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
        up[:1] = down[:1] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > 2 * STEP:
            return up, down
        _powers["up"], _powers["down"] = up, down
    return _powers["up"][:n], _powers["down"][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and n + 1 offsets. Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = b


class Words:
    """The words of some texts: ``start``/``end`` byte positions, and ``first``[i]: the first word of text i."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.low = LOWER[data]
        inside = table[self.low]
        here = off[:-1][np.diff(off) > 0]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[here] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[here[1:] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def sums(self) -> np.ndarray:
        up, _ = powers(len(self.low))
        total = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.low] * up, out=total[1:])
        return total

    def hashes(self, longest: int | None = None, total: np.ndarray | None = None) -> np.ndarray:
        """A hash per word, or of the first ``longest`` bytes of each word."""
        total = self.sums() if total is None else total
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        _, down = powers(len(self.low))
        return mix((total[end] - total[self.start]) * down[self.start] + (end - self.start).astype(np.uint64))


def joined(words: np.ndarray, n: int) -> np.ndarray:
    """A hash per run of n words (as many as there are starts)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = words[:count] + np.uint64(n)
    for k in range(1, n):
        total = total * _JOIN + words[k : k + count]
    return mix(total)


def shingle_ranges(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, where its runs of n words begin and end in ``joined``."""
    a = first[:-1]
    return a, np.maximum(a, first[1:] - n + 1)
