"""Byte-level BPE with tiktoken: a local rank file, splitting at safe boundaries, decoding of raw bytes.

A long text is cut before it is encoded, so that one call never holds more than
``PIECE`` characters. Cuts stand where the split pattern always begins a new match:
before a single space between two characters that are neither white space nor
cut off by it. The pieces' ids in a row are the ids of the text.

Rows: a null or empty text has no tokens. Other columns of the input are ignored
unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE = 1 << 16

#: ASCII on both sides of one space: white space on neither side in any alphabet.
_SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")

_loaded: dict[tuple[str, str], tuple[tiktoken.Encoding, np.ndarray, np.ndarray]] = {}


def load(ranks_path: str, pattern: str):
    """The encoding, and all token bytes in a row with their offsets; once per Python worker."""
    key = (ranks_path, pattern)
    if key not in _loaded:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _loaded[key] = (encoding, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)]))
    return _loaded[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts of about ``size`` characters at safe boundaries; where none stands, the piece goes on."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.concatenate([np.asarray(encoding.encode_ordinary(p), "<u4") for p in pieces(text)])


def decode(data: np.ndarray, off: np.ndarray, ids: np.ndarray) -> bytes:
    """Token bytes in a row. Not text: a token may hold part of a character."""
    size = (off[1:] - off[:-1])[ids]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(off[ids], size)
    return data[at].tobytes()


_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode_documents(docs: DataFrame, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, data, off = load(ranks_path, pattern)
        for rows in batches:
            n, coded, back, ids = [], [], [], []
            for text in rows.column(1):
                x = encode(encoding, text.as_py() or "")
                raw = x.tobytes()
                n.append(len(x))
                coded.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decode(data, off, x)).hexdigest())
                ids.append(raw)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SQL)


def decode_documents(coded: DataFrame, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) back to (doc_id, decoded bytes). A null list of ids gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, data, off = load(ranks_path, pattern)
        for rows in batches:
            back = [None if x.as_py() is None else decode(data, off, np.frombuffer(x.as_py(), "<u4")) for x in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    ship(coded.sparkSession)
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
