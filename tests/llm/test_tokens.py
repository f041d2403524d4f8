"""Token ids: exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from tidemark.llm import ans, bpe

LIBRARY = Tokenizer.from_file(ans.TOKENIZER)


def test_ids_and_bytes_are_those_of_the_library(spark):
    encoding, _, _ = bpe.load(bpe.RANKS, public_tokenizers.PATTERN)
    got = bpe.encode_documents(cases.frame(spark)).collect()
    want = []
    for i, t in cases.documents():
        ids = np.asarray(encoding.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids))) for r in got)


def test_decoding_gives_raw_bytes(spark):
    coded = spark.createDataFrame([(1, np.array([200, 17, 3], "<u4").tobytes()), (2, None), (3, b"")], "doc_id long, ids binary")
    encoding, _, _ = bpe.load(bpe.RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r.decoded for r in bpe.decode_documents(coded).collect()}
    assert got[2] is None and got[3] == b"" and got[1] == encoding.decode_bytes([200, 17, 3])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9.'s\n\t  ßé中́!"), max_size=400), st.integers(1, 40))
def test_cuts_are_safe(text, size):
    encoding, _, _ = bpe.load(bpe.RANKS, public_tokenizers.PATTERN)
    cut = [i for p in bpe.pieces(text, size) for i in encoding.encode_ordinary(p)]
    assert cut == encoding.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab Z9.'s\n\t ß中é!", "\u00a0", " <|endoftext|>", "<|endoftext|>"]), max_size=120).map("".join), max_size=6), st.booleans())
def test_encoder_equals_the_library(texts, plain):
    coder = ans.encoder(ans.TOKENIZER, plain)
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    ids, upto = coder.encode(np.frombuffer(b"".join(raw), np.uint8), off, 0)
    for i, t in enumerate(texts):
        LIBRARY.encode_special_tokens = plain
        assert ids[upto[i]:upto[i + 1]].tolist() == [*LIBRARY.encode(t, add_special_tokens=False).ids, 0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000))
def test_coder_round_trip(ids):
    ids = np.array(ids, np.uint32)
    coder = ans.Coder(ans.shares(np.bincount(ids, minlength=50)))
    states, words = coder.encode(ids)
    assert coder.decode(len(ids), states, words).tolist() == ids.tolist()


def test_shares_fill_the_range_and_keep_rare_ids():
    counts = np.r_[10**9, np.ones(5000, np.int64), 0]
    share = ans.shares(counts)
    assert share.sum() == 1 << ans.PRECISION and (share[:-1] > 0).all() and share[-1] == 0
    assert ans.shares(np.zeros(4, np.int64)).tolist() == [0, 0, 0, 0]


def test_store_round_trip(spark, folder):
    ans.write_store(cases.frame(spark), f"{folder}/store", block=500)
    got = ans.read_store(spark, f"{folder}/store").collect()
    library = Tokenizer.from_file(ans.TOKENIZER)  # as it is: the string of the end token is one id
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = [(i, np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in cases.documents()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, bytes(r.ids))) for r in got)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.append(0, np.cumsum([r.n_tokens for r in ordered]))[:-1].tolist()
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    assert spark.read.parquet(f"{folder}/store/blocks").count() > 3


def test_a_damaged_block_is_refused(spark, folder):
    ans.write_store(cases.frame(spark, [(1, "some words in a text")]), f"{folder}/store")
    blocks = spark.read.parquet(f"{folder}/store/blocks")
    blocks.withColumn("crc32", blocks["crc32"] + 1).write.parquet(f"{folder}/broken/blocks")
    for name in ("model", "parts"):
        spark.read.parquet(f"{folder}/store/{name}").write.parquet(f"{folder}/broken/{name}")
    with pytest.raises(Exception, match="damaged block"):
        ans.read_store(spark, f"{folder}/broken").collect()


def test_empty_tables(spark, folder):
    none = cases.frame(spark, [])
    assert bpe.encode_documents(none).count() == 0
    ans.write_store(none, f"{folder}/store")
    assert ans.read_store(spark, f"{folder}/store").count() == 0
    assert isinstance(tiktoken.__version__, str)
