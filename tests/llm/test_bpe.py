"""Encoding and decoding against the tokenizer library itself."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kapspark.llm import bpe
from kapspark.llm.shared import bucket_count

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASSES = bpe.class_table()
ENCODING = tiktoken.Encoding(
    "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
)

TEXTS = [
    "", None, " ", "\n\n", "  two  blanks ", "don't they'll we've I'M 'sup", "''s it's''s", "Äpfel im Straßenverkauf 12３½",
    "tab\there  nbsp", "日本語テキスト 한국어", "emoji 👩‍👩‍👧 done", "<|endoftext|>", "a" * 3000, "1234567 .,!? ...", "'", "x's\n'll 're",
    "mixed\r\n\r\n lines   wide", "՘ unassigned ᇞ0",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" '\n\tsterdlvmSL1.é")), st.characters(exclude_categories=["Cs"])), max_size=20), min_size=1, max_size=4))
def test_pre_tokens_encode_as_the_whole_text(texts):
    words, counts = bpe.split_texts(texts, CLASSES)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        parts = [w.decode() for w in words.slice(at, n).to_pylist()]
        at += n
        assert "".join(parts) == text
        assert [i for p in parts for i in ENCODING.encode_ordinary(p)] == ENCODING.encode_ordinary(text)


@pytest.mark.parametrize("block_chars", [40, 5_000_000])
def test_encode_and_decode(docs_of, block_chars):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "repeated"), (0, "repeated"), (None, "no id here")]
    df = docs_of(rows, extra=True).repartition(3, "doc_id")
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, block_chars=block_chars, buckets=5)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in encoded.collect())
    want = sorted((i is None, i or 0, ENCODING.encode_ordinary(t or "")) for i, t in rows)
    assert got == want
    back = bpe.decode(encoded, RANKS).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t in rows)


def test_digests_and_empty_table(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    out = {r["doc_id"]: r for r in bpe.round_trip(docs_of(rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = ENCODING.encode_ordinary(t or "")
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs_of(rows).filter("doc_id < 0"), RANKS, public_tokenizers.PATTERN).collect() == []


def test_decoding_refuses_unknown_ids_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["bytes"] for r in bpe.decode(df, RANKS).collect()}
    assert got[2] is None and bytes(got[3]) == b"" and len(got[1]) == 2
    bad = spark.createDataFrame([(1, [50_400])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="vocabulary|out of bounds|IndexError"):
        bpe.decode(bad, RANKS).collect()


def test_buckets_follow_the_text(docs_of):
    docs = docs_of([(i, "ab" * 50) for i in range(40)] + [(40, None), (41, "")])
    assert bucket_count(docs, "text", 3, 100) == 40
    assert bucket_count(docs, "text", 64, 100) == 64
    assert bucket_count(docs.filter("doc_id < 0"), "text", 3, 100) == 3


def test_packing():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = rnd.integers(0, 2**32, n, dtype=np.uint32)
        assert (bpe.unpack(bpe.pack(values), n) == values).all()


def test_very_long_texts(docs_of):
    """Texts of several blocks' length are one block each."""
    rows = [(1, "a word, Äpfel; 12 tabs\t\n" * 30_000), (2, "short"), (3, "x y" * 100_000), (4, None)]
    out = {r["doc_id"]: r for r in bpe.round_trip(docs_of(rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = ENCODING.encode_ordinary(t or "")
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
