"""Byte pairs against the library on whole texts, cuts at every size, and edge rows."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import byte_pairs as bp

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bp._encoding(f.read(), public_tokenizers.PATTERN)


pieces = st.lists(st.sampled_from(["a", "don't", "we're", "'", "''s", " ", "  ", "\n", "\t", "\u2003", "\u3000", "\x1c", "9", "12", "\u0663", "é", "中", "=", "!?", "_", "x", "\U0001f600", "'ll", "\u200b"]) | st.text(max_size=4), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces, st.integers(1, 9), st.integers(2, 5))
def test_parts_keep_the_ids(encoding, text, cut, run):
    runs = re.compile(f"[{bp.WHITE}]{{{run},}}")
    text = text.encode("utf-8", "ignore").decode()
    assert "".join(p for p, _ in bp.parts(text, cut, runs)) == text
    assert [k for ids in bp.encode_parts(encoding, text, cut, runs) for k in ids] == encoding.encode_ordinary(text)


def test_long_runs(encoding):
    for text in (" " * 1_500_000 + "x", "\n" * 1_200_000, "a " + "\t" * 1_100_000 + " b", "ab1" * 100_000, "=" * 300_000):
        ids = [k for part in bp.encode_parts(encoding, text) for k in part]
        assert encoding.decode_bytes(ids) == text.encode()
    # The last blank belongs to what follows.
    assert [k for part in bp.encode_parts(encoding, " " * 200_000 + "word") for k in part] == encoding.encode_ordinary(" " * 200_000 + "word")


def test_rows(spark, encoding):
    long = "Long text, isn't it? 123 " * 20_000
    texts = [None, "", "a", "Hello world's  end", "é 中文 \U0001f600", long, long, "<|endoftext|>"]
    docs = spark.createDataFrame([(k if k else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(bp.digest(docs).collect(), key=lambda r: r.doc_id or 0)
    for row, text in zip(got, texts):
        ids = encoding.encode_ordinary(text or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes).decode() for r in bp.decode(bp.encode(docs)).collect()}
    assert [back[k or None] for k in range(len(texts))] == [t or "" for t in texts]
    assert bp.digest(docs.where("false")).count() == 0


def test_half_a_character(spark, encoding):
    ids = encoding.encode_ordinary("\U0001f600")
    rows = spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in bp.decode(rows).collect()} == {1: encoding.decode_bytes(ids[:1]), 2: b""}


def test_size_of_the_rank_file_is_checked(spark, monkeypatch):
    monkeypatch.setattr(bp, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="more than 10 bytes"):
        bp.digest(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
