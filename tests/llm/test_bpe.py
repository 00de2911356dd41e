"""Encoding beside the library that the ranks come from, and exact round trips."""

import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
OURS = bpe.load(PATH, PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})


def ids(text):
    packed = OURS.encode(text)
    assert OURS.decode(packed) == text.encode()
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_each_token_encodes_to_itself():
    assert all(OURS._merge(token) == [rank] for token, rank in OURS.ranks.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert ids(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("leaves", [(8, 2), (37, 5), (1 << 15, 16)])
def test_any_cut(monkeypatch, leaves):
    monkeypatch.setattr(bpe, "TEXT_LEAF", leaves[0])
    monkeypatch.setattr(bpe, "BYTE_LEAF", leaves[1])
    r = random.Random(5)
    kinds = ["abcdefgh", "aab", " '\nres tldm", " \t\n", "éñü¿日本語", "0123456789", "aaaa"]
    for _ in range(1500):
        OURS._pieces.clear()
        text = "".join(r.choice(r.choice(kinds)) for _ in range(r.choice([2, 10, 60, 200])))
        assert ids(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 9_001 + "x", "'" * 999 + "re" * 99, "<|endoftext|>", "x" * 40_000 + " y" * 40_000])
def test_long_runs(text):
    assert ids(text) == THEIRS.encode_ordinary(text)


def test_tables(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.decode_ids(bpe.encode_texts(df, PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, bytes(r.decoded)) for r in out] == [(1, 2, b"Hello world"), (1, 2, b"Hello world"), (2, 0, b""), (3, 0, b"")]
    assert bpe.encode_texts(df.limit(0), PATH, PATTERN).count() == 0
