from __future__ import annotations

import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cresset.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.TOKENIZER), reason="no vocabulary here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def encoder():
    with open(E.TOKENIZER, "rb") as f:
        return E.TrieEncoder(f.read())


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    with open(E.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = " \n\t 'sdtrelmvSé ß日本の東１²½a1b2  !?-_(.\U0001f600́‍дж"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(SIGNS, max_size=40), max_size=5))
def test_ids_are_those_of_the_library(encoder, peer, texts):
    assert E.encode_texts(encoder, texts).to_pylist() == [peer.encode_ordinary(t) for t in texts]


def test_long_words_and_texts(encoder, peer, monkeypatch):
    random.seed(4)
    monkeypatch.setattr(E, "_PIECE", 200)
    texts = ["a" * 3000, "".join(random.choices("abcé日本 \n,.'s", k=5000)), " " * 700, "word " * 900, None, ""]
    assert E.encode_texts(encoder, texts).to_pylist() == [peer.encode_ordinary(t or "") for t in texts]


def test_table(spark, peer):
    texts = ["two words", None, "", "two words", "x'll don't", "<|endoftext|>"]
    df = spark.createDataFrame([(i % 5, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in E.encode_corpus(df).collect())
    assert got == sorted((i % 5, peer.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert E.encode_corpus(df.limit(0)).collect() == []
    assert E.encode_corpus(df).columns == ["doc_id", "ids"]


def test_the_words_remembered_are_bounded(encoder, peer, monkeypatch):
    monkeypatch.setattr(E, "_REMEMBERED", 3)
    for t in ("one two three four five", "six seven", "one six"):
        assert E.encode_texts(encoder, [t]).to_pylist() == [peer.encode_ordinary(t)]
