import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeseam.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.default_vocabulary())


@pytest.fixture
def small_leaves(monkeypatch):
    """Many seams even in short texts."""
    monkeypatch.setattr(bpe, "LEAF_CHARS", 3)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 2)
    monkeypatch.setattr(bpe, "LEAF_IDS", 2)


WORDS = ["the", " the", "'re", "'s", "don't", "  ", "\n", " \n\n", "\t", "é", "ß", "日本語", "😀", "123", "4,5", "--", "...", "a" * 40, " ", "\x1c", "x'", "'ll've", "𝟙²", "<|endoftext|>", "ab" * 30, " ", "\r\n"]


@given(st.lists(st.sampled_from(WORDS), max_size=40))
@settings(max_examples=400, deadline=None)
def test_tree_equals_library(parts):
    c = bpe.codec(*bpe.default_vocabulary())
    old = bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.LEAF_IDS
    bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.LEAF_IDS = 3, 2, 2
    try:
        text = "".join(parts)
        ids = c.encode(text)
        assert ids == c.base.encode_ordinary(text)
        assert c.decode(ids) == text.encode()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.LEAF_IDS = old


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    c = bpe.codec(*bpe.default_vocabulary())
    old = bpe.LEAF_CHARS, bpe.LEAF_BYTES
    bpe.LEAF_CHARS, bpe.LEAF_BYTES = 2, 2
    try:
        assert c.encode(text) == c.base.encode_ordinary(text)
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = old


def test_long_runs(codec, small_leaves):
    rng = random.Random(1)
    for text in ("a" * 3000, "ab" * 999, "".join(rng.choice("abcdeé") for _ in range(4000)), " " * 2000, "\n" * 999 + "x"):
        assert codec.encode(text) == codec.base.encode_ordinary(text)
    assert codec.piece(b"abcab" * 500) == codec.single(b"abcab" * 500)


def test_query(spark, make_docs, sample, codec):
    docs = make_docs([None, "", "a", "a", "the cat's " * 5000, "x" * 20000], extra=True).unionByName(sample, allowMissingColumns=True)
    want = []
    for r in docs.collect():
        ids = codec.base.encode_ordinary(r.text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode())))
    assert sorted(map(tuple, bpe.op3(docs).collect())) == sorted(want)
    assert bpe.op3(make_docs([])).count() == 0
    out = bpe.encode_documents(make_docs(["héllo"], extra=True)).first()
    assert bytes(out.decoded).decode() == "héllo" and out.n_tokens == len(out.ids) and out.key == "clash"
