import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeseam.llm import tokencount as tc

PATH = tc.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


PARTS = ["the", " the", "'re", "'ll", "'ve", "'s", "'r", "'", "  ", " ", "\n", "\n\n", "\t", " \n ", "é", "日本", "😀", "12", "²", "--", "!", "?'", "<|endoftext|>", "<|endo", "<|", "xyzzy", " ", "ſ", "\r\n"]


@given(st.lists(st.sampled_from(PARTS), max_size=9))
@settings(max_examples=300, deadline=None)
def test_every_prefix_counts_as_the_library_does(parts):
    c, text = tc.counter(PATH), "".join(parts)
    counts = c.prefix_counts(text)
    assert counts == [library(text[:j]) for j in range(len(text) + 1)]
    assert c.count(text) == counts[-1]
    steps, table = c.table(text)
    assert table.tolist() == counts and tc.counts_of(steps).tolist() == counts
    for budget in range(counts[-1] + 1):
        assert c.fitting(text, budget) == max(j for j, n in enumerate(counts) if n <= budget)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert tc.counter(PATH).prefix_counts(text) == [library(text[:j]) for j in range(len(text) + 1)]


def test_query(spark, make_docs, sample):
    docs = make_docs([None, "", "a", "a", "word " * 3000, "z" * 5000, "a<|endoftext|>b"], extra=True).unionByName(sample, allowMissingColumns=True)
    want = []
    for r in docs.collect():
        t = r.text or ""
        n = library(t)
        want.append((r.doc_id, len(t.encode()), n, n > 512))
    got = tc.op5(docs).collect()
    assert sorted(tuple(r[:4]) for r in got) == sorted(want)
    texts = {r.doc_id: r.text for r in sample.collect()}
    long = [r for r in tc.op5(sample).collect() if r.over_limit][:20]
    for r in long:
        t = texts[r.doc_id]
        assert library(t[: r.fitting_chars]) <= 512 < min(library(t[: r.fitting_chars + k]) for k in range(1, 9))
    assert tc.op5(make_docs([])).count() == 0
    from pyspark.sql import functions as F

    asked = tc.op5(sample).select("doc_id", tc.tokens_of_prefix("prefix_table", F.lit(300)).alias("n"), tc.chars_within("prefix_table", F.lit(40)).alias("chars"))
    for r in asked.limit(40).collect():
        t = texts[r.doc_id]
        assert r.n == library(t[:300]) and library(t[: r.chars]) <= 40
        assert r.chars == len(t) or min(library(t[: r.chars + k]) for k in range(1, 9)) > 40
    out = tc.count_tokens(make_docs(["héllo wörld"], extra=True), prefixes=True).first()
    assert out.prefix_tokens == [library("héllo wörld"[:j]) for j in range(12)] and out.key == "clash"


def test_steps_of_any_size():
    import numpy as np

    steps = np.array([0, 1, 127, -127, 128, -128, 70000, -70000, 3])
    assert tc.decode_steps(tc.encode_steps(steps)).tolist() == steps.tolist() and tc.counts_of(b"").tolist() == [0]


@pytest.mark.parametrize("text", ["a" * 700, "ab" * 300, " " * 400])
def test_long_pieces(text):
    assert tc.counter(PATH).count(text) == library(text)
