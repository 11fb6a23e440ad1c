"""Posting lists by segments against a plain scan of the texts."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest

from codeseam import catalog
from codeseam.operators import index
from codeseam.operators import postings as P

ROWS = [
    ("r", 1, "É AbC_1 ab xyz abc"), ("r", 2, None), ("r", 3, ""), ("q", 1, "abc\nabcabc"), ("q", 4, "ab"), ("q", 5, "cab"),
    (None, 6, "ßabc é_zz"), ("r", None, "555-5555 x"), ("r", 1, "zz abc"), ("r", None, "555"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*x, "p", "en", ["main"]) for x in ROWS], "repo string, doc_id long, content string, path string, lang string, branches array<string>").select("repo", "doc_id", "path", "lang", "branches", "content")


def brute():
    out = {}
    for repo, doc_id, text in ROWS:
        for m in re.finditer(rb"[a-z0-9_]{3,}", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()):
            for i in range(m.start(), m.end() - 2):
                out.setdefault((m.string[i : i + 3].decode(), repo, doc_id), []).append(i)
    return {k: sorted(v) for k, v in out.items()}


def flat(df):
    rows = df.select("tri", "repo", "doc_id", "positions").collect()
    got = {(r.tri, r.repo, r.doc_id): r.positions for r in rows}
    assert len(got) == len(rows)
    return got


def test_trigrams_flat_and_packed(spark, odd, tmp_path):
    assert flat(index.content_trigrams(odd)) == brute()
    assert flat(index.content_trigrams(odd, ["555", "no such"])) == {k: v for k, v in brute().items() if k[0] == "555"}
    index.write_index(odd, None, str(tmp_path / "ix"), only=("content_tri",))
    assert sorted(x for x in os.listdir(tmp_path / "ix")) == ["content_tri", "meta"]
    t = index.open_index(spark, str(tmp_path / "ix"), ("content_tri",))
    assert flat(t["content_pos"]) == brute()
    assert sorted(map(repr, map(tuple, t["content_tri"].collect()))) == sorted(map(repr, brute()))
    df = {r.tri: r.df for r in index.document_frequency(t["content_tri_n"]).collect()}
    assert df == {r.tri: r.df for r in index.document_frequency(t["content_tri"]).collect()} and df["abc"] == 3


def test_postings_are_not_shuffled(odd):
    plan = index.content_trigrams(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1 and "Generate" not in plan


def test_segments_never_cut_a_document():
    keys = [1, 1, 2, 3, 3, 3, None, None, 4]
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * 9), pa.array(keys), pa.array(["abcd" * 9] * 9)], ["repo", "doc_id", "body"])
    for most in (1, 60, 120, 1 << 20):
        parts = [(t["doc_id"].to_pylist(), d) for t, d in P.segments(iter([batch.slice(0, 4), batch.slice(4)]), most)]
        assert sum((k for k, _ in parts), []) == keys
        for (a, _), (b, _) in zip(parts, parts[1:]):
            assert a[-1] != b[0]
        for k, d in parts:
            assert len(set(d.tolist())) == len(set(k)) and (np.diff(d) >= 0).all()


def test_tables_are_written_when_asked_for(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_INDEXES", {})
    made = []
    write = index.write_index
    monkeypatch.setattr(index, "write_index", lambda *a, only, **k: (made.extend(only), write(*a, only=only, **k)))
    catalog.trigram_df(spark, "/root/testdata/sf0.001")
    assert made == ["content_tri"]
    catalog.trigram_candidates(spark, "/root/testdata/sf0.001")
    catalog.indexed_literal(spark, "/root/testdata/sf0.001")
    assert made == ["content_tri", "docs"]
    with pytest.raises(KeyError):
        catalog.indexed(spark, "/root/testdata/sf0.001")["nothing"]


def test_terms_of_repeated_keys_count_once(spark, odd, tmp_path):
    index.write_index(odd, None, str(tmp_path / "ix"), only=("terms",))
    t = index.open_index(spark, str(tmp_path / "ix"), ("terms",))
    want = {}
    for repo, doc_id, text in ROWS:
        for w in re.split(r"\W+", (text or "").lower()):
            if w:
                want.setdefault(w, set()).add((repo, doc_id))
    rows = t["terms"].collect()
    assert sorted(((r.token, r.repo, r.doc_id) for r in rows), key=repr) == sorted(((w, *k) for w, ks in want.items() for k in ks), key=repr)
    assert {r.token: r.df for r in index.document_frequency(t["terms_n"], "token").collect()} == {w: len(k) for w, k in want.items()}
