import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeseam.llm import lm

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORDS.findall((text or "").encode().lower()) + ["</s>"]


class Brute:
    """Order 3: trigrams as they occur; pairs by the words before them, but those at
    a text's start as they occur; words by the words before them."""

    def __init__(self, texts):
        self.uni, self.tri, start = Counter(), Counter(), Counter()
        for t in texts:
            w = words(t)
            self.uni.update(w)
            self.tri.update(zip(["<s>", *w], w, w[1:]))
            start[w[0]] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.bi = Counter((b, c) for _, b, c in self.tri)
        self.bi.update({("<s>", w): c for w, c in start.items()})
        self.cont = Counter(w for _, w in self.bi)
        self.after = [{}, {}]
        for k, table in enumerate((self.bi, self.tri)):
            for gram, c in table.items():
                self.after[k].setdefault(gram[:-1], []).append(c)
        of = lambda values: lm._discounts([sum(c == i for c in values) for i in range(1, 5)])
        self.d = [of(self.bi.values()), of(self.tri.values())]
        self.e = of(self.cont.values())
        self.back = sum(self.e[min(x, 3) - 1] for x in self.cont.values()) / max(1, len(self.bi))
        self.sums = [{c: (sum(f), sum(d[min(x, 3) - 1] for x in f)) for c, f in after.items()} for after, d in zip(self.after, self.d)]

    def low(self, w):
        if not self.bi:
            return 1 / (self.v + 1)
        c, n = self.cont[w], len(self.bi)
        return (c - self.e[min(c, 3) - 1] if c else 0) / n + self.back / (self.v + 1)

    def p(self, context, w):
        if not context:
            return self.low(w)
        lower, k = self.p(context[1:], w), len(context) - 1
        if context not in self.sums[k]:
            return lower
        total, back = self.sums[k][context]
        c, d = (self.bi, self.tri)[k][(*context, w)], self.d[k]
        return ((c - d[min(c, 3) - 1] if c else 0) + back * lower) / total

    def row(self, text):
        w = words(text)
        base = sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        own = [self.p(("<s>",), w[0])] + [self.p(c, x) for c, x in zip(zip(["<s>", *w], w), w[1:])]
        return len(w), sum(x in self.uni for x in w), self.n, base, sum(map(math.log10, own))


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    brute = Brute([t for i, t in rows if not held_out(i)])
    got = sorted(lm.op2(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score))
    want = sorted(((i, held_out(i), *brute.row(t)) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])
    return brute


def test_against_brute_force(spark, make_docs, sample):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "A a É é\x1cx\xa0y", "the end"] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(60)] * 2
    brute = check(make_docs([*texts, (None, "a b", None), (None, None, None)], extra=True))
    for context in ((b"a",), ("<s>",), (b"a", b"b"), ("<s>", b"a"), (b"zz", b"a"), ()):
        assert sum(brute.p(context, w) for w in [*brute.uni, "unknown"]) == pytest.approx(1)
    check(sample)


def test_empty_and_small(spark, make_docs):
    assert lm.op2(make_docs([])).count() == 0
    check(make_docs([(0, "x", "s")]))
    check(make_docs([(i, "x y", "s") for i in range(30) if held_out(i)]))


def test_hot_words_are_salted(spark, make_docs):
    docs = make_docs([" ".join(f"the w{(i * j) % 97}" for j in range(60)) for i in range(50)])
    plain, hot = lm.train(docs.select("text"), parts=8), lm.train(docs.select("text"), parts=8, hot=50)
    scores = lambda m: sorted((r.doc_id, r.score) for r in lm.score(docs.select("doc_id", "text"), m).collect())
    assert np.allclose(scores(hot), scores(plain))
    number, _ = hot.vocabulary.numbers(lm.Arrays(hot.vocabulary.folder), lm.word_hashes(np.frombuffer(b"the", np.uint8), np.zeros(1, np.int64))[0])
    arrays = lm.Arrays(hot.vocabulary.folder)
    assert hot.vocabulary.salts(arrays, number)[0] > 8
    every = np.arange(hot.vocabulary.size + 1)
    contexts = lm.pair_key(every, np.repeat(number, len(every)))
    parts = [p for p in range(8) if len(arrays.find("triple", p, "pair", contexts)[0])]
    assert len(parts) > 4


def test_held_out_texts_score_better_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.op2(docs).filter("held_out").agg(F.avg("score").alias("own"), F.avg("base_score").alias("base")).first()
    assert r.own > r.base
    # the partial counts of small chunks and of a few parts are those of one
    few = lm.train(docs.limit(300).select("text"), parts=1)
    many = lm.train(docs.limit(300).select("text"), parts=64)
    key = lambda m: sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in lm.score(docs.limit(300).select("doc_id", "text"), m).collect())
    assert key(few) == key(many)


def test_long_texts_in_stretches(monkeypatch):
    text = "alpha Beta\n" * 500 + "x" * 3000 + " end"
    whole = [t.tolist() for _, _, t, _ in lm.token_chunks(pa.array([text, "b"]))]
    monkeypatch.setattr(lm, "CHUNK", 256)
    cut = [t.tolist() for _, _, t, _ in lm.token_chunks(pa.array([text, "b"]))]
    assert sum(whole, []) == sum(cut, [])


def test_packing():
    rng = np.random.default_rng(0)
    k = np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    c, d = rng.integers(1, 1 << 40, len(k)), rng.integers(0, 200, len(k))
    assert all(np.array_equal(a, b) for a, b in zip(lm.unpack(lm.pack([k, c, d])), (k, c, d)))
    assert [len(x) for x in lm.unpack(lm.pack([k[:0], c[:0]]))] == [0, 0]


def test_counts_of_any_size(tmp_path):
    a = np.array([0, 1, 254, 255, 256, 1 << 40, 7])
    lm.put(str(tmp_path), "x", 3, {"k": np.arange(5, dtype=np.uint64)} | lm.small("n", a))
    arrays = lm.Arrays(str(tmp_path))
    assert arrays.at("x", 3, "n", np.array([5, 0, 3, 6, 2, 4])).tolist() == [1 << 40, 0, 255, 7, 254, 256]
    assert arrays.get("x", 3, "k", np.uint64).tolist() == [0, 1, 2, 3, 4] and len(arrays.get("x", 4, "k")) == 0


def test_hashed_keys_are_found(tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        lm.put(str(tmp_path), "x", n, lm.hashed("k", keys))
        asked = np.concatenate((rng.permutation(keys), rng.integers(0, 1 << 64, 2000, dtype=np.uint64)))
        rows, at = lm.Arrays(str(tmp_path)).find("x", n, "k", asked)
        assert sorted(rows) == list(range(len(keys))) and np.array_equal(keys[at], asked[rows])


def test_rows_of_large_numbers():
    big = np.array([1 << 40, 1, 1 << 40, 5])
    rows, counts = lm._distinct([big, big], 1 << 41, return_counts=True)
    assert [r.tolist() for r in rows] == [[1, 5, 1 << 40]] * 2 and counts.tolist() == [1, 1, 2]
    keys, n = lm.summed([big.astype(np.uint64), np.zeros(4, np.uint64), np.zeros(4, np.uint64)], np.ones(4, np.uint64))
    assert keys[0].tolist() == [1, 5, 1 << 40] and n.tolist() == [1, 1, 2]
