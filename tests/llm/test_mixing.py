import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeseam.llm import mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """sizes: source -> words; the rule as it is told: cap, reshare, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, target, left = set(names), {}, share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(docs, got):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes, per = Counter(), {}
    for r in rows:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
        per.setdefault(r.doc_id, []).append((r.source, len(WORDS.findall(r.text or ""))))
    want = brute_targets(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        source = next(s for s, n in per[r.doc_id] if n == r["size"])
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_targets_and_whole_mix(spark, make_docs, sample):
    got = mixing.op9(sample).collect()
    check(sample, got)
    assert sorted(map(tuple, ((r.doc_id, r.taken, *r.shards) for r in got))) == sorted(
        map(tuple, ((r.doc_id, r.taken, *r.shards) for r in mixing.op9(sample.repartition(5)).collect()))
    )


def test_hot_source_nulls_ties_empty(spark, make_docs):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    rows += [(None, "a b c", None), (None, "a b c", None), (5, None, "nul"), (6, "", "s1"), (7, "x y \x1cz", "é"), (1, rows[1][1], "hot")]
    docs = make_docs(rows, extra=True)
    plain = mixing.mix(docs.drop("lang"), bucket_rows=64, block=32, shards=5)
    assert plain.count() == len(rows)
    check(docs, mixing.op9(docs).collect())
    assert mixing.op9(make_docs([])).count() == 0


def test_blocks_are_disjoint_and_quotas_exact(spark, make_docs):
    rng = random.Random(4)
    docs = make_docs([(i, " ".join(["w"] * rng.randint(1, 40)), f"s{i % 4}") for i in range(500)])
    got = mixing.mix(docs, shards=6, block=64).select("doc.source", "mix_target", F.explode("mix_draws").alias("d")).collect()
    by_shard = defaultdict(Counter)
    for r in got:
        by_shard[r.d["shard"]][r.source] += r.d["to"] - r.d["from"]
    assert set(by_shard) <= set(range(6))
    total = Counter()
    for c in by_shard.values():
        total += c
    for r in got:
        assert total[r.source] == int(r.mix_target + 0.5)


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).select(mixing.swap_or_not(F.col("id"), F.lit(n), F.lit(9)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_hypergeometric_follows_its_law(spark):
    import math

    n, k, m, count = 50, 20, 15, 20000
    df = spark.range(count).select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(m), (F.col("id") + 0.5) / count).alias("x"))
    seen = Counter(r.x for r in df.collect())
    for x in range(max(0, m - n + k), min(m, k) + 1):
        p = math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
        assert seen[x] == pytest.approx(p * count, abs=2)


def test_mixed_documents(spark, sample):
    out = mixing.mixed_documents(sample)
    assert out.columns == sample.columns
    whole = {r.doc_id: r.text for r in sample.collect()}
    cut = 0
    for r in out.collect():
        words, of = WORDS.findall(r.text), WORDS.findall(whole[r.doc_id])
        assert words == of[: len(words)] and r.n_chars == len(r.text)
        cut += r.text != whole[r.doc_id]
    assert cut <= 2 * 20


def test_many_sources_and_shards(spark, make_docs, monkeypatch):
    """Ranges of sources are split before sources; quotas stay exact."""
    rng = random.Random(5)
    docs = make_docs([(i, " ".join(["w"] * rng.randint(1, 30)), f"s{rng.randint(0, 69)}") for i in range(1500)])
    sizes = docs.select(F.col("source").isNull().alias("is_null"), "source", mixing.word_count(F.col("text")).alias("n")).groupBy("is_null", "source").agg(F.count("*").alias("rows"), F.sum("n").alias("words"))
    targets = mixing.source_targets(sizes)
    blocks = {r.idx: r.n for r in targets.select("idx", mixing.block_count(F.col("target"), 16).alias("n")).collect()}
    for shards in (1, 3, 11):
        got = mixing.shard_quotas(targets, shards, 16, 1, fan=4).collect()
        per_source, per_shard = Counter(), Counter()
        for r in got:
            per_source[r.idx] += r.quota
            per_shard[r.shard] += r.quota
        assert per_source == Counter({k: v for k, v in blocks.items() if v})
        assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) == shards
    monkeypatch.setattr(mixing, "CHUNK", 3)
    check(docs, mixing.mix(docs, shards=7, block=16, keep=["doc_id"]).select(F.col("doc.doc_id").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["to"] - d["from"]).alias("taken")).collect())
    found = mixing.mix(docs, shards=7, block=16).select(F.explode("mix_draws").alias("d")).select("d.shard").groupBy("shard").count().collect()
    assert {r.shard for r in found} == set(range(7))


def test_shards_grow_with_the_words(spark, make_docs):
    docs = make_docs([(i, "w " * 100, "s") for i in range(40)])
    shards = {r.shard for r in mixing.mix(docs, shard_words=1000, block=64).select(F.explode("mix_draws").alias("d")).select("d.shard").collect()}
    assert shards == set(range(6))
