import random

import numpy as np
import xxhash

from codeseam.llm import simhash
from codeseam.llm.components import components, local_labels


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", words)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if (rows[x][1] ^ rows[y][1]).bit_count() <= 3:
                root[find(x)] = find(y)
    least = {}
    for x in range(len(rows)):
        least[find(x)] = min(least.get(find(x), ids[x]), ids[x])
    return {ids[x]: least[find(x)] for x in range(len(rows))}


def test_query_against_brute_force(spark, make_docs, sample):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(200)) for _ in range(6)]
    texts = [None, "", " \n", "one", "One", "one two", "one\x1ctwo", "É é", "ÀB c d e"]
    for b in base:
        words = b.split()
        for _ in range(12):
            w = list(words)
            w[rng.randrange(200)] = "zz"
            texts.append(" ".join(w))
    docs = make_docs([(10_000 - i, t, "s") for i, t in enumerate(texts)], extra=True).unionByName(sample, allowMissingColumns=True)
    rows = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    want = brute_components(rows)
    got = simhash.op4(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fp:016x}", want[i]) for i, fp in rows)
    assert simhash.op4(make_docs([])).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_tiles_lose_no_link():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 64, 700, dtype=np.uint64)
    near = words[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    both = np.unique(np.concatenate((words, near)))
    a, b = both[::2], both[1::2]
    u, v = simhash.compare_files(a, b, False, 3, tile=16)
    x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)
    n = len(both)
    want = local_labels(n, x, y + len(a))
    assert np.array_equal(local_labels(n, u, v), want) and len(u) < n


def test_components_of_chains(spark):
    rng = random.Random(5)
    chain = list(range(0, 4000, 7))
    links = [(a, b) for a, b in zip(chain, chain[1:])] + [(-5, -9), (-9, 3)] + [(9001, x) for x in range(9002, 9300)]
    rng.shuffle(links)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 0 for x in chain} | {-5: -9, -9: -9, 3: -9} | {x: 9001 for x in range(9001, 9300)}


def test_long_and_repeated():
    text = "w1 w2 w3 w4 " * 9000
    assert simhash.fingerprint(text) == brute_fp(text)


def test_one_document_stays_of_each_group_whatever_the_ids(spark, make_docs):
    rng = random.Random(3)
    a, b, c, d, e, f = (" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(200)) for _ in range(6))
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (None, c, "s"), (7, c, "s"), (8, d, "s"), (8, e, "s"), (8, e, "s"), (9, e, "s"), (7, f, "s"), (-(1 << 63), d, "s"), (0, "", "s"), (None, None, "s")]
    kept = simhash.drop_near_duplicates(make_docs(rows, extra=True))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, a), (None, b), (7, c), (-(1 << 63), d), (8, e), (7, f), (0, "")], key=repr)
    assert {x.doc_id for x in simhash.drop_near_duplicates(make_docs([(3, a, "s"), (3, b, "s")])).collect()} == {3}
    assert simhash.drop_near_duplicates(make_docs([(3, a, "s"), (3, b, "s")])).count() == 2
