import math

import numpy as np

from codeseam.llm import topk


def brute(rows, k=5):
    part = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for q, v in part:
        if q % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in part if i != q and len(w) == len(v)))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 412)]  # ties
    rows += [(500, None), (501, [None] * 8), (550, [float("nan")] * 8), (551, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (650, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, lambda i: i % 50 == 0, per_file=64, queries_a_group=3, files_a_segment=2)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk.op10(df.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(i, [float(2**21 + i), -float(i)]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.op10(df).collect())) == brute(rows)


def test_blocks_are_read_when_their_bound_survives(tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(-50, 50, (4000, 6)), axis=0)
    ids = np.arange(4000)
    v.tofile(tmp_path / "0-6.v")
    ids.tofile(tmp_path / "0-6.id")
    np.array([(v[s : s + 100].max(axis=0), v[s : s + 100].min(axis=0)) for s in range(0, 4000, 100)]).tofile(tmp_path / "0-6.bound")
    stored, read = topk.Stored(str(tmp_path), 0, 6, 100), []

    class Seen:
        def __getitem__(self, part):
            read.append(part.start // 100)
            return v[part]

    stored.v = Seen()
    got = list(topk.search(ids[:2], v[[3999, 0]], [stored], 5, held=8 * 100 * 7 * 2))
    for q, (_, i, s) in zip(v[[3999, 0]], got):
        want = sorted(zip(-(v @ q), ids))
        want = [(x, n) for x, n in want if n != _][:5]
        assert [(-x, n) for x, n in zip(s, i)] == want
    assert 0 < len(set(read)) < 20
