"""Similarity joins against brute force, and how their work is laid out."""

import numpy as np
import pytest

from codeseam.operators import similarity


def brute(rows, same, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    repo = {i: r for i, r, _ in rows}
    out = {}
    for i in unit:
        near = sorted((-round(float(unit[i] @ unit[j]), 12), j) for j in unit if j != i and (repo[i] == repo[j]) == same and len(unit[i]) == len(unit[j]))[:k]
        for s, j in near:
            out[min(i, j), max(i, j)] = -s
    return out


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("block", [7, 64, 4096])
def test_joins_equal_brute_force(spark, same, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8))
    rows = [(f"e{i:03}", f"r{int(rng.integers(0, 5)) if i % 9 else i}", [float(x) for x in (base[i % 40] if i % 3 else base[i % 40] + 1e-9 * rng.normal(size=8))]) for i in range(180)]
    rows += [(f"f{i}", "r1", [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "stable_id string, repo string, embedding array<double>")
    scope = "same" if same else "external"
    got = {(r.src, r.dst): r.score for r in similarity.similar_edges(df, scope, max_edges=4, threshold=-1.0, rows_a_block=block, rows_a_task=5).collect()}
    assert got == pytest.approx(brute(rows, same, 4), abs=2e-12)


def test_a_task_keeps_the_best_of_all_files(spark, monkeypatch):
    """k rows a source leave the tasks, not k a source and file."""
    rng = np.random.default_rng(1)
    rows = [(i, str(i % 2), [float(x) for x in rng.normal(size=4)]) for i in range(64)]
    df = spark.createDataFrame(rows, "stable_id long, repo string, embedding array<double>")
    made = []
    real = similarity.written
    monkeypatch.setattr(similarity, "written", lambda d, name: made.append((name, real(d, name))) or made[-1][1])
    similarity.similar_edges(df, "external", rows_a_block=8, rows_a_task=4)
    tasks = dict(made)["similar-tasks"]
    starts = [(r.file, r.start) for r in tasks.collect()]
    assert len(starts) == len(set(starts)) and len({f for f, _ in starts}) > 4


def test_duplicates_elsewhere_read_the_edges_once(spark):
    e = spark.range(3).selectExpr("id AS src", "id + 10 AS dst", "0.5D AS score")
    ent = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in (0, 1, 2, 10, 11, 12)], "stable_id long, repo string")
    found = similarity.duplicate_pairs(e, ent, "b", external=True)
    assert sorted(map(tuple, found.collect())) == [(10, 0, 0.5), (11, 1, 0.5), (12, 2, 0.5)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3") == 1
