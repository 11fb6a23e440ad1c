"""What graph operators make once, and only once."""

import pytest

from codeseam.operators import extract, graph
from tests.test_operators import brute_pagerank


def test_sources_are_parsed_once(spark):
    files = spark.createDataFrame([("r", "a.py", "def f():\n    return g()\n\ndef g():\n    pass\n")], "repo string, path string, content string")
    e, x = extract.code_graph(files)
    for df in (e, x):
        assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.kind for r in x.collect()] == ["call"] and e.count() == 3


def test_reach_over_repeated_edges_is_written_by_level(spark):
    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), (None, "a"), ("b", None)]
    edges = spark.createDataFrame([(*r, "call") for r in rows] + [("a", "z", "import")], "src string, dst string, kind string")
    found = graph.reachable(edges, "a", 5)
    assert sorted(map(tuple, found.filter("node IS NOT NULL").collect())) == [("b", 1), ("c", 2), ("d", 3)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, graph.reachable(edges, "d", 2, forward=False).collect())) == [("b", 2), ("c", 1)]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_ranks_by_chunks_of_targets(spark, chunk, monkeypatch):
    kinds = ("call", "import", "containment")
    e = [(i, (i * i + 3) % 23, kinds[i % 3]) for i in range(20)] + [(1, 2, "call"), (1, 2, "import"), (5, 5, "call")]
    edges = spark.createDataFrame([(f"n{s}", f"n{t}", k) for s, t, k in e], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(25)], "node string")
    shuffled = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: shuffled.append(1) or real(df))
    got = {r.node: r["rank"] for r in graph.pagerank(edges, nodes, eps=0.0, chunk=chunk).collect()}
    assert got == pytest.approx({f"n{i}": x for i, x in brute_pagerank(range(25), e).items()})
    assert len(shuffled) == 2  # nodes are written and numbered, rounds write no tables


def test_edges_that_leave_the_nodes_take_their_share_along(spark):
    edges = spark.createDataFrame([("a", "b", "call"), ("a", "x", "call"), ("y", "a", "call")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    got = {r.node: r["rank"] for r in graph.pagerank(edges, nodes, iterations=1).collect()}
    # a: 0.075 + 0.85 * b's mass over both; b: that and half of a's
    a, b = 0.075 + 0.85 * 0.25, 0.075 + 0.85 * 0.25 + 0.85 * 0.25
    assert got == pytest.approx({"a": a / (a + b), "b": b / (a + b)})
