"""Small fixtures with known answers for operators the catalogue doesn't pin down."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeseam.functions import text as T
from codeseam.operators import cluster, deps, extract, graph, index, matches, names, refs, search, similarity
from codeseam.sources import files, sinks
from codeseam.streaming import events as ev


@pytest.fixture
def fruit(spark):
    rows = [("r", 1, "a.txt", "md", ["main"], "apple banana"), ("r", 2, "b.txt", None, ["main"], "banana cherry"), ("r", 3, "needle_name.txt", "rust", ["feature"], "cherry date")]
    return spark.createDataFrame(rows, "repo string, doc_id long, path string, lang string, branches array<string>, content string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_search_modes(fruit):
    find = lambda line, **k: ids(search.search(fruit, line, **k))
    assert find("banana") == [1, 2] and find("needle_name") == [3] and find("path:only banana") == []
    assert find("branch:feature") == [3] and find("lang:rust cherry") == [3] and find("file:b.txt") == [2] and find("file:*.txt cherry") == [2, 3]
    assert find("repo:nope.* banana") == [] and find("re:yes a(b") == [] and find("re:yes ^apple") == [1] and find("re:yes date$") == [3]
    assert find("select:repo banana") == [0]
    assert find("case:yes Banana") == []


def test_term_first(spark, fruit):
    more = fruit.union(spark.createDataFrame([("r", 4, "d", None, ["main"], "bananas")], fruit.schema))
    assert ids(search.search(more, "banana")) == [1, 2]
    assert ids(search.search(more, "banana", mode="substring")) == [1, 2, 4]
    assert ids(search.search(more, "anana")) == [1, 2, 4]


def test_trigrams_and_positions(spark):
    df = spark.createDataFrame([("ÉAbC_1 ab xyz",)], "content string")
    r = df.select(T.trigrams(F.col("content")).alias("t"), T.trigram_positions(F.col("content")).alias("p")).first()
    assert r.t == ["abc", "bc_", "c_1", "xyz"] and [(x.tri, x.byte) for x in r.p] == [("abc", 2), ("bc_", 3), ("c_1", 4), ("xyz", 11)]


def test_text_functions(spark):
    df = spark.createDataFrame([("a.rs", "git@h.org:o/p/r.git", bytearray(b"ok")), ("b.H", "https://u:p@h.org/o/r", bytearray(b"")), ("x", "r", bytearray(b"a\0b"))], "p string, u string, c binary")
    rows = df.select(T.language(F.col("p")), T.normalise_git_url(F.col("u")), T.owner_of(F.col("u")), T.repo_name(F.col("u")), T.is_text(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("rust", "https://h.org/o/p/r", "o/p", "r", True), ("c", "https://h.org/o/r", "o", "r", False), (None, "r", "", "r", False)]


def test_matches_lines_and_snippets(spark, fruit):
    d = spark.createDataFrame([("r", 1, "p", None, ["main"], "é one\ntwo tok three\nlast tok")], fruit.schema)
    m = matches.matches(d, "tok", context=2).orderBy("start_byte").collect()
    assert [(r.line, r.start_byte, r.end_byte, r.before, r.line_text, r.after) for r in m] == [(2, 11, 14, "…o ", "two tok three", " t…"), (3, 26, 29, "…t ", "last tok", "")]
    s = matches.snippets(d, "one", 0).first().snippet
    assert s == "     1 > é one\n"
    assert [r.text for r in matches.lines(d).orderBy("line").collect()] == ["é one\n", "two tok three\n", "last tok"]
    assert matches.matches(d, "o(", regex=True).count() == 0


def test_index_round_trip(spark, fruit, tmp_path):
    syms = spark.createDataFrame([("r", 1, "Apple", 0, 1)], "repo string, doc_id long, name string, start int, line int")
    index.write_index(fruit, syms, str(tmp_path / "ix"))
    t = index.open_index(spark, str(tmp_path / "ix"))
    assert ids(index.indexed_literal(t["docs"], t["content_tri"], "cherry")) == [2, 3]
    assert t["terms"].filter("token = 'banana'").count() == 2 and t["symbol_tri"].filter("tri = 'app'").count() == 1


def brute_pagerank(nodes, edges, d=0.85, rounds=10):
    w = {"call": 1.0, "import": 0.5, "containment": 0.25}
    out = {n: {} for n in nodes}
    for s, t, k in edges:
        out[s][t] = out[s].get(t, 0) + w[k]
        if k == "containment":
            out[t][s] = out[t].get(s, 0) + w[k]
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        dangling = sum(r[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, (1 - d) / len(nodes) + d * dangling / len(nodes))
        for s in nodes:
            for t, x in out[s].items():
                new[t] += d * r[s] * x / sum(out[s].values())
        r = new
    return {n: x / sum(r.values()) for n, x in r.items()}


def test_pagerank(spark):
    e = [(0, 1, "call"), (0, 2, "call"), (1, 2, "call"), (2, 3, "containment"), (1, 3, "import"), (0, 1, "call")]
    edges = spark.createDataFrame(e, "src long, dst long, kind string")
    nodes = spark.range(5).withColumnRenamed("id", "node")
    got = {r.node: r.rank for r in graph.pagerank(edges, nodes, eps=0.0).collect()}
    assert got == pytest.approx(brute_pagerank(range(5), e))
    flat = {r.rank for r in graph.pagerank(edges, nodes, damping=0.0).collect()}
    assert flat == {0.2} and graph.pagerank(edges.limit(0), nodes.limit(0)).count() == 0


def test_names_and_summaries(spark):
    rows = [(1, "Foo", "class", "r", "p", 1.0, "py", [("bar", 7)]), (2, "foobar", "function", None, "q", 3.0, None, []), (3, "fo", "file", "r", "p", 2.0, "py", [])]
    e = spark.createDataFrame(rows, "stable_id long, name string, kind string, repo string, path string, rank double, lang string, methods array<struct<name:string,start_line:int>>")
    assert [(r.stable_id, r.found_line) for r in names.exact(e, "BAR").collect()] == [(1, 7)]
    assert [r.stable_id for r in names.fuzzy_ranked(e, "foo").collect()] == [2, 1]
    assert [tuple(r) for r in names.repo_summaries(e).collect()] == [("r", 2, 1, ["py"]), ("unknown", 1, 1, [])]


def test_cluster_layers(spark):
    rows = [(f"e{i}", "r1" if i % 2 else "r2", [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), 0.01 * i]) for i in range(12)]
    s = spark.createDataFrame(rows, "stable_id string, repo string, embedding array<double>")
    got = {}
    for r in cluster.kmeans(s, 3).collect():
        got.setdefault(r.cluster, set()).add(int(r.stable_id[1:]) % 3)
    assert all(len(v) == 1 for v in got.values()) and len(got) == 3
    first = cluster.first_layer(s, 3)
    assert sorted(len(r.members) for r in first.collect()) == [4, 4, 4]
    assert {r.relation for r in cluster.cluster_relations(first).collect()} == {"has_member"}
    top, hit = cluster.retrieve(s, first, [1.0, 0.0, 0.0, 0.0], 2)
    assert [r.stable_id for r in top.collect()] == ["e0", "e3"] and hit.count() == 1


def test_duplicates_page(spark):
    pairs = [("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.7)]
    e = spark.createDataFrame(pairs, "src string, dst string, score double")
    ent = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", "r2")], "stable_id string, repo string")
    assert [(r.a, r.b) for r in similarity.duplicate_pairs(e, ent, "r1").collect()] == [("a", "b")]
    assert [(r.a, r.b) for r in similarity.duplicate_pairs(e, ent, "r1", external=True, limit=1, offset=1).collect()] == [("b", "c")]
    vec = spark.createDataFrame([("a", "r", [1.0, 0.0]), ("b", "r", [1.0, 0.01]), ("c", "q", [1.0, 0.0]), ("d", "r", [0.0, 0.0]), ("e", "r", [1.0])], "stable_id string, repo string, embedding array<double>")
    assert [(r.src, r.dst) for r in similarity.similar_edges(vec, "same").collect()] == [("a", "b")]
    assert sorted((r.src, r.dst) for r in similarity.similar_edges(vec, "external", rows_a_block=2).collect()) == [("a", "c"), ("b", "c")]


def test_dependencies(spark):
    rows = [("r", "Cargo.toml", '[dependencies]\na = "1"\nb = { version = "2", features = [] }\n[dev-dependencies]\nc = { path = "x" }\n'), ("r", "requirements.txt", "x>=1\n-e y\n"), ("r", "pyproject.toml", "[project]\nname='n'\n"), ("r", "sub/Cargo.toml", "[dependencies]\nz='1'\n"), ("s", "Cargo.toml", "not toml [")]
    got = deps.dependencies(spark.createDataFrame(rows, "repo string, path string, content string"))
    assert sorted((r.name, r.version, r.language) for r in got.collect()) == [("a", "1", "rust"), ("b", "2", "rust"), ("c", None, "rust"), ("x", "1", "python")]
    g = deps.gradle_rows('dependencies {\n  implementation("g:n:1") { exclude x }\n  api project(":p")\n}\n')
    assert [(x[0], x[3], x[5]) for x in g] == [("implementation", "n", 2), ("api", ":p", 3)]


def test_refs(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 0, "w"), ("c", 1, "n")], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in refs.upsert(old, new, ["k"], "t").collect()) == [("a", "z"), ("b", "y"), ("c", "n")]


def test_symbols(spark, fruit):
    d = spark.createDataFrame([("r", 1, "a.py", None, [], "x = 1\ndef été():\n  class B: pass\n"), ("r", 2, "b.go", None, [], "func (r *T) Do() {}\nfunc Go() {}")], fruit.schema)
    got = sorted((r.doc_id, r.start, r.name, r.line) for r in extract.symbols(d).collect())
    assert got == [(1, 10, "été", 2), (1, 27, "B", 3), (2, 12, "Do", 1), (2, 25, "Go", 2)]


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    for name, body in [(".gitignore", "build\n*.log\n"), ("src/a.py", "x"), ("x.log", "l"), ("build", "b"), (".hidden", "h"), ("empty.md", "")]:
        (root / name).write_text(body)
    got = {r.path: (r.lang, r.is_text) for r in files.working_tree(spark, str(root)).collect()}
    assert got == {"src/a.py": ("python", True), "empty.md": ("markdown", False)}
    csv = tmp_path / "reg.csv"
    csv.write_text("# note\nname,url,branch,frequency\na,http://x/a\nb,http://x/b,dev,60\nc,http://x/c,dev,often\nbad\n")
    ok, bad = files.registry_csv(spark, str(csv))
    assert sorted((r.name, r.branches, r.frequency) for r in ok.collect()) == [("a", "main", None), ("b", "dev", 60)] and bad.count() == 2
    table = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, t int")
    for _ in range(2):
        sinks.merge_table(spark, table, rows, ["k"], "t")
    assert sinks.read_table(spark, table).count() == 2
    e, _ = extract.code_graph(spark.createDataFrame([("r", "m.py", "import os\ndef f():\n  pass\n")], "repo string, path string, content string"))
    lines = [json.loads(r.value) for r in sinks.entity_lines(e).collect()]
    assert sorted((x["kind"], x["start_line"]) for x in lines) == [("file", 1), ("function", 2)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"event_type": "indexing_finished", "repo_name": "r", "timestamp": 1000 * i} for i in range(3)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n" + json.dumps({"event_type": "other", "repo_name": "q"}))
    seen = []
    q = ev.ingest(files.event_stream(spark, str(src)), {"indexing_finished": lambda df, n: seen.append(df.count())}, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == 3 and os.path.exists(tmp_path / "cp")
    state, out = ev.lease_steps(None, [(0, "acquire", "a", 10), (5, "acquire", "b", 10), (6, "renew", "a", 10), (20, "acquire", "b", 5), (21, "release", "a", 0), (22, "release", "b", 0)])
    assert [o[3] for o in out] == [True, False, True, True, False, True] and state is None
