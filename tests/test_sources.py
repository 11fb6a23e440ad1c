"""Trees, branches, registries, queues, tables: what goes in and out."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeseam.operators import extract, pages, relations
from codeseam.sources import files, git, ignore, sinks
from codeseam.streaming import jobs


@pytest.fixture
def clone(tmp_path):
    root = tmp_path / "r.git"
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_DATE": "2024-01-01T00:00:00Z", "GIT_COMMITTER_DATE": "2024-01-01T00:00:00Z"})
    root.mkdir()
    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "a")
    (root / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "one")
    run("checkout", "-qb", "dev")
    (root / "b.rs").write_text("fn f() {}\n")
    run("add", ".")
    run("commit", "-qm", "two")
    run("tag", "v1")
    run("checkout", "-q", "main")
    return str(root)


def test_tree_keeps_all_kinds_of_files(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"pkg/__init__.py": b"", "pkg/_private.py": b"x", ".env": b"s", "e.md": b"", "pkg/a.py": b"y\n", "b.png": b"\x89PNG\xff\xfe", "bin": b"a\0b", "build/x.o": b"o", "sub/.gitignore": b"*.tmp\n!keep.tmp\n", "sub/a.tmp": b"t", "sub/keep.tmp": b"k", "big": b"z" * 99, ".gitignore": b"build/\n# note\n/top.txt\n", "top.txt": b"t", "sub/top.txt": b"t"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    os.symlink(root / "pkg", root / "link")
    walk = lambda **o: {r.path: (r.size, r.is_text, r.content) for r in files.working_tree(spark, str(root), options=files.WalkOptions(max_file_size=98, **o)).collect()}
    got = walk()
    assert set(got) == {"pkg/__init__.py", "pkg/_private.py", "e.md", "pkg/a.py", "b.png", "bin", "sub/keep.tmp", "sub/top.txt"}
    assert got["e.md"] == (0, False, "") and got["bin"] == (3, False, None) and got["b.png"][1] and "\ufffd" in got["b.png"][2]
    assert {".env", ".gitignore", "sub/.gitignore"} <= set(walk(include_hidden=True))
    assert set(walk(include_regex=r"\.py$", exclude_regex="_private")) == {"pkg/__init__.py", "pkg/a.py"}
    assert "link/a.py" in walk(follow_symlinks=True) or "pkg/a.py" in walk(follow_symlinks=True)
    docs, symbols = files.tree_and_symbols(spark, str(root))
    assert docs.count() == 9 and symbols.count() == 0


def test_ignore_rules():
    chain = [("", ignore.rules(["*.log", "!keep.log", "/a/b", "dir/", "x/**/y", "q?.t", "[ab].z", "\\#lit", "# no", ""]))]
    yes = ["m.log", "s/m.log", "a/b", "x/y", "x/1/2/y", "q1.t", "a.z", "#lit"]
    no = ["keep.log", "s/a/b", "q12.t", "c.z", "dir"]
    assert [p for p in yes if not ignore.ignored(chain, p, False)] == [] and [p for p in no if ignore.ignored(chain, p, False)] == []
    assert ignore.ignored(chain, "s/dir", True)


def test_branches_and_remotes(spark, clone, tmp_path):
    got = files.working_tree(spark, clone, "r", files.WalkOptions(max_branches=2)).collect()
    assert sorted((r.branches[0], r.path, r.content) for r in got) == [("dev", "a.py", "x = 1\n"), ("dev", "b.rs", "fn f() {}\n"), ("main", "a.py", "x = 1\n")]
    assert {r.path for r in files.working_tree(spark, clone, "r", files.WalkOptions(branches=("dev",))).collect()} == {"a.py", "b.rs"}
    reg = spark.createDataFrame([("r", clone), ("gone", str(tmp_path / "nowhere"))], "name string, url string")
    refs = sorted((r.repo, r.kind or "", r.name or "", r.error or "") for r in git.remote_refs(reg).collect())
    assert [x[:3] for x in refs] == [("gone", "", ""), ("r", "branch", "dev"), ("r", "branch", "main"), ("r", "tag", "v1")] and refs[0][3] == "RepoNotFound"
    there = git.clone("file://" + clone, str(tmp_path / "c"))
    assert os.path.exists(f"{there}/a.py")
    with pytest.raises(git.RepoNotFound):
        git.clone(str(tmp_path / "nowhere"), str(tmp_path / "d"))


def test_credentials_and_errors():
    env = {"GITHUB_USERNAME": "u", "GITHUB_TOKEN": "t/k"}
    assert git.with_credentials("https://github.com/o/r", env) == "https://u:t%2Fk@github.com/o/r"
    for url in ("https://u:p@github.com/o/r", "git@github.com:o/r", "https://example.org/o/r", "https://gitlab.com/o/r"):
        assert git.with_credentials(url, env) == url
    assert isinstance(git.clone_error("fatal: Authentication failed"), git.CloneDenied) and type(git.clone_error("boom")) is git.CloneError


def test_tables_merge_parts(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *xs: spark.createDataFrame(xs, "k string, t int, v string")
    assert not sinks.table_exists(spark, path)
    sinks.merge_table(spark, path, rows(*[(f"k{i}", 1, "old") for i in range(40)]), ["k"], "t")
    sinks.merge_table(spark, path, rows(("k1", 2, "new"), ("k2", 0, "late"), ("x", 1, "more")), ["k"], "t")
    got = {r.k: r.v for r in sinks.read_table(spark, path).collect()}
    assert len(got) == 41 and got["k1"] == "new" and got["k2"] == "old" and got["x"] == "more"
    one, two = sinks.Store(spark, path).manifest(1)["parts"], sinks.Store(spark, path).manifest(2)["parts"]
    assert 0 < sum(one[p] == two[p] for p in one) < len(two)  # untouched parts stay
    store = sinks.Store(spark, path)
    assert not store.commit(2, {}) and store.latest() == 2
    sinks.merge_table(spark, path, rows().limit(0), ["k"], "t")
    assert sinks.read_table(spark, path).count() == 41


def test_lines_registry_letters(spark, tmp_path):
    src = [("r", "m.py", "import os\nclass A:\n  def f(self): pass\n"), ("r", "a.js", "class B {\n  m() {}\n}\n"), ("r", "n.txt", "plain")]
    e = extract.entities(spark.createDataFrame(src, "repo string, path string, content string"))
    lines = [json.loads(r.value) for r in sinks.entity_lines(e).collect()]
    said = sorted((x["path"], x["kind"], x["name"], x.get("parent"), x.get("start_line")) for x in lines)
    assert said == [("a.js", "class", "B", None, 1), ("a.js", "file", "a.js", None, None), ("a.js", "function", "m", "B", 2), ("m.py", "class", "A", None, 2), ("m.py", "file", "m.py", None, 1), ("m.py", "function", "f", "A", 3), ("n.txt", "file", "n.txt", None, None)]
    hits = spark.createDataFrame([("r", "p", 3, "x = 1")], "repo string, path string, line int, line_text string")
    assert sinks.result_lines(hits).first().value == "r/p:3: x = 1" and json.loads(sinks.result_lines(hits, True).first().value)["line"] == 3
    reg = spark.createDataFrame([("a", "u", "main"), ("b", "v", "dev")], "name string, url string, branches string")
    br = spark.createDataFrame([("a", "main", "c1"), ("a", "dev", "c2")], "name string, branch string, last_commit_sha string")
    sinks.export_registry(reg, br, str(tmp_path / "csv"))
    assert {(r.name, r.branch_details) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {("a", "dev c2; main c1"), ("b", None)}
    sinks.dead_letters(spark.createDataFrame([("1", "y" * 300)], "id string, body string"), "why", str(tmp_path / "dlq"))
    r = spark.read.json(str(tmp_path / "dlq")).first()
    assert (r.id, r.reason, r.length, len(r["head"])) == ("1", "why", 300, 200)
    out = files.embedding_response(spark.createDataFrame([("[[1.0, 2.0]]",), ('{"data": [{"embedding": [3.0]}], "model": "m"}',)], "body string")).collect()
    assert [(r.embeddings, r.model) for r in out] == [([[1.0, 2.0]], None), ([[3.0]], "m")]


def test_relations_round_trip(spark, tmp_path):
    src = spark.createDataFrame([("r", "m.py", "from n import g\ndef f():\n  g()\n"), ("r", "n.py", "class K:\n  def g(self): pass\ndef g():\n  return 1\n")], "repo string, path string, content string")
    e, x = extract.code_graph(src)
    meta = spark.createDataFrame([("r", "git@h.org:o/r.git", "main", "c1")], "repo string, url string, branch string, commit string")
    tables = relations.relational_tables(e, x, src, meta)
    root = f"file://{tmp_path}/store"
    for _ in range(2):  # again changes nothing
        relations.persist(spark, root, tables, "2024-01-01")
    got = relations.load(spark, root)
    kinds = {r.relation: r["count"] for r in got["relation"].groupBy("relation").count().collect()}
    assert kinds["imports"] == 1 and kinds["calls"] == 1 and kinds["has_method"] == 1 and kinds["has_snapshot"] == 6 and kinds["contains"] == 1
    assert got["repo"].first().url == "https://h.org/o/r" and got["repo"].first().owner == "o"
    snap = {r.name: r for r in got["snapshot"].filter("kind = 'function'").collect()}
    assert snap["f"].source_content == "def f():\n  g()" and snap["f"].snapshot_id == "r@c1"
    sid = snap["f"].stable_id
    page = relations.fetch_snapshot(got["snapshot"], [sid, "none"], 4, 3).orderBy(F.desc("found")).collect()
    assert [(r.found, r.source_content, r.has_more) for r in page] == [(True, "f()", True), (False, "", False)]
    bom = '{"components": [{"name": "left", "version": "1", "purl": "p"}, {"name": "left", "version": "1", "purl": "p"}]}'
    sb = relations.sbom_tables(spark.createDataFrame([("r", "c1", "{}", 1), ("r", "c1", bom, 2), ("r", None, bom, 1)], "repo string, commit string, json string, at int"))
    assert sb["sbom"].count() == 2 and sb["sbom_component"].count() == 2 and sb["relation"].filter("relation = 'has_sbom'").count() == 1
    dep = relations.dependency_tables(spark.createDataFrame([("r", "requirements.txt", "x==1\ny\n")], "repo string, path string, content string"), meta)
    assert dep["relation"].count() == 2 and {r.version for r in dep["dependency"].collect()} == {"1", ""}
    old = spark.createDataFrame([("a", "done", "1")], "id string, status string, content string")
    new = spark.createDataFrame([("a", "2\0"), ("b", "3")], "id string, content string")
    assert sorted(map(tuple, relations.upsert_missing(old, new, ["id"]).collect())) == [("a", "done", "2 "), ("b", "pending", "3")]


def test_pages(spark):
    ents = spark.createDataFrame([("1", "Foo", "class", "r", "/tmp/x/src/a.py", 3, None, None, "c1"), ("2", "bar", "method", "r", "/tmp/x/src/a.py", 4, 0.5, "Foo", "c1"), ("3", "foo", "function", "q", "b.py", 1, 0.2, None, "c9")], "stable_id string, name string, kind string, repo string, path string, start_line int, rank double, parent string, commit string")
    repos = spark.createDataFrame([("r", "https://h.org/o/r.git", None), ("q", "/local", "dev")], "repo string, url string, branch string")
    rows = pages.entity_rows(ents, repos).collect()
    assert [(r.path, r.source_url, r.source_display, r.rank) for r in rows] == [("b.py", None, "q", 0.2), ("src/a.py", "https://h.org/o/r/blob/main/src/a.py#L3", "o/r/src/a.py", 0.0), ("src/a.py", "https://h.org/o/r/blob/main/src/a.py#L4", "o/r/src/a.py", 0.5)]
    assert [r.stable_id for r in pages.methods_of(ents, "Foo").collect()] == ["2"] and pages.lookup(ents, name="foo", repo="q").first().stable_id == "3" and pages.lookup(ents, "1").first().name == "Foo"
    refs = spark.createDataFrame([("r", "master", "c1"), ("q", "dev", "c2"), ("q", "main", "c3")], "repo string, branch string, target string")
    heads = pages.default_commits(refs, repos)
    assert sorted(map(tuple, heads.collect())) == [("q", "c2"), ("r", "c1")] and [r.stable_id for r in pages.on_default_branch(ents, heads).orderBy("stable_id").collect()] == ["1", "2"]
    clusters = spark.createDataFrame([("layer1::0", "top", "", ["layer0::0", "1", "zz"], ["r"]), ("layer0::0", "low", "", ["2"], ["r"])], "stable_id string, label string, summary string, members array<string>, member_repos array<string>")
    assert [(r.member, r.type) for r in pages.cluster_members(clusters, ents, "layer1::0").collect()] == [("1", "entity"), ("layer0::0", "cluster"), ("zz", "unknown")]
    edges = spark.createDataFrame([("2", "3", "call")], "src string, dst string, kind string")
    page = pages.entity_page(ents, edges, "1")
    assert [r.stable_id for r in page["methods"].collect()] == ["2"] and pages.call_graph(ents, edges, name="bar").first().stable_id == "3" and pages.call_graph(ents, edges, name="none").count() == 0
    declared = spark.createDataFrame([("r", "main", "b", "1"), ("r", "main", "A", "2"), ("q", "other", "z", "1")], "repo string, branch string, name string, version string")
    comps = spark.createDataFrame([("q", "c2", "s", "1"), ("q", None, "t", "1"), ("r", "c1", "n", "1")], "repo string, commit string, name string, version string")
    asked = spark.createDataFrame([("r", "dev"), ("q", None)], "repo string, branch string")
    assert [(r.repo, r.name, r.source) for r in pages.dependency_page(declared, comps, asked).collect()] == [("q", "s", "sbom"), ("r", "A", "manifest"), ("r", "b", "manifest")]


def test_admin(spark):
    reg = spark.createDataFrame([("a", "u1")], "name string, url string")
    asked = spark.createDataFrame([("b", "u2", None, None), ("a", "u3", None, 5), ("c", "u1", None, None), ("b", "u9", None, None), ("", "u4", None, None), ("d", "u5", " x* ", 7)], "name string, url string, branches string, frequency int").coalesce(1)
    ok, bad = pages.created(reg, asked)
    assert sorted(map(tuple, ok.collect())) == [("b", "u2", "main", 60), ("d", "u5", "x*", 7)]
    assert sorted((r.url, r.error) for r in bad.collect()) == [("u1", "the url is taken"), ("u3", "the name is taken"), ("u4", "name and url are needed"), ("u9", "the name is taken")]
    left, _ = pages.deleted(reg, reg, ["a"])
    assert left.count() == 0
    import base64

    key = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    leases = spark.createDataFrame([(key("r|u|main"), "n1", 60), (key("odd"), "n1", 60), ("!!", "x", 1), (key("s|u|dev"), "n2", 0)], "key string, holder string, ttl int")
    assert [tuple(r) for r in pages.lease_listing(leases, "2024-01-01 00:00:00").collect()] == [("r", "main", "n1", "2024-01-01 00:01:00 UTC"), ("s", "dev", "n2", "Unknown")]
    assert pages.valid_builder({"base_repo": "u", "include_tags": ["v*", "^v"]}) == [] and len(pages.valid_builder({"include_tags": ["("], "max_tags": 0})) == 3
    m = spark.createDataFrame([("db_metrics_500_100_live.json", '{"batches_sent": 4, "avg_batch_ms": 2.5}'), ("db_metrics_x_1_a.json", "{}"), ("db_metrics_1_2.json", '{"total_time_ms": 7.0}')], "name string, json string")
    assert [(r.capacity, r.mode, r.total_time_ms) for r in pages.metrics_summary(m).collect()] == [(1, "unknown", 7.0), (500, "live", 10.0)]


def test_poll_orphans_heartbeat(spark):
    b = spark.createDataFrame([("b1", "https://h/o/r", ["main", "feature/*"], ["old"], ["v1.*"], [], [], [], None, 1), ("b2", "https://h/x/q", [], [], [], [".*"], ["^o$"], [], "dev", None)], "id string, base_repo string, include_branches array<string>, exclude_branches array<string>, include_tags array<string>, exclude_tags array<string>, include_owner array<string>, exclude_owner array<string>, default_branch string, max_tags int")
    rows = [("https://h/o/r", "branch", n, "c") for n in ("main", "old-main", "feature/x", "dev")] + [("https://h/o/r", "tag", n, "c") for n in ("v1.0.0", "v1.2.0", "v2.0.0")] + [("https://h/x/q", "branch", "main", "c")]
    got = jobs.poll(b, spark.createDataFrame(rows, "url string, kind string, name string, target string")).collect()
    assert sorted((r.entry, r.kind, r.default_branch) for r in got) == [("builder::b1|feature/x", "branch", "main"), ("builder::b1|main", "branch", "main"), ("builder::b1|v1.2.0", "tag", "main")]
    entries = spark.createDataFrame([("builder::b1|main",), ("builder::zz|main",), ("r|main",)], "entry string")
    assert sorted(r.entry for r in jobs.without_orphans(entries, b).collect()) == ["builder::b1|main", "r|main"]
    pair = "repo string, branch string"
    leases = spark.createDataFrame([("a", "m", "me", 9), ("b", "m", "you", 9), ("c", "m", "me", 1)], f"{pair}, holder string, until int")
    acts = jobs.heartbeat("me", spark.createDataFrame([("a", "m"), ("gone", "m")], pair), spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m"), ("d", "m")], pair), leases, 5)
    assert sorted((r.action, r.repo) for r in acts.collect()) == [("acquire", "c"), ("remove", "gone"), ("renew", "a")]


def test_retries_split_and_letters(spark, tmp_path):
    done = []

    def handle(rows):
        got = [r.id for r in rows.collect()]
        if "bad" in got:
            raise ValueError("no")
        done.extend(got)

    rows = spark.createDataFrame([(x, "body") for x in ["a", "b", "bad", "c", "d"]], "id string, text string")
    jobs.with_retries(handle, str(tmp_path / "dlq"), 1)(rows)
    assert sorted(done) == ["a", "b", "c", "d"] and [r.id for r in spark.read.json(str(tmp_path / "dlq")).collect()] == ["bad"]
    with pytest.raises(ValueError):
        jobs.with_retries(handle, None, 1)(rows.filter("id = 'bad'"))
    counters = jobs.Counters()
    assert counters.lines() == "codeseam_batches 0\ncodeseam_rows 0\ncodeseam_failures 0\n"


def test_jobs_embed_relate_cluster(spark, tmp_path):
    src = spark.createDataFrame([(r, f"{n}.py", f"def {n}():\n  return '{t}'\n") for r in ("r1", "r2") for n, t in (("f", "aaaa aaaa"), ("g", "bbbb bbbb"), ("h", "boom"))], "repo string, path string, content string")
    e, x = extract.code_graph(src)
    meta = spark.createDataFrame([("r1", "https://h/o/r1", "main", "c1"), ("r2", "https://h/o/r2", "main", "c2")], "repo string, url string, branch string, commit string")
    root = f"file://{tmp_path}/store"
    relations.persist(spark, root, relations.relational_tables(e, x, src, meta), "2024-01-01")

    def embed(texts):
        if any("boom" in t for t in texts):
            raise ValueError("too long")
        return [[float(t.count("a")), float(t.count("b")), 1.0] for t in texts]

    batch = spark.createDataFrame([("r1", "c1"), ("r2", "c2")], "repo string, commit string")
    jobs.embedding_job(spark, root, embed)(batch, 0)
    vectors = sinks.read_table(spark, f"{root}/embedding")
    assert vectors.count() == 4 and spark.read.json(f"{root}/letters").count() == 2
    heads = spark.createDataFrame([("r1", "main", "c1"), ("r2", "main", "c2")], "repo string, branch string, target string")
    jobs.similarity_job(spark, root, lambda: heads, 1)(batch.limit(1), 1)
    found = sinks.read_table(spark, f"{root}/similar")
    assert found.filter("scope = 'external'").count() == 2 and found.filter("score < 0.85").count() == 0
    jobs.cluster_job(spark, root, 2)(batch, 2)
    assert sinks.read_table(spark, f"{root}/cluster").filter("layer = 0").count() == 4
