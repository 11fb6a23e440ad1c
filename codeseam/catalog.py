"""Registered queries of the library's own operators, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import text as T
from codeseam.operators import cluster, deps, extract, graph, index, matches, names, pages, refs, search, similarity
from codeseam.plans import querylang as ql
from codeseam.sources.files import as_documents, event_stream, working_tree
from codeseam.sources import sinks
from codeseam.sources.folders import fresh, mounted
from codeseam.streaming import events as ev
from codeseam.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return as_documents(table(spark, sf, "documents"))


class Index(dict):
    """The tables of a written index by name; one that isn't there yet is written
    when it is asked for."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf, self.path = spark, sf, fresh(spark, "index")

    def __missing__(self, name: str) -> DataFrame:
        base = name.removesuffix("_n") if name != "content_pos" else "content_tri"
        if base not in index.TABLES:
            raise KeyError(name)
        d = docs(self.spark, self.sf)
        index.write_index(d, extract.symbols(d, _SYM), self.path, only=(base,))
        self.update(index.open_index(self.spark, self.path, (base,)))
        return self[name]


_INDEXES: dict[tuple[str, str], Index] = {}


def indexed(spark: SparkSession, sf: str, *now: str) -> Index:
    """The index of the documents, each table written once a session: the ones named
    now, others when a query reads them."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = Index(spark, sf)
    for name in now:
        _INDEXES[key][name]
    return _INDEXES[key]


FILES = ["repo", "doc_id", "path"]
D = "(SELECT source AS repo, doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(lang, '') AS lang, text AS content FROM documents) d"


def _files(sql_where: str) -> str:
    return f"SELECT repo, doc_id, path FROM {D} WHERE {sql_where}"


def _search(name: str, line: str, where: str, mode: str = "substring") -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return search.search(docs(spark, sf), line, mode=mode).select(*FILES)

    f.__name__ = name
    query(_files(where))(f)


# search: literals, regexes, paths, filters
_search("search_literal_ci", "Example", "contains(lower(content), 'example') OR contains(lower(path), 'example')")
_search("search_literal_cs", "case:yes The", "contains(content, 'The') OR contains(path, 'The')")
_search("search_literal_rare", "content:only TOKEN", "contains(lower(content), 'token')")
_search("search_literal_absent", "content:only zzqqxx", "contains(lower(content), 'zzqqxx')")
_search("search_phrase", '"and the"', "contains(lower(content), 'and the') OR contains(lower(path), 'and the')")
_search("search_regex_ci", "re:yes content:only th[aeiou]n+d", "regexp_matches(content, 'th[aeiou]n+d', 'i')")
_search("search_regex_cs", "re:yes case:yes content:only [A-Z][a-z]+ing", "regexp_matches(content, '[A-Z][a-z]+ing', 'c')")
_search("search_regex_ip", r"re:yes content:only [0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"regexp_matches(content, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')")
_search("search_regex_invalid", "re:yes a(b", "contains(lower(path), 'a(b')")
_search("search_path_only", "path:only src1/1", "contains(lower(path), 'src1/1')")
_search("search_content_only", "content:only src1", "contains(lower(content), 'src1')")
_search("search_union", "src1/2", "contains(lower(content), 'src1/2') OR contains(lower(path), 'src1/2')")
_search("search_filter_lang", "lang:en lang:DE content:only the", "lang IN ('en', 'de') AND contains(lower(content), 'the')")
_search("search_filter_repo_exact", "repo:src3 repo:src4 content:only a", "repo IN ('src3', 'src4') AND contains(lower(content), 'a')")
_search("search_filter_repo_regex", "repo:^src1[0-4]+ content:only the", "regexp_matches(repo, '^src1[0-4]+') AND contains(lower(content), 'the')")
_search("search_filter_file_glob", "file:SRC2/2 content:only a", "lower(path) = 'src2/2' AND contains(lower(content), 'a')")
_search("search_regex_unicode", r"re:yes case:yes content:only \p{Lu}\p{Ll}+[äöüß]\p{Ll}", r"regexp_matches(content, '\p{Lu}\p{Ll}+[äöüß]\p{Ll}', 'c')")
_search("search_regex_named_groups", r"re:yes content:only (?P<a>[0-9]{3})-(?P<b>[0-9]{4})", r"regexp_matches(content, '[0-9]{3}-[0-9]{4}')")
_search("search_regex_posix", r"re:yes content:only [[:digit:]]+[[:punct:]][[:digit:]]+", r"regexp_matches(content, '[[:digit:]]+[[:punct:]][[:digit:]]+')")
_search("search_regex_not_of_the_dialect", "re:yes content:only a{,3}", "false")
_search("search_filter_file_glob_star", "file:*/1? content:only a", "regexp_matches(path, '^.*/1.$') AND contains(lower(content), 'a')")
_search("search_filter_file_regex", "file:/1[0-9]+ file:^src[0-5]/ content:only a", "regexp_matches(path, '/1[0-9]+') AND regexp_matches(path, '^src[0-5]/') AND contains(lower(content), 'a')")
_search("search_filter_branch", "branch:main content:only the", "contains(lower(content), 'the')")
_search("search_filter_branch_none", "branch:dev content:only the", "false")
_search("search_filters_only", "lang:fr repo:src1", "lang = 'fr' AND repo = 'src1'")


_WORD = "(^|[^\\p{L}\\p{N}_])hand([^\\p{L}\\p{N}_]|$)"


@query(_files(f"CASE WHEN (SELECT bool_or(regexp_matches(lower(text), '{_WORD}')) FROM documents) THEN regexp_matches(lower(content), '{_WORD}') ELSE contains(lower(content), 'hand') END"))
def search_literal_term_first(spark, sf):
    return index.search_index(indexed(spark, sf), "content:only hand").select(*FILES)


@query(SQL["search_literal_term_first"])
def search_term_first_scan(spark, sf):
    return search.search(docs(spark, sf), "content:only hand").select(*FILES)


_search("search_term_first_falls_back", "content:only xample.co", "contains(lower(content), 'xample.co')", "term_first")

_AND = ql.And(ql.Literal("the"), ql.Literal("und"))
_BOOLEAN = {
    "search_bool_and": (_AND, "contains(lower(content), 'the') AND contains(lower(content), 'und')"),
    "search_bool_or": (ql.Or(ql.Literal("token"), ql.Literal("Wa", True)), "contains(lower(content), 'token') OR contains(content, 'Wa')"),
    "search_bool_not": (ql.Not(ql.Literal("the")), "NOT contains(lower(content), 'the')"),
    "search_bool_nested": (ql.And(ql.Or(ql.Regex("[0-9]{4}"), _AND), ql.Not(ql.Not(ql.Literal("de")))), "(regexp_matches(content, '[0-9]{4}') OR (contains(lower(content), 'the') AND contains(lower(content), 'und'))) AND contains(lower(content), 'de')"),
    "search_bool_and_absent": (ql.And(ql.Literal("the"), ql.Literal("zzqqxx")), "false"),
}


def _boolean(name: str, q, where: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return search.search_boolean(docs(spark, sf), q).select(*FILES)

    f.__name__ = name
    query(_files(where))(f)


for _n, (_q, _w) in _BOOLEAN.items():
    _boolean(_n, _q, _w)


@query(f"SELECT DISTINCT repo FROM {D} WHERE contains(lower(content), '555-1')")
def search_select_repo(spark, sf):
    return search.search(docs(spark, sf), "select:repo content:only 555-1", mode="substring").select("repo")


_SYM = r"([A-Z][a-z]+ing)"


@query("""
SELECT repo, doc_id, symbol FROM (SELECT source AS repo, doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+ing)', 1)) AS symbol, text FROM documents)
WHERE contains(lower(text), 'wh') AND contains(lower(symbol), 'wh')""")
def search_select_symbol(spark, sf):
    d = docs(spark, sf)
    return search.search(d, "select:symbol content:only wh", extract.symbols(d, _SYM), mode="substring").select("repo", "doc_id", "symbol")


@query(SQL["search_select_symbol"])
def indexed_select_symbol(spark, sf):
    return index.search_index(indexed(spark, sf), "select:symbol content:only wh", mode="substring").select("repo", "doc_id", "symbol")


@query(f"SELECT node_id, repo, path FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS node_id, repo, path FROM {D} WHERE contains(lower(content), 'the') AND regexp_matches(path, 'src1') AND NOT regexp_matches(path, '7$')) ORDER BY repo, path LIMIT 20 OFFSET 3")
def search_distributed(spark, sf):
    d = docs(spark, sf)
    nodes = {"even": d.filter("doc_id % 2 = 0"), "odd": d.filter("doc_id % 2 = 1")}
    return search.distributed(nodes, "content:only the", ("src1",), ("7$",), 3, 20).select("node_id", "repo", "path")


_REPOS = [("src0", "public", None), ("src1", "private", None), ("src2", "restricted", ["ann", "bob"]), ("src3", "restricted", ["eve"]), ("src4", "secret", None)]


@query(_files("repo NOT IN ('src3', 'src4')"))
def search_visibility(spark, sf):
    repos = spark.createDataFrame(_REPOS, "name string, visibility string, allowed_users array<string>")
    return search.visible(docs(spark, sf), repos, "bob").select(*FILES)


@query("SELECT url, page_id FROM pages WHERE contains(lower(html), 'nav') OR contains(lower(url), 'nav')")
def search_pages(spark, sf):
    p = table(spark, sf, "pages")
    d = p.select(T.repo_name(F.col("url")).alias("repo"), F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.lit("html").alias("lang"), F.array(F.lit("main")).alias("branches"), F.col("html").alias("content"))
    return search.search(d, "nav", mode="substring").select(F.col("path").alias("url"), F.col("doc_id").alias("page_id"))


@query(f"SELECT repo, doc_id, path FROM (SELECT *, row_number() OVER (ORDER BY repo, doc_id) AS rn FROM {D} WHERE contains(lower(content), 'the')) WHERE rn > 5 AND rn <= 15")
def search_page(spark, sf):
    found = search.search(docs(spark, sf), "content:only the", mode="substring")
    return search.page(found.select(*FILES), ["repo", "doc_id"], 5, 10).select(*FILES)


@query(f"SELECT DISTINCT repo, path FROM {D} WHERE contains(lower(content), 'the') OR contains(lower(content), '555-1')")
def search_merge_indexes(spark, sf):
    d = docs(spark, sf)
    parts = [search.search(d, f"content:only {w}", mode="substring") for w in ("the", "555-1")]
    return search.merge_results(parts, None).select("repo", "path")


# index tables
_RUNS = "SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{3,}')) AS r FROM documents"
_TRI = f"SELECT doc_id, substr(r, i, 3) AS tri FROM (SELECT doc_id, r, unnest(range(1, length(r) - 1)) AS i FROM ({_RUNS}))"


@query("SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def terms_postings_count(spark, sf):
    return index.document_frequency(indexed(spark, sf)["terms_n"], "token")


@query(f"SELECT tri, count(DISTINCT doc_id) AS df FROM ({_TRI}) GROUP BY tri")
def trigram_df(spark, sf):
    return index.document_frequency(indexed(spark, sf)["content_tri_n"])


@query(f"SELECT tri, doc_id, count(*) AS n FROM ({_TRI}) GROUP BY tri, doc_id")
def trigram_postings(spark, sf):
    return index.content_trigrams(docs(spark, sf)).select("tri", "doc_id", F.size("positions").cast("long").alias("n"))


_POSTED = """SELECT doc_id, unnest(range(1, len(p))) AS k, p FROM (SELECT doc_id, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '555') AS p FROM documents WHERE contains(text, '555') AND NOT contains(text, '5555'))"""


@query(f"SELECT doc_id, CAST(strlen(array_to_string(p[1:k], '555')) AS INTEGER) AS byte FROM ({_POSTED})")
def trigram_positions(spark, sf):
    one = docs(spark, sf).filter("NOT contains(content, '5555')")
    return index.content_trigrams(one, ["555"]).select("doc_id", F.explode("positions").alias("byte"))


@query(f"SELECT doc_id FROM ({_TRI}) WHERE tri IN ('555', 'the', 'and') GROUP BY doc_id HAVING count(DISTINCT tri) = 3")
def trigram_candidates(spark, sf):
    return index.candidates(indexed(spark, sf)["content_tri"], [frozenset({"555", "the", "and"})]).select("doc_id")


_PHONE = r"555-(1[0-9]{3}|2[0-9]{3})"


@query(_files(f"regexp_matches(content, '{_PHONE}', 'i')"))
def prefilter_equals_scan(spark, sf):
    return index.search_index(indexed(spark, sf), f"re:yes content:only {_PHONE}").select(*FILES)


@query(_files("contains(lower(content), 'token')"))
def indexed_literal(spark, sf):
    return index.search_index(indexed(spark, sf), "content:only token", "substring").select(*FILES)


@query(_files("(contains(lower(content), 'hand') OR contains(lower(path), 'hand')) AND regexp_matches(repo, 'src1[0-9]') AND lang IN ('de', 'en')"))
def indexed_filters(spark, sf):
    return index.search_index(indexed(spark, sf), "repo:^src1[0-9] lang:de lang:en hand", "substring").select(*FILES)


@query("SELECT count(*) AS n_docs, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes FROM documents")
def index_totals(spark, sf):
    return index.totals(docs(spark, sf))


@query("SELECT r.source AS repo, true AS indexed, count(*) AS n_docs FROM documents r GROUP BY 1 UNION ALL SELECT 'nowhere', false, 0")
def index_status(spark, sf):
    d = docs(spark, sf)
    return refs.index_status(d.select("repo").union(spark.createDataFrame([("nowhere",)], "repo string")), d)


# hits within documents
_HITS = """SELECT doc_id, k, array_to_string(p[1:k], '555-') AS before, array_to_string(p[k + 1:], '555-') AS after
FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS k FROM (SELECT doc_id, string_split(text, '555-') AS p FROM documents WHERE contains(text, '555-')))"""


@query(f"SELECT doc_id, CAST(strlen(before) AS INTEGER) AS start_byte, CAST(len(string_split(before, chr(10))) AS INTEGER) AS line, string_split(before, chr(10))[-1] || '555-' || split_part(after, chr(10), 1) AS line_text FROM ({_HITS})")
def match_lines(spark, sf):
    return matches.matches(docs(spark, sf), "555-").select("doc_id", "start_byte", "line", "line_text")


@query(f"SELECT doc_id, CAST(strlen(before) AS INTEGER) AS start_byte, CAST(strlen(before) + 4 AS INTEGER) AS end_byte FROM ({_HITS})")
def match_offsets_bytes(spark, sf):
    return matches.matches(docs(spark, sf), "555-", text=False).select("doc_id", "start_byte", "end_byte")


@query(f"""
WITH h AS (SELECT doc_id, k, string_split(before, chr(10))[-1] AS b, split_part(after, chr(10), 1) AS a FROM ({_HITS}))
SELECT doc_id, CASE WHEN length(b) <= 10 THEN b ELSE '…' || right(b, 10) END AS before, CASE WHEN length(a) <= 10 THEN a ELSE left(a, 10) || '…' END AS after FROM h""")
def snippet_context(spark, sf):
    return matches.matches(docs(spark, sf), "555-", context=10).select("doc_id", "before", "after")


@query("SELECT source AS repo, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[0-9]+')) AS m FROM documents) GROUP BY 1")
def match_count_per_repo(spark, sf):
    return matches.matches(docs(spark, sf), "[0-9]+", regex=True, text=False).groupBy("repo").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def document_lines(spark, sf):
    return matches.lines(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE contains(lower(text), '555-')),
s AS (SELECT *, contains(lower(t), '555-') AS hit, bool_or(contains(lower(t), '555-')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l),
g AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM s WHERE near)
SELECT doc_id, string_agg(CASE WHEN prev < i - 1 THEN '...' || chr(10) ELSE '' END || lpad(CAST(i AS VARCHAR), 6, ' ') || CASE WHEN hit THEN ' > ' ELSE '   ' END || t || chr(10), '' ORDER BY i) AS snippet FROM g GROUP BY doc_id""")
def snippet_blocks(spark, sf):
    return matches.snippets(docs(spark, sf), "555-", 1).select("doc_id", "snippet")


@query(f"SELECT doc_id, CAST(strlen(before) AS INTEGER) AS start_byte, regexp_extract_all(before, '[A-Z]{{2,}}')[-1] AS symbol FROM ({_HITS})")
def nearest_symbol(spark, sf):
    d = docs(spark, sf)
    m = matches.matches(d, "555-", text=False)
    return matches.nearest_symbol(m, extract.symbols(d, r"([A-Z]{2,})")).select("doc_id", "start_byte", "symbol")


# graph
_EDGES = """SELECT DISTINCT 'S:' || l_suppkey AS src, 'P:' || l_partkey AS dst, 'call' AS kind FROM lineitem
UNION ALL SELECT DISTINCT 'C:' || c_custkey, 'N:' || c_nationkey, 'import' FROM customer
UNION ALL SELECT DISTINCT 'R:' || n_regionkey, 'N:' || n_nationkey, 'containment' FROM nation
UNION ALL SELECT DISTINCT 'P:' || l_partkey, 'S:' || min(l_suppkey), 'call' FROM lineitem GROUP BY l_partkey"""


def edges(spark: SparkSession, sf: str, once: bool = True) -> DataFrame:
    """``once``: each edge; else the ones from lineitem as often as they are there."""
    li, c, n = (table(spark, sf, t) for t in ("lineitem", "customer", "nation"))
    each = lambda df: df.distinct() if once else df
    k = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    kind = lambda x: F.lit(x).alias("kind")
    a = each(li.select("l_suppkey", "l_partkey")).select(k("S:", "l_suppkey").alias("src"), k("P:", "l_partkey").alias("dst"), kind("call"))
    b = each(c.select("c_custkey", "c_nationkey")).select(k("C:", "c_custkey").alias("src"), k("N:", "c_nationkey").alias("dst"), kind("import"))
    d = each(n.select("n_regionkey", "n_nationkey")).select(k("R:", "n_regionkey").alias("src"), k("N:", "n_nationkey").alias("dst"), kind("containment"))
    back = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).select(k("P:", "l_partkey").alias("src"), k("S:", "s").alias("dst"), kind("call"))
    return a.union(b).union(d).union(back)


@query(_EDGES)
def graph_edges(spark, sf):
    return edges(spark, sf)


@query(f"""WITH e AS ({_EDGES}), n AS (
SELECT 'callers' AS relation, src AS other FROM e WHERE kind = 'call' AND dst = 'S:1' UNION SELECT 'callees', dst FROM e WHERE kind = 'call' AND src = 'S:1' UNION SELECT 'imports', dst FROM e WHERE kind = 'import' AND src = 'S:1')
SELECT relation, other FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY other) AS rn FROM n) WHERE rn <= 20""")
def graph_neighbors(spark, sf):
    return graph.neighbours(edges(spark, sf), "S:1", 20)


@query("SELECT 'callees' AS relation, 'P:' || l_partkey AS stable_id, p_name AS name FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1) JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'callers', 'P:' || l_partkey, p_name FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING min(l_suppkey) = 1) JOIN part ON p_partkey = l_partkey")
def entity_graph(spark, sf):
    e = table(spark, sf, "part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("stable_id"), F.col("p_name").alias("name"))
    return graph.entity_graph(edges(spark, sf), e, "S:1", 1 << 30)


def _bfs(forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""WITH RECURSIVE e AS (SELECT {a} AS x, {b} AS y FROM ({_EDGES}) WHERE kind = 'call'), r AS (
SELECT 'S:1' AS node, 0 AS depth UNION SELECT e.y, r.depth + 1 FROM r JOIN e ON e.x = r.node WHERE r.depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node HAVING min(depth) > 0"""


@query(_bfs(True))
def graph_bfs_depth2(spark, sf):
    return graph.reachable(edges(spark, sf, once=False), "S:1", 2)


@query(_bfs(False))
def graph_callers_depth2(spark, sf):
    return graph.reachable(edges(spark, sf, once=False), "S:1", 2, forward=False)


def _pagerank_sql(rounds: int = 10) -> str:
    parts = [
        f"e0 AS MATERIALIZED ({_EDGES})",
        "e1 AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, CASE kind WHEN 'call' THEN 1.0::DOUBLE WHEN 'import' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM e0 UNION ALL SELECT dst, src, 0.25::DOUBLE FROM e0 WHERE kind = 'containment') GROUP BY src, dst)",
        "o AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM e1)",
        "n AS MATERIALIZED (SELECT src AS node FROM e0 UNION SELECT dst FROM e0)",
        "c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n)",
        "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / c.n AS rank FROM n, c)",
    ]
    for i in range(rounds):
        parts.append(f"d{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0)::DOUBLE AS m FROM r{i} WHERE node NOT IN (SELECT src FROM o))")
        parts.append(f"g{i} AS MATERIALIZED (SELECT o.dst AS node, sum(r.rank * o.share) AS got FROM r{i} r JOIN o ON o.src = r.node GROUP BY o.dst)")
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / c.n + 0.85::DOUBLE * d.m / c.n + 0.85::DOUBLE * coalesce(g.got, 0) AS rank FROM n JOIN c ON true JOIN d{i} d ON true LEFT JOIN g{i} g ON g.node = n.node)")
    return f"WITH {', '.join(parts)} SELECT node, round(rank / (SELECT sum(rank) FROM r{rounds}), 6) AS rank FROM r{rounds}"


@query(_pagerank_sql())
def pagerank_top(spark, sf):
    e = graph.cut(edges(spark, sf))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.pagerank(e, nodes, eps=0.0).select("node", F.round("rank", 6).alias("rank"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("stable_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") == 1, "file").otherwise("function").alias("kind"), F.col("p_brand").alias("repo"), F.col("p_type").alias("path"), F.col("p_retailprice").alias("rank"), F.lit("en").alias("lang"), F.col("p_size").alias("start_line"))


_PARTS = "(SELECT p_partkey AS stable_id, p_name AS name, CASE WHEN p_size = 1 THEN 'file' ELSE 'function' END AS kind, p_brand AS repo, p_type AS path, p_retailprice AS rank, p_size AS start_line FROM part) p"


@query(f"SELECT stable_id, rank FROM {_PARTS} ORDER BY rank DESC, stable_id LIMIT 25")
def rank_listing(spark, sf):
    return graph.rank_listing(parts(spark, sf), 25).select("stable_id", "rank")


_LEX = "CASE WHEN n = '{q}' THEN 1.0 WHEN starts_with(n, '{q}') THEN 0.8 WHEN contains(n, '{q}') THEN 0.5 WHEN levenshtein(n, '{q}') <= 2 THEN 0.3 - 0.1 * levenshtein(n, '{q}') END"


@query(f"""WITH b AS (SELECT min(rank) AS lo, max(rank) AS hi FROM {_PARTS}), l AS (SELECT stable_id, CAST({_LEX.format(q="cold widget")} AS DOUBLE) AS lex, rank FROM (SELECT *, lower(name) AS n FROM {_PARTS} WHERE kind <> 'file'))
SELECT stable_id, round(0.6 * lex + 0.4 * CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (rank - lo) / (hi - lo) END, 6) AS score FROM l, b WHERE lex IS NOT NULL ORDER BY 0.6 * lex + 0.4 * CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (rank - lo) / (hi - lo) END DESC, stable_id LIMIT 20""")
def fuzzy_symbols(spark, sf):
    return names.fuzzy_ranked(parts(spark, sf), "cold widget", 20).select("stable_id", F.round("score", 6).alias("score"))


@query(f"SELECT stable_id, name FROM {_PARTS} WHERE lower(name) = 'cold widget'")
def name_search_exact(spark, sf):
    return names.exact(parts(spark, sf), "Cold Widget").select("stable_id", "name")


@query(f"SELECT stable_id, name FROM {_PARTS} WHERE contains(lower(name), 'bolt') ORDER BY name, stable_id LIMIT 10 OFFSET 3")
def name_search_contains(spark, sf):
    return names.contains(parts(spark, sf), "BOLT", limit=10, offset=3).select("stable_id", "name")


@query(f"SELECT stable_id, name, repo FROM {_PARTS} WHERE contains(lower(name), 'o') AND repo IN ('Brand#11', 'Brand#12') ORDER BY rank DESC, stable_id LIMIT 15 OFFSET 2")
def name_search_multi(spark, sf):
    return names.multi(parts(spark, sf), "o", ["Brand#11", "a/b", "Brand#12"], 15, 2).select("stable_id", "name", "repo")


@query(f"SELECT stable_id, CAST(row_number() OVER (ORDER BY path, start_line, stable_id) AS INTEGER) AS position FROM {_PARTS} WHERE repo = 'Brand#11'")
def entity_listing(spark, sf):
    return names.listing(parts(spark, sf), "Brand#11").select("stable_id", "position")


@query(f"SELECT stable_id, score, CAST(row_number() OVER (ORDER BY score DESC, stable_id) AS INTEGER) AS position FROM (SELECT p_partkey AS stable_id, CAST(p_size AS DOUBLE) AS score FROM part WHERE p_brand = 'Brand#11')")
def hydrated_ranks(spark, sf):
    p = parts(spark, sf)
    ranked = p.filter("repo = 'Brand#11'").select("stable_id", F.col("start_line").cast("double").alias("score"))
    return pages.hydrated(ranked, p).select("stable_id", "score", "position")


@query("SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#11' AND p_size <> 1")
def counted_entities(spark, sf):
    return pages.counted(parts(spark, sf), repo="Brand#11", kind="function")


@query("SELECT coalesce(source, 'unknown') AS repo, count(*) AS entity_count, count(DISTINCT doc_id) AS file_count, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents GROUP BY 1")
def repo_summaries(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), "lang")
    return names.repo_summaries(d).withColumn("languages", F.array_join("languages", ","))


# vectors
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("stable_id"), F.col("label").cast("string").alias("repo"), "embedding")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT stable_id, score FROM (SELECT b.vec_id AS stable_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id = 0) WHERE rn <= 50")
def cosine_topk(spark, sf):
    s = snapshots(spark, sf)
    q = s.filter("stable_id = 0").select("embedding").first()[0]
    return similarity.cosine_top_k(s, list(q), 50).select("stable_id", F.round("score", 6).alias("score"))


def _similar_sql(op: str, k: int, least: float) -> str:
    return f"""WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, round({_COS}, 12) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label {op} b.label),
t AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS rn FROM p)
SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst, round(s, 6) AS score FROM t WHERE rn <= {k} AND NOT (s < {least} AND s >= 0)"""


def _sim(spark, sf, scope):
    return similarity.similar_edges(snapshots(spark, sf), scope, threshold=0.3)


@query(_similar_sql("=", 10, 0.3))
def similar_same(spark, sf):
    return _sim(spark, sf, "same").select("src", "dst", F.round("score", 6).alias("score"))


@query(_similar_sql("<>", 25, 0.3))
def similar_external(spark, sf):
    return _sim(spark, sf, "external").select("src", "dst", F.round("score", 6).alias("score"))


@query(f"WITH e AS ({_similar_sql('=', 10, 0.3)}) SELECT src AS a, dst AS b, score FROM e JOIN embeddings v ON v.vec_id = e.src WHERE v.label = 1 AND score >= 0.4")
def dupes_pairs(spark, sf):
    s = snapshots(spark, sf)
    return similarity.duplicate_pairs(_sim(spark, sf, "same"), s, "1", min_score=0.4).withColumn("score", F.round("score", 6))


@query(f"WITH e AS ({_similar_sql('<>', 25, 0.3)}), f AS (SELECT src, dst, score FROM e UNION ALL SELECT dst, src, score FROM e) SELECT src AS a, dst AS b, score FROM f JOIN embeddings v ON v.vec_id = f.src JOIN embeddings w ON w.vec_id = f.dst WHERE v.label = 1 AND w.label <> 1")
def dupes_external(spark, sf):
    return similarity.duplicate_pairs(_sim(spark, sf, "external"), snapshots(spark, sf), "1", external=True).withColumn("score", F.round("score", 6))


@query(f"WITH e AS ({_similar_sql('=', 10, 0.3)}) SELECT src AS a, dst AS b, score FROM e JOIN embeddings v ON v.vec_id = e.src WHERE v.label = 2 ORDER BY score DESC, a, b LIMIT 5 OFFSET 5")
def dupes_page(spark, sf):
    e = _sim(spark, sf, "same").withColumn("score", F.round("score", 6))
    return similarity.duplicate_pairs(e, snapshots(spark, sf), "2", limit=5, offset=5)


@query(f"WITH e AS ({_similar_sql('=', 10, 0.3)}), f AS (SELECT CASE WHEN src = 1 THEN dst ELSE src END AS stable_id, score FROM e WHERE src = 1 OR dst = 1) SELECT stable_id, score FROM f ORDER BY score DESC, stable_id LIMIT 10")
def similar_to_entity(spark, sf):
    s = snapshots(spark, sf)
    e = _sim(spark, sf, "same").withColumn("score", F.round("score", 6))
    return similarity.similar_of(e, s.withColumn("name", F.col("repo")), 1).select("stable_id", "score")


@query(f"SELECT stable_id, distance FROM (SELECT b.vec_id AS stable_id, round(1 - {_COS}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.label = 2)")
def members_by_distance(spark, sf):
    s = snapshots(spark, sf)
    centre = list(s.filter("stable_id = 1").first().embedding)
    return cluster.members_by_distance(s.filter("repo = '2'"), centre).select("stable_id", F.round("distance", 6).alias("distance"))


@query("SELECT sha256(text) AS content_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_content(spark, sf):
    return docs(spark, sf).groupBy(T.content_id(F.col("content")).alias("content_id")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT doc_id, sha256('proj|' || source || '|main||' || source || '/' || doc_id || '|name|sig') AS stable_id FROM documents")
def stable_ids(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", T.stable_id(F.lit("proj"), F.col("repo"), F.lit("main"), F.lit(None), F.col("path"), F.lit("name"), F.lit("sig")).alias("stable_id"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 200) / 150.0) AS BIGINT) + 1 END)) AS i FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(least(200, len(w) - i * 150) AS INTEGER) AS n_words, w[i * 150 + 1] AS first_word FROM c""")
def chunk_windows(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("stable_id"), "text")
    c = similarity.chunk_windows(d, 200, 50)
    return c.select(F.col("stable_id").alias("doc_id"), "chunk", F.size("words").alias("n_words"), F.get("words", F.lit(0)).alias("first_word"))


@query("""WITH e AS (SELECT label, vec_id, CASE WHEN vec_id % 7 <> 3 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings), u AS (SELECT label, count(v) AS n_used, count(*) AS n FROM e GROUP BY 1)
SELECT label AS stable_id, CAST(i AS INTEGER) AS i, round(avg(v[i + 1]), 6) AS x, any_value(n_used) AS n_used, bool_or(n_used < n) AS partial FROM e JOIN u USING (label), range(0, 64) t(i) WHERE v IS NOT NULL GROUP BY 1, 2""")
def chunk_mean(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("stable_id"), F.col("vec_id").alias("chunk"), F.when(F.col("vec_id") % 7 != 3, F.col("embedding")).alias("embedding"))
    return similarity.chunk_mean(e).select("stable_id", F.posexplode("embedding").alias("i", "x"), "n_used", "partial").withColumn("x", F.round("x", 6))


def _kmeans_sql(k: int = 4, rounds: int = 3) -> str:
    unit = "list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-300))"
    p = [f"e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS MATERIALIZED (SELECT vec_id, v, {unit} AS n FROM e)", f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS c, {unit} AS n FROM (SELECT * FROM e ORDER BY vec_id LIMIT {k}))"]
    for i in range(rounds):
        p.append(f"a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (-s, c)) AS c FROM (SELECT u.vec_id, c.c, round(list_inner_product(u.n, c.n), 12) AS s FROM u, c{i} c) GROUP BY vec_id)")
        if i < rounds - 1:
            p.append(f"m{i} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS v FROM (SELECT a.c, i, avg(u.v[i]) AS m FROM a{i} a JOIN u USING (vec_id), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY c)")
            p.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce((SELECT {unit} FROM m{i} WHERE m{i}.c = c{i}.c), c{i}.n) AS n FROM c{i})")
    return f"WITH {', '.join(p)} SELECT vec_id AS stable_id, c AS cluster FROM a{rounds - 1}"


@query(_kmeans_sql())
def kmeans_assign(spark, sf):
    return cluster.kmeans(snapshots(spark, sf), 4, 3)


@query("""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), c AS (SELECT label, count(*) AS n_members FROM embeddings GROUP BY 1)
SELECT CAST(m.label AS INTEGER) AS cluster, n_members, CAST(i - 1 AS INTEGER) AS i, round(x / n, 6) AS x FROM m JOIN n USING (label) JOIN c USING (label)""")
def cluster_centroids(spark, sf):
    s = snapshots(spark, sf).withColumn("cluster", F.col("repo").cast("int"))
    return cluster.centroids(s).select("cluster", "n_members", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query()
def cluster_layers(spark, sf):
    return cluster.layers(snapshots(spark, sf)).select("layer", "stable_id", F.size("members").alias("n_members"), "member_repos")


@query()
def cluster_retrieve(spark, sf):
    s = snapshots(spark, sf)
    q = list(s.filter("stable_id = 1").first().embedding)
    return cluster.retrieve(s, cluster.first_layer(s, 6), q, 10)[1].select("stable_id", F.size("members").alias("n_members"))


# refs, patterns, registry
_REFS = "VALUES ('a', 'refs/heads/main', 'c1'), ('a', 'refs/tags/v1', 'c2'), ('a', 'refs/heads/v1', 'c3'), ('b', 'refs/heads/master', 'c4')"
_ASKED = "VALUES ('a', 'v1'), ('a', NULL), ('a', 'c9'), ('a', 'refs/tags/v1'), ('b', NULL), ('b', 'nope')"


@query(f"""WITH r(repo, name, target) AS ({_REFS}), q(repo, raw_ref) AS ({_ASKED}), k(repo, id) AS (VALUES ('a', 'c9'), ('b', 'c4')), s(id, repo, commit) AS (VALUES ('s1', 'a', 'c1'), ('s3', 'a', 'c3')),
n AS (SELECT q.repo, q.raw_ref, p, CASE p WHEN 0 THEN raw_ref WHEN 1 THEN 'refs/heads/' || raw_ref ELSE 'refs/tags/' || raw_ref END AS name FROM q, range(0, 3) t(p) WHERE raw_ref IS NOT NULL
UNION ALL SELECT repo, raw_ref, p, 'refs/heads/' || ['main', 'master', 'trunk'][p + 1] FROM q, range(0, 3) t(p) WHERE raw_ref IS NULL),
h AS (SELECT n.repo, n.raw_ref, p, r.name AS ref_name, r.target AS commit FROM n JOIN r ON r.repo = n.repo AND r.name = n.name UNION ALL SELECT q.repo, q.raw_ref, 9, NULL, q.raw_ref FROM q JOIN k ON k.repo = q.repo AND k.id = q.raw_ref),
b AS (SELECT *, row_number() OVER (PARTITION BY repo, raw_ref ORDER BY p) AS rn FROM h)
SELECT q.repo, q.raw_ref, b.ref_name, b.commit, s.id AS snapshot_id FROM q LEFT JOIN b ON b.repo = q.repo AND b.raw_ref IS NOT DISTINCT FROM q.raw_ref AND b.rn = 1 LEFT JOIN s ON s.repo = b.repo AND s.commit = b.commit""")
def resolve_refs(spark, sf):
    r = spark.sql(f"SELECT * FROM ({_REFS}) AS t(repo, name, target)")
    q = spark.sql(f"SELECT * FROM ({_ASKED}) AS t(repo, raw_ref)")
    return refs.resolve_refs(q, r, spark.sql("SELECT * FROM (VALUES ('a', 'c9'), ('b', 'c4')) AS t(repo, id)"), spark.sql("SELECT * FROM (VALUES ('s1', 'a', 'c1'), ('s3', 'a', 'c3')) AS t(id, repo, commit)"))


@query("SELECT url, regexp_extract(regexp_replace(regexp_replace(rtrim(url, '/'), '\\.git$', ''), '^[a-z]+://[^/]+/?', ''), '^(.*)/[^/]+$', 1) AS owner FROM pages")
def owner_from_url(spark, sf):
    return table(spark, sf, "pages").select("url", T.owner_of(F.col("url")).alias("owner"))


@query("SELECT url, regexp_replace(rtrim(url, '/'), '\\.git$', '') AS normal, regexp_extract(rtrim(url, '/'), '([^/:]+)$', 1) AS repo FROM pages")
def url_normalise(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("url", T.normalise_git_url(u).alias("normal"), T.repo_name(u).alias("repo"))


_BRANCHES = "VALUES ('main'), ('dev'), ('release/1.0'), ('release/2.0'), ('feature/x'), ('old-main')"


@query(f"SELECT branch FROM ({_BRANCHES}) t(branch) WHERE (regexp_matches(branch, '^release/.*$') OR regexp_matches(branch, 'main')) AND NOT regexp_matches(branch, '^old.*$')")
def pattern_include_exclude(spark, sf):
    b = spark.sql(f"SELECT * FROM ({_BRANCHES}) AS t(branch)")
    return refs.include_exclude(b, "branch", ["release/*", "main"], ["old*"])


@query(f"SELECT 'a' AS repo, branch FROM ({_BRANCHES}) t(branch) WHERE regexp_matches(branch, '^release/.*$') UNION SELECT 'a', 'gone' UNION SELECT 'b', 'main'")
def branch_expand(spark, sf):
    b = spark.sql(f"SELECT 'a' AS repo, branch FROM ({_BRANCHES}) AS t(branch)")
    return refs.expand_branches(spark.createDataFrame([("a", "release/*, gone"), ("b", None)], "repo string, pattern string"), b)


_TAGS = "VALUES ('v1.2.0'), ('v1.10.0'), ('1.2.0-rc.1'), ('1.2.0-rc.10'), ('nightly'), ('v2.0.0'), ('beta')"


@query("SELECT 'a' AS repo, tag, position FROM (VALUES ('1.2.0-rc.10', 1), ('v1.2.0', 2), ('v1.10.0', 3), ('v2.0.0', 4)) t(tag, position)")
def tags_topn(spark, sf):
    return refs.top_tags(spark.sql(f"SELECT 'a' AS repo, tag FROM ({_TAGS}) AS t(tag)"), 4)


# dependencies
_REQ = "flask==2.0\\n# note\\nrequests>=2,<3\\n\\n-r more.txt\\nnumpy\\npkg ~= 1.4 "


@query("""WITH l AS (SELECT trim(unnest(string_split(E'flask==2.0\\n# note\\nrequests>=2,<3\\n\\n-r more.txt\\nnumpy\\npkg ~= 1.4 ', chr(10)))) AS l)
SELECT 'r' AS repo, trim(regexp_extract(l, '^([^=<>~!]+)', 1)) AS name, CASE WHEN regexp_matches(l, '[=<>~!]') THEN trim(regexp_replace(l, '^[^=<>~!]+(==|>=|<=|~=|!=|>|<)', '')) END AS version, 'python' AS language FROM l WHERE l <> '' AND l NOT LIKE '#%' AND l NOT LIKE '-%'""")
def deps_requirements(spark, sf):
    return deps.requirements(spark.createDataFrame([("r", _REQ.replace("\\n", "\n"))], "repo string, content string"))


_CATALOG = '[versions]\nk = "1.9"\n[libraries]\nkotlin-std = { module = "org.k:std", version.ref = "k" }\nplain = "g:n:3"\n'
_GRADLE = 'dependencies {\n implementation "com.a:b:1.0"\n api(libs.kotlin.std)\n testImplementation group: "x", name: "y", version: "2"\n implementation project(":core")\n}\n'


@query("SELECT 'r' AS repo, name, version, 'java' AS language FROM (VALUES ('com.a:b', '1.0'), ('org.k:std', '1.9'), ('x:y', '2'), (':core', NULL)) t(name, version)")
def deps_catalog_join(spark, sf):
    one = lambda c: spark.createDataFrame([("r", c)], "repo string, content string")
    return deps.gradle_dependencies(one(_GRADLE), one(_CATALOG))


_BOM = '{"bomFormat": "CycloneDX", "components": [{"type": "library", "name": "left", "version": "1.0", "purl": "pkg:x/left@1.0"}, {"type": "library", "name": "Right", "purl": null}]}'


@query(f"SELECT 's' AS sbom_id, json_extract_string(c, '$.name') AS name, json_extract_string(c, '$.version') AS version, json_extract_string(c, '$.purl') AS purl FROM (SELECT unnest(CAST(json_extract('{_BOM}', '$.components') AS JSON[])) AS c)")
def sbom_components(spark, sf):
    s = spark.createDataFrame([("s", "r", "c", _BOM), ("t", "r", "c", "not json")], "sbom_id string, repo string, commit string, json string")
    return deps.sbom_components(s).select("sbom_id", "name", "version", "purl")


@query("SELECT file_id, module, CAST(line AS INTEGER) AS line FROM (VALUES (1, 'os', 0), (1, 'a.b', 0), (1, 'c', 1), (2, 'fmt', 0), (3, './x', 0), (4, 'std::io', 0)) t(file_id, module, line)")
def import_modules(spark, sf):
    f = spark.createDataFrame([(1, "python", "import os, a.b as q\nfrom c import d\nx = 1"), (2, "go", 'import "fmt"'), (3, "javascript", "const a = require('./x')"), (4, "rust", "use std::io;")], "file_id int, lang string, content string")
    return extract.import_modules(f)


_SOURCES = [("r", "pkg/util.py", "def helper():\n    return 1\n\nclass Tool:\n    def run(self):\n        return self.step()\n    def step(self):\n        return helper()\n"), ("r", "main.py", "from pkg.util import helper as h\nimport pkg.util\n\ndef go():\n    h()\n    pkg.util.Tool().run()\n")]


@query("""SELECT * FROM (VALUES ('call', 'run', 'step'), ('call', 'step', 'helper'), ('call', 'go', 'helper'), ('call', 'go', 'run'), ('call', 'go', 'Tool'), ('containment', 'Tool', 'run'), ('containment', 'Tool', 'step'), ('import', 'main.py', 'util.py')) t(kind, src, dst)""")
def call_resolution(spark, sf):
    e, x = extract.code_graph(spark.createDataFrame(_SOURCES, "repo string, path string, content string"))
    n = e.select("id", "name")
    return x.join(n.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").select("kind", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


# conversations as chunks of a parent
@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def conversation_summary(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("chars"), F.min_by("role", "turn").alias("first_role"))


# events
def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def events_dedup(spark, sf):
    return events(spark, sf).groupBy("event_type", "user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def events_last_state(spark, sf):
    return ev.last_state(events(spark, sf), ["user_id"], ["event_type", "value"])


@query("SELECT DISTINCT user_id AS repo, event_type AS branch FROM events e WHERE NOT EXISTS (SELECT 1 FROM events l WHERE l.user_id = e.user_id AND l.event_type = e.event_type AND l.ts + INTERVAL 7 DAY > TIMESTAMP '2024-02-03')")
def events_unleased(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("repo"), F.col("event_type").alias("branch"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("until"))
    return refs.unleased(e.select("repo", "branch").distinct(), e, F.lit("2024-02-03").cast("timestamp"))


@query("SELECT user_id AS node_id, max(ts) >= TIMESTAMP '2024-01-30 00:00:00' AS healthy FROM events GROUP BY 1")
def events_healthy(spark, sf):
    return ev.healthy(events(spark, sf).select(F.col("user_id").alias("node_id"), "ts"), "2024-01-31", 86_400)


@query("""SELECT event_id FROM (SELECT event_id, user_id % 3 AS sha, lag(user_id % 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS old FROM events) WHERE old IS NULL OR old <> sha""")
def events_changed_commits(spark, sf):
    e = events(spark, sf).select("event_id", "ts", F.col("event_type").alias("repo_name"), F.lit("main").alias("branch"), (F.col("user_id") % 3).cast("string").alias("last_commit_sha"))
    return ev.changed_commits(e).select("event_id")


@query("""SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR >= ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_sessions(spark, sf):
    e = ev.sessions(events(spark, sf), "user_id", "6 hours")
    return e.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("first"), "n")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def events_props_json(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT event_type, epoch_ms(CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400000) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def events_windows(spark, sf):
    e = ev.windowed_counts(events(spark, sf), "1 day")
    return e.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_ingest_counts(spark, sf):
    """The table published to a queue, ingested by a stream that routes it by type,
    with a checkpoint, into a table."""
    root = fresh(spark, "stream")
    e = events(spark, sf).select("event_type", F.col("user_id").cast("string").alias("repo_name"), F.unix_millis("ts").alias("timestamp"), F.col("event_id").cast("string").alias("last_commit_sha"))
    jobs.publish(e, f"{root}/queue")

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.select("event_type", "last_commit_sha").write.mode("append").parquet(f"{root}/rows")

    kinds = ("view", "click", "signup", "purchase", "error")
    ev.ingest(event_stream(spark, f"{root}/queue"), dict.fromkeys(kinds, keep), f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows").groupBy("event_type").agg(F.countDistinct("last_commit_sha").alias("n"))


@query("SELECT event_type AS k, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1")
def stream_upserts(spark, sf):
    """The table as a stream of upserts into a keyed table, read back."""
    root = fresh(spark, "upserts")
    e = events(spark, sf).groupBy(F.col("event_type").alias("k")).agg(F.max("event_id").alias("last"), F.count("*").alias("n"))
    for part, rows in (("a", e.withColumn("last", F.lit(-1).cast("long"))), ("b", e)):
        jobs.publish(rows, f"{root}/queue/{part}")
        stream = spark.readStream.schema("k string, last long, n long").option("recursiveFileLookup", "true").json(f"{root}/queue")
        jobs.writer(stream, f"{root}/table", ["k"], "last", f"{root}/checkpoint").awaitTermination()
    return sinks.read_table(spark, f"{root}/table").select("k", "last", "n")


# trees and code
@query("SELECT source || '/' || doc_id || '.txt' AS path, strlen(text) AS size, text <> '' AS is_text, sha256(text) AS digest FROM documents WHERE strlen(text) <= 1000000")
def tree_documents(spark, sf):
    """The documents as files of a folder, walked and read."""
    root = mounted(spark, "tree")

    def write(parts):
        import os

        for p in parts:
            for repo, i, text in zip(p["source"], p["doc_id"], p["text"]):
                os.makedirs(f"{root}/{repo}", exist_ok=True)
                with open(f"{root}/{repo}/{i}.txt", "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield p[["doc_id"]]

    table(spark, sf, "documents").select("source", "doc_id", "text").mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return working_tree(spark, root).select("path", "size", "is_text", F.sha2("content", 256).alias("digest"))


_CODE = {
    "rs": ("concat('use crate::m', n, '::f', n, ' as g;\\n/// Calls.\\npub struct S', k, ';\\nimpl S', k, ' { pub fn m(&self) {} }\\nfn f', k, '() { g(); h', k, '(1); }\\nfn h', k, '(x: i32) {}\\n')"),
    "go": ("concat('package p\\n\\ntype S', k, ' struct {\\n}\\n\\nfunc (s *S', k, ') M() {}\\n\\nfunc G', k, '() { p.G', n, '() }\\n')"),
    "js": ("concat('import { j', n, ' as g } from \\'./n', n, '.js\\';\\nclass C', k, ' {\\n  m() { return 1; }\\n}\\nexport function j', k, '() { g(); }\\n')"),
}


def code(spark: SparkSession, sf: str) -> DataFrame:
    """A Rust, a Go and a JavaScript file for each supplier; each calls the next one."""
    t = table(spark, sf, "supplier")
    count = t.count()
    t = t.select(F.col("s_suppkey").cast("string").alias("k"), ((F.col("s_suppkey") + 1) % count).cast("string").alias("n"))
    each = [t.select(F.lit("r").alias("repo"), F.concat(F.lit(f"src/{ext}/{base}"), "k", F.lit(f".{ext}")).alias("path"), F.expr(body).alias("content")) for (ext, body), base in zip(_CODE.items(), "mgn")]
    return each[0].union(each[1]).union(each[2])


_NEXT = "(SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST((s_suppkey + 1) % (SELECT count(*) FROM supplier) AS VARCHAR) AS n FROM supplier)"


@query(f"""SELECT path, e[1] AS kind, e[2] AS name, e[3] AS methods FROM (
SELECT 'src/rs/m' || k || '.rs' AS path, unnest([['class', 'S' || k, 'm'], ['function', 'f' || k, ''], ['function', 'h' || k, '']]) AS e FROM {_NEXT}
UNION ALL SELECT 'src/go/g' || k || '.go', unnest([['class', 'struct', 'M'], ['function', 'G' || k, '']]) FROM {_NEXT}
UNION ALL SELECT 'src/js/n' || k || '.js', unnest([['class', 'C' || k, 'm'], ['function', 'j' || k, '']]) FROM {_NEXT})""")
def code_entities(spark, sf):
    e = extract.entities(code(spark, sf)).filter("kind <> 'file'")
    return e.select("path", "kind", "name", F.array_join("methods.name", ",").alias("methods"))


@query(f"""SELECT 'call' AS kind, 'f' || k AS a, 'f' || n AS b FROM {_NEXT} WHERE k <> n UNION ALL SELECT 'call', 'f' || k, 'h' || k FROM {_NEXT} UNION ALL SELECT 'call', 'G' || k, 'G' || n FROM {_NEXT} WHERE k <> n
UNION ALL SELECT 'call', 'j' || k, 'j' || n FROM {_NEXT} WHERE k <> n UNION ALL SELECT 'import', 'n' || k || '.js', 'n' || n || '.js' FROM {_NEXT} WHERE k <> n UNION ALL SELECT 'import', 'm' || k || '.rs', 'm' || n || '.rs' FROM {_NEXT} WHERE k <> n""")
def code_edges(spark, sf):
    e, x = extract.code_graph(code(spark, sf))
    n = e.select("id", "name")
    out = x.join(n.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return out.select("kind", "a", "b")


@query()
def lease_holder(spark, sf):
    e = events(spark, sf)
    r = e.select(F.col("event_type").alias("repo"), (F.unix_micros("ts") / 1e6).alias("time"), F.when(F.col("user_id") % 5 == 0, "release").otherwise("acquire").alias("action"), (F.col("user_id") % 7).cast("string").alias("holder"), F.lit(3600.0).alias("ttl"))
    return ev.leases(r)

