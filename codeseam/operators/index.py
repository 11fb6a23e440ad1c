"""Index tables: terms, content and symbol trigrams, document frequencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import text as T
from codeseam.operators import postings as P
from codeseam.operators.search import file_filters, literal_column, regex_column, repo_filter, results
from codeseam.plans import querylang as ql
from codeseam.plans.regexlang import prefilter, trigrams_of


def terms(docs: DataFrame) -> DataFrame:
    """token, repo, doc_id; distinct.  Row local: no shuffle."""
    return docs.select(F.explode(T.tokens(F.col("content"))).alias("token"), "repo", "doc_id")


def content_trigrams(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """tri, repo, doc_id, positions (bytes, ascending): a posting a row; ``only``:
    of these trigrams, texts without any aren't moved."""
    if only is not None:
        low = T.ascii_lower(F.col("content"))
        docs = docs.filter(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in only], F.lit(False)))
    return P.flat_trigrams(docs, only)


def document_trigrams(docs: DataFrame) -> DataFrame:
    """tri, repo, doc_id; distinct, without positions."""
    return docs.select(F.explode(F.array_distinct(T.trigrams(F.col("content")))).alias("tri"), "repo", "doc_id")


def symbol_trigrams(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.explode(F.array_distinct(T.trigrams(F.col("name")))).alias("tri"), "repo", "doc_id").distinct()


def document_frequency(postings: DataFrame, key: str = "tri") -> DataFrame:
    """Of postings a row each, or of the number ``n`` each segment has of a key."""
    df = F.sum("n") if "n" in postings.columns else F.count("*")
    return postings.groupBy(key).agg(df.alias("df"))


def candidates(postings: DataFrame, needs: list[frozenset[str]]) -> DataFrame:
    """(repo, doc_id) of documents with all trigrams of one of the sets: one scan
    of the postings, pruned to the trigrams asked for, and one aggregation."""
    wanted = sorted(set().union(*needs))
    hits = postings.filter(F.col("tri").isin(wanted)).groupBy("repo", "doc_id").agg(F.collect_set("tri").alias("have"))
    ok = reduce(lambda a, b: a | b, [F.size(F.array_intersect("have", F.array(*map(F.lit, sorted(n))))) == len(n) for n in needs])
    return hits.filter(ok).select("repo", "doc_id")


def indexed_literal(docs: DataFrame, postings: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """Documents with the literal, by its trigrams first where it has some."""
    needs = trigrams_of(needle)
    base = docs.join(candidates(postings, [needs]), ["repo", "doc_id"], "left_semi") if needs else docs
    return base.filter(literal_column(needle, case_sensitive))


def indexed_regex(docs: DataFrame, postings: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """Documents that match the regex: a sound prefilter, then the regex itself."""
    needs = prefilter(pattern)
    base = docs.join(candidates(postings, needs), ["repo", "doc_id"], "left_semi") if needs else docs
    return base.filter(regex_column(pattern, case_sensitive))


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n_bytes"))


VERSION = 3
TABLES = ("docs", "symbols", "content_tri", "symbol_tri", "terms")


def write_index(docs: DataFrame, symbols: DataFrame, path: str, version: int = VERSION, only: tuple[str, ...] = TABLES) -> None:
    """A folder of Parquet tables (``only``: some of them), each in the order of
    what it is asked by: a look-up of a few trigrams, terms or documents reads a
    few row groups.  Documents and symbols lie in ranges; trigrams and terms of
    contents are a row a segment of documents, ordered within it."""

    def write(name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}")

    def put(name: str, rows: DataFrame, *order: str) -> None:
        write(name, rows.repartitionByRange(*order).sortWithinPartitions(*order))

    makers = {
        "docs": lambda: put("docs", docs, "repo", "doc_id"),
        "symbols": lambda: put("symbols", symbols, "repo", "doc_id", "start"),
        "content_tri": lambda: write("content_tri", P.packed_trigrams(docs)),
        "symbol_tri": lambda: put("symbol_tri", symbol_trigrams(symbols), "tri", "repo", "doc_id"),
        "terms": lambda: write("terms", P.packed_terms(docs, T.tokens)),
    }
    for name in only:
        makers[name]()
    totals(docs).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str, only: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables by name, a row a posting; of contents also how many documents of
    a segment have a trigram or term (content_tri_n, terms_n) and the trigrams with
    their positions (content_pos)."""
    meta = spark.read.parquet(f"{path}/meta")
    if meta.filter(F.col("version") != VERSION).limit(1).count():
        raise ValueError("index of another version")
    out = {t: spark.read.parquet(f"{path}/{t}") for t in only} | {"meta": meta}
    for name, key in (("content_tri", "tri"), ("terms", "token")):
        if name in out:
            packed = out[name]
            out[name], out[f"{name}_n"] = packed.select(key, F.inline("docs")), packed.select(key, "n")
            if name == "content_tri":
                each = packed.select(key, F.explode(F.arrays_zip("docs", "positions")).alias("p"))
                out["content_pos"] = each.select(key, "p.docs.repo", "p.docs.doc_id", "p.positions")
    return out


def _among(docs: DataFrame, found: DataFrame) -> DataFrame:
    return docs.join(found.select("repo", "doc_id"), ["repo", "doc_id"], "left_semi")


def content_candidates(tables: dict[str, DataFrame], plan: ql.QueryPlan, mode: str = "term_first") -> tuple[DataFrame, bool]:
    """Documents whose content may match the plan's pattern, by the index, and
    whether they surely do (a term)."""
    docs = tables["docs"]
    if plan.regex:
        needs = prefilter(plan.pattern)
    else:
        if mode == "term_first" and not plan.case_sensitive:
            of = tables["terms"].filter(F.col("token") == plan.pattern.lower())
            if not of.isEmpty():  # reads the row groups of one token
                return _among(docs, of), True
        one = trigrams_of(plan.pattern)
        needs = [one] if one else None
    return (docs if needs is None else _among(docs, candidates(tables["content_tri"], needs))), False


def matching(tables: dict[str, DataFrame], plan: ql.QueryPlan | str, mode: str = "term_first") -> DataFrame:
    """What ``search.matching`` finds, read from the index: candidates by term or
    trigram, tested; paths are tested on a scan that reads no content."""
    plan = ql.parse(plan) if isinstance(plan, str) else plan
    docs = tables["docs"]
    scope = reduce(lambda a, b: a & b, [repo_filter(plan), *file_filters(plan)])
    if not plan.pattern:
        return docs.filter(scope)
    by_path = docs.filter(scope & literal_column(plan.pattern, plan.case_sensitive, F.col("path")))
    if plan.path_only and not plan.content_only:
        return by_path
    rows, sure = content_candidates(tables, plan, mode)
    rows = rows.filter(scope)
    if not sure:
        rows = rows.filter(regex_column(plan.pattern, plan.case_sensitive) if plan.regex else literal_column(plan.pattern, plan.case_sensitive))
    if plan.content_only:
        return rows
    more = by_path.join(rows.select("repo", "doc_id"), ["repo", "doc_id"], "left_anti")
    return rows.unionByName(more)


def symbol_candidates(tables: dict[str, DataFrame], plan: ql.QueryPlan) -> DataFrame:
    """(repo, doc_id) of documents that may have a symbol the pattern names: by the
    trigrams of symbols where the pattern surely needs some, else all with symbols."""
    needs = prefilter(plan.pattern) if plan.regex else [trigrams_of(plan.pattern)]
    if not needs or not all(needs):
        return tables["symbols"].select("repo", "doc_id").distinct()
    return candidates(tables["symbol_tri"], needs)


def search_index(tables: dict[str, DataFrame], plan: ql.QueryPlan | str, mode: str = "term_first") -> DataFrame:
    """``search.search`` over an index."""
    plan = ql.parse(plan) if isinstance(plan, str) else plan
    found = matching(tables, plan, mode)
    symbols = tables["symbols"] if plan.select == "symbol" else None
    if plan.select == "symbol" and plan.pattern:
        near = symbol_candidates(tables, plan)
        found, symbols = _among(found, near), _among(symbols, near)
    return results(found, plan, symbols)
