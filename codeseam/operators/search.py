"""Search over a table of documents: (repo, doc_id, path, lang, branches, content).

A plan becomes one boolean Column over one scan, so Catalyst prunes columns and
pushes what it can; only term-first literals add a one-row aggregate.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.functions.text import TOKEN_SPLIT, ascii_lower
from codeseam.plans import querylang as ql
from codeseam.plans.regexlang import to_java


def literal_column(needle: str, case_sensitive: bool = False, content: Column | None = None) -> Column:
    c = F.col("content") if content is None else content
    if case_sensitive:
        return F.contains(c, F.lit(needle))
    return F.contains(F.lower(c), F.lit(needle.lower()))


def regex_column(pattern: str, case_sensitive: bool = False, content: Column | None = None) -> Column:
    """Whole-document match; a pattern that isn't of the dialect matches nothing."""
    java = to_java(pattern, not case_sensitive)
    c = F.col("content") if content is None else content
    return F.lit(False) if java is None else c.rlike(java)


def token_column(needle: str, content: Column | None = None) -> Column:
    """Whether the document has the needle as a whole token."""
    c = F.col("content") if content is None else content
    return F.array_contains(F.split(F.lower(c), TOKEN_SPLIT), needle.lower())


def boolean_column(q) -> Column:
    """An And/Or/Not expression of literals and regexes."""
    if isinstance(q, ql.Literal):
        return literal_column(q.text, q.case_sensitive)
    if isinstance(q, ql.Regex):
        return regex_column(q.pattern, True)
    if isinstance(q, ql.Not):
        return ~F.coalesce(boolean_column(q.of), F.lit(False))
    return (and_ if isinstance(q, ql.And) else or_)(boolean_column(q.left), boolean_column(q.right))


def search_boolean(docs: DataFrame, q) -> DataFrame:
    return docs.filter(boolean_column(q))


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns)


def repo_filter(plan: ql.QueryPlan) -> Column:
    tests = []
    if plan.repos:
        tests.append(F.col("repo").isin(*plan.repos))
    tests += [F.col("repo").rlike(ql.glob_to_regex(g)) for g in plan.repo_globs]
    tests += [regex_column(r, True, F.col("repo")) for r in plan.repo_regexes]
    return _any(tests) if tests else F.lit(True)


def file_filters(plan: ql.QueryPlan) -> list[Column]:
    """Branches and languages: any of them; globs: any, on the whole path; regexes: all."""
    out = []
    if plan.branches:
        out.append(F.arrays_overlap("branches", F.array(*map(F.lit, plan.branches))))
    if plan.langs:
        out.append(F.coalesce(F.lower("lang"), F.lit("")).isin(*plan.langs))
    flag = "" if plan.case_sensitive else "(?i)"
    if plan.file_globs:
        out.append(_any([F.col("path").rlike(flag + ql.glob_to_regex(g)) for g in plan.file_globs]))
    out += [regex_column(r, plan.case_sensitive, F.col("path")) for r in plan.file_regexes]
    return out


def pattern_column(plan: ql.QueryPlan, seen: Column | None) -> Column:
    """Content or path; seen: whether any document has the pattern as a token."""
    if not plan.pattern:
        return F.lit(True)
    path = literal_column(plan.pattern, plan.case_sensitive, F.col("path"))
    if plan.regex:
        content = regex_column(plan.pattern, plan.case_sensitive)
    else:
        content = literal_column(plan.pattern, plan.case_sensitive)
        if seen is not None:
            content = F.when(seen, token_column(plan.pattern)).otherwise(content)
    if plan.content_only:
        return content
    return path if plan.path_only else content | path


def matching(docs: DataFrame, plan: ql.QueryPlan | str, mode: str = "term_first") -> DataFrame:
    """Documents that match.  mode 'term_first': a literal that some document has
    as a token finds documents with that token only; 'substring': never so."""
    plan = ql.parse(plan) if isinstance(plan, str) else plan
    scope = reduce(and_, [repo_filter(plan), *file_filters(plan)])
    first = mode == "term_first" and plan.pattern and not plan.regex and not plan.case_sensitive
    if not first:
        return docs.filter(scope & pattern_column(plan, None))
    seen = docs.agg(F.coalesce(F.bool_or(token_column(plan.pattern)), F.lit(False)).alias("__seen"))
    # one row, so its broadcast is bounded
    return docs.filter(scope).join(F.broadcast(seen)).filter(pattern_column(plan, F.col("__seen"))).drop("__seen")


def search(docs: DataFrame, plan: ql.QueryPlan | str, symbols: DataFrame | None = None, mode: str = "term_first") -> DataFrame:
    """Results: repo, doc_id, path, symbol, symbol_start, symbol_line, score.

    select:file is a row a document, score 1; select:repo a row a repository,
    doc_id 0; select:symbol the symbols (repo, doc_id, name, start, line) of
    matching documents whose names match, score 2.
    """
    plan = ql.parse(plan) if isinstance(plan, str) else plan
    return results(matching(docs, plan, mode), plan, symbols)


def results(found: DataFrame, plan: ql.QueryPlan, symbols: DataFrame | None) -> DataFrame:
    """The result rows of matching documents."""
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    blank = [none("string", "symbol"), none("int", "symbol_start"), none("int", "symbol_line")]
    if plan.select == "repo":
        return found.select("repo").distinct().select("repo", F.lit(0).cast("long").alias("doc_id"), none("string", "path"), *blank, F.lit(1.0).cast("float").alias("score"))
    if plan.select == "symbol":
        if symbols is None:
            raise ValueError("select:symbol needs a table of symbols")
        hits = found.select("repo", "doc_id", "path").join(symbols.select("repo", "doc_id", "name", "start", "line"), ["repo", "doc_id"])
        if plan.pattern:
            test = regex_column if plan.regex else literal_column
            hits = hits.filter(test(plan.pattern, plan.case_sensitive, F.col("name")))
        return hits.select("repo", "doc_id", "path", F.col("name").alias("symbol"), F.col("start").alias("symbol_start"), F.col("line").alias("symbol_line"), F.lit(2.0).cast("float").alias("score"))
    return found.select("repo", "doc_id", "path", *blank, F.lit(1.0).cast("float").alias("score"))


def visible(docs: DataFrame, repos: DataFrame, user: str | None) -> DataFrame:
    """Documents whose repository the user may see: public or unknown ones,
    private ones for any user, restricted ones for their members.  Any other
    visibility hides (fails closed)."""
    who = F.lit(user).cast("string")
    kind = F.lower("visibility")
    allowed = F.when(F.col("__known").isNull(), True).when(kind == "public", True).when(kind == "private", who.isNotNull()).when(kind == "restricted", F.coalesce(F.array_contains("allowed_users", who), F.lit(False))).otherwise(False)
    meta = repos.select(F.col("name").alias("repo"), "visibility", "allowed_users", F.lit(1).alias("__known"))
    return docs.join(meta, "repo", "left").filter(allowed).select(docs.columns)


def merge_results(parts: list[DataFrame], limit: int | None = 100) -> DataFrame:
    """Results of several indexes as one: equal hits once, in a stable order."""
    key = ["repo", "path", "symbol", "symbol_line"]
    out = reduce(DataFrame.unionByName, parts).dropDuplicates(key).orderBy(F.desc("score"), *key)
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, order: list, start: int, limit: int) -> DataFrame:
    """Rows start .. start + limit - 1 in the given (total) order, and has_more."""
    rows = df.orderBy(*order).offset(start).limit(limit + 1)
    # at most limit + 1 rows: numbered in one task, which the top-k ends in anyway
    every = Window.partitionBy(F.lit(0))
    numbered = rows.withColumn("__rn", F.row_number().over(every.orderBy(*order))).withColumn("has_more", F.count("*").over(every) > limit)
    return numbered.filter(F.col("__rn") <= limit).drop("__rn")


def distributed(indexes: dict[str, DataFrame], line: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), start: int = 0, limit: int = 100, mode: str = "substring", symbols: dict[str, DataFrame] | None = None) -> DataFrame:
    """One query over the indexes of several nodes: file patterns to include and to
    exclude hold on every one, equal hits count once, a page in a stable order,
    with node_id (of equal hits, the least) and has_more."""
    plan = ql.parse(line)
    parts = []
    for node, docs in indexes.items():
        if include:
            docs = docs.filter(_any([regex_column(p, False, F.col("path")) for p in include]))
        for p in exclude:
            docs = docs.filter(~F.coalesce(regex_column(p, False, F.col("path")), F.lit(False)))
        parts.append(search(docs, plan, (symbols or {}).get(node), mode).withColumn("node_id", F.lit(node)))
    key = ["repo", "path", "symbol", "symbol_line"]
    rows = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.min("node_id").alias("node_id"), F.max("score").alias("score"))
    return page(rows, [F.desc("score"), *key], start, limit)


__all__ = ["ascii_lower", "boolean_column", "distributed", "matching", "merge_results", "page", "results", "search", "search_boolean", "visible"]
