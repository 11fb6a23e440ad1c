"""Hits within documents: lines, byte offsets, contexts, snippets, symbols near."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions.text import let, located, newlines, running, trim_first, trim_last
from codeseam.plans.regexlang import to_java


def matches(docs: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = True, context: int = 0, path_prefix: str | None = None, path_regex: str | None = None, branch: str | None = None, limit: int | None = None, text: bool = True) -> DataFrame:
    """A row a hit: repo, doc_id, path, line (from 1), start_byte, end_byte, hit,
    and with ``text`` before, line_text, after: ``context`` characters of the line
    on either side, and its text.  Hits of zero length are none.

    Places and lines are made within the document's row, from what lies between
    hits; the content itself isn't carried along with every hit.  Linear in the
    document; with ``text`` also in the texts returned.
    """
    java = to_java(pattern, not case_sensitive) if regex else ("" if case_sensitive else "(?iu)") + re.escape(pattern)
    if path_prefix is not None:
        docs = docs.filter(F.col("path").startswith(path_prefix))
    if path_regex is not None:
        docs = docs.filter(F.col("path").rlike(to_java(path_regex, False) or "(?!)"))
    if branch is not None:
        docs = docs.filter(F.array_contains("branches", branch))
    if java is None or not pattern:
        java = "(?!)"
    c = F.col("content")
    found = F.filter(located(c, java, start=F.length, byte=F.octet_length, line=newlines), lambda h: h["end"] > h["start"])
    own = lambda h: [(h["line"] + 1).alias("line"), h["byte"].alias("start_byte"), (h["byte"] + F.octet_length(h["hit"])).alias("end_byte"), h["hit"].alias("hit")]
    if text:

        def with_text(t: Column) -> Column:
            def row(h: Column) -> Column:
                last = h["line"] + newlines(h["hit"])
                before = F.substring(F.get(t["lines"], h["line"]), F.lit(1), h["start"] - F.get(t["starts"], h["line"]))
                tail = F.get(t["lines"], last)
                after = F.substring(tail, h["end"] - F.get(t["starts"], last) + 1, F.length(tail))
                return F.struct(*own(h), before.alias("b"), after.alias("a"))

            return F.transform(found, row)

        table = let(F.split(c, "\n", -1), lambda ls: F.struct(ls.alias("lines"), running(F.transform(ls, lambda x: F.length(x) + 1)).alias("starts")))
        rows = let(table, with_text)
    else:
        rows = F.transform(found, lambda h: F.struct(*own(h)))
    out = docs.filter(c.rlike(java)).select("repo", "doc_id", "path", F.explode(rows).alias("h"))
    cols = ["repo", "doc_id", "path", "h.line", "h.start_byte", "h.end_byte"]
    if text:
        out = out.select(*cols, trim_last(F.col("h.b"), context).alias("before"), F.concat("h.b", "h.hit", "h.a").alias("line_text"), trim_first(F.col("h.a"), context).alias("after"), "h.hit")
    else:
        out = out.select(*cols, "h.hit")
    return out if limit is None else out.orderBy("repo", "path", "start_byte").limit(limit)


def lines(docs: DataFrame) -> DataFrame:
    """line from 1, text with its line end but for the last."""
    each = docs.select("repo", "doc_id", "path", F.split("content", "\n", -1).alias("ls")).select("repo", "doc_id", "path", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "t"))
    return each.select("repo", "doc_id", "path", (F.col("i") + 1).alias("line"), F.when(F.col("i") < F.col("n") - 1, F.concat("t", F.lit("\n"))).otherwise(F.col("t")).alias("text"))


def snippet_terms(needle: str) -> str:
    """What a snippet looks for: /regex/, else quoted phrases, else any word."""
    if len(needle) > 2 and needle[0] == needle[-1] == "/":
        return to_java(needle[1:-1], True) or "(?!)"
    phrases = re.findall(r'"([^"]+)"', needle) or needle.split()
    return "(?iu)" + ("|".join(map(re.escape, phrases)) or "(?!)")


def snippets(docs: DataFrame, needle: str, context: int = 2) -> DataFrame:
    """repo, doc_id, path, snippet: hit lines and ``context`` lines around, numbered,
    touching stretches joined, others parted by '...'.  Row local, linear in lines."""
    test = snippet_terms(needle)
    numbered = F.transform(F.split("content", "\n", -1), lambda t, i: F.struct(i.alias("i"), t.alias("t"), t.rlike(test).alias("hit")))
    flags = F.transform("ls", lambda x: x["hit"])

    def near(x: Column) -> Column:
        first = F.greatest(x["i"] - context, F.lit(0))
        return F.exists(F.slice("flags", first + 1, x["i"] - first + context + 1), lambda hit: hit)

    def said(x: Column, j: Column) -> Column:
        gap = F.when((j > 0) & (F.get("shown", j - 1)["i"] < x["i"] - 1), "...\n").otherwise("")
        return F.concat(gap, F.lpad((x["i"] + 1).cast("string"), 6, " "), F.when(x["hit"], " > ").otherwise("   "), x["t"], F.lit("\n"))

    rows = docs.filter(F.col("content").rlike(test)).select("repo", "doc_id", "path", numbered.alias("ls"))
    rows = rows.withColumn("flags", flags).withColumn("shown", F.filter("ls", near))
    return rows.select("repo", "doc_id", "path", F.array_join(F.transform("shown", said), "").alias("snippet"))


def nearest_symbol(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hits with symbol: the last one that starts at or before the hit.  An as-of
    join: both sides in one order within a document, the last symbol carried on."""
    from pyspark.sql import Window

    key = ["repo", "doc_id"]
    marks = symbols.select(*key, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.col("name").alias("symbol"), F.lit(None).cast(hits.select(F.struct("*")).schema[0].dataType).alias("__row"))
    asked = hits.select(*key, F.col("start_byte").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("symbol"), F.struct("*").alias("__row"))
    before = Window.partitionBy(*key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(asked).withColumn("symbol", F.last("symbol", ignorenulls=True).over(before))
    return both.filter("__kind = 1").select("__row.*", "symbol")
