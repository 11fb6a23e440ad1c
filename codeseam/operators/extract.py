"""Symbols, imports, entities and calls from source files.

Symbols and import lines are regular and stay in the JVM; entities need a parser
(see ``languages``) and run in Arrow batches, a file a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.functions.text import entity_language, located, newlines
from codeseam.operators import languages
from codeseam.sources.folders import written

_ID = r"(\p{javaUnicodeIdentifierStart}\p{javaUnicodeIdentifierPart}*)"
#: extensions -> pattern whose group is the name
SYMBOL_PATTERNS = {
    "rs": rf"\b(?:fn|struct|enum|trait|type)\s+{_ID}",
    "py": rf"(?m)^\s*(?:async\s+)?(?:def|class)\s+{_ID}",
    "go": rf"\b(?:func\s+(?:\([^)]*\)\s*)?|type\s+){_ID}",
    "js jsx ts tsx": rf"\b(?:function\*?|class|interface|enum)\s+{_ID}",
    "java cs": rf"\b(?:class|interface|enum|record|struct)\s+{_ID}",
    "c h cpp cc cxx hpp hxx": rf"\b(?:class|struct|enum|union|namespace)\s+{_ID}",
    "swift": rf"\b(?:func|class|struct|enum|protocol|extension|actor)\s+{_ID}",
    "v sv": rf"\b(?:module|function|task)\s+(?:automatic\s+)?{_ID}",
    "ml mli": rf"(?m)^\s*(?:let(?:\s+rec)?|type|module|val)\s+{_ID}",
}


def symbols(docs: DataFrame, pattern: str | None = None) -> DataFrame:
    """repo, doc_id, name, start (byte), line (from 1), ord.  ``pattern``: one for
    all files, whose first group is the name; else by extension.  One scan."""

    def found(p: str) -> Column:
        def named(h: Column) -> Column:
            name = F.regexp_extract(h["hit"], p, 1)
            head = F.substring(h["hit"], F.lit(1), F.instr(h["hit"], name) - 1)
            return F.struct(name.alias("name"), (h["start"] + F.octet_length(head)).alias("start"), (h["line"] + newlines(head) + 1).alias("line"))

        return F.transform(located(F.col("content"), p, start=F.octet_length, line=newlines), named)

    if pattern:
        every = found(pattern)
    else:
        ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        every = F.lit(None).cast("array<struct<name:string,start:int,line:int>>")
        for exts, p in SYMBOL_PATTERNS.items():
            every = F.when(ext.isin(exts.split()), found(p)).otherwise(every)
    return docs.select("repo", "doc_id", F.posexplode(every).alias("ord", "s")).select("repo", "doc_id", "s.name", "s.start", "s.line", "ord")


def _quoted(line: Column) -> Column:
    return F.regexp_extract(line, r"""["'`]([^"'`]+)["'`]""", 1)


def import_modules(files: DataFrame) -> DataFrame:
    """(file_id, lang, content) -> file_id, module, line (from 0), by line rules."""
    each = files.select("file_id", "lang", F.posexplode(F.split("content", r"\r?\n")).alias("line", "t")).withColumn("t", F.trim("t"))
    t, lang = F.col("t"), F.col("lang")
    ex = lambda p: F.filter(F.array(F.regexp_extract(t, p, 1)), lambda x: x != "")
    first = lambda s: F.regexp_extract(F.trim(s), r"^([\w.]+)", 1)
    py = F.when(t.startswith("import "), F.transform(F.split(F.substring(t, F.lit(8), F.length(t)), ","), first)).when(t.startswith("from "), ex(r"^from\s+([\w.]+)\s+import\b"))
    js = F.when(t.rlike(r"^(?:import|export)\b.*['\"]|\brequire\("), F.array(_quoted(t)))
    rust = F.when(t.rlike(r"^(?:pub(?:\([^)]*\))?\s+)?use\s"), ex(r"\buse\s+([\w:]+?)(?:::\{.*|::\*)?(?:\s+as\s+\w+)?;?\s*$")).when(t.rlike(r"^(?:pub\s+)?mod\s+\w+\s*;"), ex(r"\bmod\s+(\w+)"))
    go = F.when(t.rlike(r"""^(?:import\s+)?(?:[\w.]+\s+)?"[^"]+"$"""), F.array(_quoted(t)))
    java = ex(r"^import\s+(?:static\s+)?([\w.]+)")
    c = ex(r"""^#\s*include\s*[<"]([^>"]+)[>"]""")
    cs = ex(r"^using\s+(?:static\s+)?([\w.]+)\s*;")
    found = (
        F.when(lang == "python", py).when(lang.isin("javascript", "typescript", "tsx"), js).when(lang == "rust", rust).when(lang == "go", go)
        .when(lang.isin("java", "kotlin", "swift"), java).when(lang.isin("c", "cpp"), c).when(lang.isin("c_sharp", "csharp"), cs)
    )
    return each.select("file_id", F.explode(found).alias("module"), "line").filter("module <> ''")


METHOD = "struct<name:string,visibility:string,signature:string,start_line:int,end_line:int>"
IMPORT = "struct<module:string,symbol:string,alias:string,line:int>"
ENTITY = f"repo string, path string, lang string, kind string, name string, parent string, signature string, start_line int, end_line int, doc string, calls array<string>, methods array<{METHOD}>, imports array<{IMPORT}>"


def file_rows(path: str, lang: str | None, source: str) -> list[tuple]:
    """A file's own row, from its first import's line to its last one's, with its
    imports; then its entities' rows (kind ... imports)."""
    found = languages.imports(source, lang)
    at = [i[3] for i in found] or [0]
    name = path.rsplit("/", 1)[-1]
    out = [("file", name, None, "", min(at), max(at), None, [], [], found)]
    for e in languages.entities(source, lang) or ():
        methods = [(m.name, m.visibility, m.signature, m.start_line, m.end_line) for m in e.methods]
        out.append((e.kind, e.name, e.parent, e.signature, e.start_line, e.end_line, e.doc, e.calls, methods, []))
    return out


def entities(files: DataFrame) -> DataFrame:
    """(repo, path, content) -> entities of all languages, each file's own row with
    them; id by (repo, path, start_line, kind, name), so the same on every run.
    Files of other languages have their own row only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for repo, path, lang, source in zip(p["repo"], p["path"], p["lang"], p["content"]):
                rows += [(repo, path, lang, *e) for e in file_rows(path, lang, source or "")]
            yield pd.DataFrame(rows, columns=["repo", "path", "lang", "kind", "name", "parent", "signature", "start_line", "end_line", "doc", "calls", "methods", "imports"])

    out = files.select("repo", "path", entity_language(F.col("path")).alias("lang"), "content").mapInPandas(run, ENTITY)
    return out.withColumn("id", F.xxhash64("repo", "path", "start_line", "kind", "name"))


def containment_edges(e: DataFrame) -> DataFrame:
    """parent -> child within a file; of several parents of the name the last."""
    w = Window.partitionBy("repo", "path", F.lower("name")).orderBy(F.desc("start_line"), F.desc("id"))
    p = e.filter("kind <> 'file'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("repo", "path", F.lower("name").alias("pn"), F.col("id").alias("src"))
    c = e.filter("parent IS NOT NULL").select("repo", "path", F.lower("parent").alias("pn"), F.col("id").alias("dst"))
    return c.join(p, ["repo", "path", "pn"]).filter("src <> dst").select("src", "dst", F.lit("containment").alias("kind"), F.lit(None).cast("int").alias("line"))


def _leaf(dotted: Column) -> Column:
    return F.lower(F.element_at(F.split(dotted, r"\."), -1))


def resolved_imports(e: DataFrame) -> DataFrame:
    """Every import: repo, path, src (the file), module, symbol, bound (the name it
    has in the file), line, dst: the imported file, or null.  Modules, any case:
    the exact dotted path, its longest beginning, a base name that one file only
    has (of the module, then of what is imported from it)."""
    f = e.filter("kind = 'file'")
    dotted = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""), r"/__init__$", ""), "/", "."))
    modules = f.select("repo", dotted.alias("module_key"), F.col("id").alias("dst")).groupBy("repo", "module_key").agg(F.min("dst").alias("dst"))
    unique = f.select("repo", _leaf(dotted).alias("base"), "id").groupBy("repo", "base").agg(F.min("id").alias("base_dst"), F.count("*").alias("n")).filter("n = 1").drop("n")
    imp = f.select("repo", "path", F.col("id").alias("src"), F.posexplode("imports").alias("nth", "i")).select("repo", "path", "src", "nth", "i.*")
    none = lambda c: F.nullif(c, F.lit(""))
    full = F.lower(F.concat_ws(".", none(F.col("module")), "symbol"))
    parts = F.split(full, r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("len"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("module_key")))
    prefix = imp.select("repo", "src", "nth", F.explode(begins).alias("p")).select("repo", "src", "nth", "p.*")
    best = prefix.join(modules, ["repo", "module_key"]).groupBy("src", "nth").agg(F.max_by("dst", "len").alias("by_prefix"))
    by = lambda name: unique.select("repo", F.col("base").alias(f"{name}_key"), F.col("base_dst").alias(name))
    rows = imp.withColumn("m_key", _leaf(F.coalesce(none(F.col("module")), F.col("symbol")))).withColumn("s_key", F.lower("symbol"))
    rows = rows.join(best, ["src", "nth"], "left").join(by("m"), ["repo", "m_key"], "left").join(by("s"), ["repo", "s_key"], "left")
    bound = F.coalesce("alias", "symbol", F.element_at(F.split("module", r"\."), 1))
    return rows.select("repo", "path", "src", "module", "symbol", bound.alias("bound"), "line", F.coalesce("by_prefix", "m", "s").alias("dst"))


def import_edges(imports: DataFrame) -> DataFrame:
    """file -> imported file, each pair once, with the first line."""
    hit = imports.filter("dst IS NOT NULL AND dst <> src").groupBy("src", "dst").agg(F.min("line").alias("line"))
    return hit.select("src", "dst", F.lit("import").alias("kind"), "line")


def unresolved_imports(imports: DataFrame) -> DataFrame:
    return imports.filter("dst IS NULL").select("repo", "path", "module", "line").distinct()


def call_edges(e: DataFrame, imports: DataFrame) -> DataFrame:
    """caller -> callee by the first rule that finds one, on the last dotted part in
    lower case: same file, same parent, the one entity of that name in the
    repository, an imported name (in the file it comes from, else the one entity
    of that name), a file imported, an alias before the dot.  A call that two
    spellings lead to counts twice."""
    defs = e.filter("kind <> 'file'").select("id", "repo", "path", F.lower("name").alias("n"), F.lower("parent").alias("par"), "start_line")
    calls = e.filter("kind <> 'file'").select(F.col("id").alias("src"), "repo", "path", F.lower("parent").alias("par"), F.explode("calls").alias("raw"))
    calls = calls.withColumn("n", _leaf(F.col("raw"))).withColumn("head", F.lower(F.element_at(F.split("raw", r"\."), 1)))
    last = lambda df, keys, name: df.groupBy(*keys).agg(F.max_by("id", F.struct("start_line", "id")).alias(name))
    r1 = last(defs, ["repo", "path", "n"], "r1")
    r2 = last(defs.filter("par IS NOT NULL"), ["repo", "path", "par", "n"], "r2")
    r3 = defs.groupBy("repo", "n").agg(F.min("id").alias("r3"), F.count("*").alias("c")).filter("c = 1").drop("c")
    files = e.filter("kind = 'file'").select(F.col("id").alias("dst"), "repo", "path")
    target = defs.join(files, ["repo", "path"]).select("dst", "n", "id", "start_line")
    via = imports.select("repo", "path", F.lower("bound").alias("bound"), F.lower("symbol").alias("symbol"), "dst")
    named = via.filter("symbol IS NOT NULL")
    found = named.join(target, "dst").filter("n = symbol").select("repo", "path", F.col("bound").alias("n"), "id", "start_line")
    anywhere = named.filter("dst IS NULL").join(r3.select("repo", F.col("n").alias("symbol"), F.col("r3").alias("id")), ["repo", "symbol"]).select("repo", "path", F.col("bound").alias("n"), "id", F.lit(-1).alias("start_line"))
    r4 = last(found.unionByName(anywhere), ["repo", "path", "n"], "r4")
    every = via.join(target, "dst")
    r5 = last(every.select("repo", "path", "n", "id", "start_line"), ["repo", "path", "n"], "r5")
    r6 = last(every.select("repo", "path", F.col("bound").alias("head"), "n", "id", "start_line"), ["repo", "path", "head", "n"], "r6")
    out = calls.join(r1, ["repo", "path", "n"], "left").join(r2, ["repo", "path", "par", "n"], "left").join(r3, ["repo", "n"], "left")
    out = out.join(r4, ["repo", "path", "n"], "left").join(r5, ["repo", "path", "n"], "left").join(r6, ["repo", "path", "head", "n"], "left")
    dst = F.coalesce("r1", "r2", "r3", "r4", "r5", "r6")
    return out.withColumn("dst", dst).filter("dst IS NOT NULL AND dst <> src").select("src", "dst", F.lit("call").alias("kind"), F.lit(None).cast("int").alias("line"))


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and all their edges (src, dst, kind, line).  Sources are parsed once:
    entities and resolved imports, which every rule reads, are written."""
    e = written(entities(files), "entities")
    imports = written(resolved_imports(e), "imports")
    edges = containment_edges(e).unionByName(import_edges(imports)).unionByName(call_edges(e, imports))
    return e, edges
