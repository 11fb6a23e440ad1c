"""Declared dependencies and software bills of materials."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = ("==", ">=", "<=", "~=", "!=", ">", "<")
MANIFESTS = ("requirements.txt", "Pipfile", "Cargo.toml", "build.gradle", "build.gradle.kts", "gradle/libs.versions.toml", "pyproject.toml")


def requirements(files: DataFrame) -> DataFrame:
    """(repo, content) -> repo, name, version, language: lines but blank ones,
    comments and options; the first operator in a fixed order that a line has
    parts name and version."""
    line = F.explode(F.split("content", r"\r?\n"))
    rows = files.select("repo", line.alias("l")).withColumn("l", F.trim("l")).filter("l <> '' AND NOT startswith(l, '#') AND NOT startswith(l, '-')")
    name, version = F.col("l"), F.lit(None).cast("string")
    for op in reversed(OPERATORS):
        has = F.contains("l", F.lit(op))
        name = F.when(has, F.trim(F.substring_index("l", op, 1))).otherwise(name)
        rest = F.trim(F.expr(f"substring(l, instr(l, '{op}') + {len(op)})"))
        version = F.when(has, rest).otherwise(version)
    return rows.select("repo", name.alias("name"), version.alias("version"), F.lit("python").alias("language"))


def cargo_rows(content: str) -> list[tuple[str, str | None, str]]:
    try:
        t = tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        return []
    out = []
    for section in ("dependencies", "dev-dependencies"):
        for name, v in (t.get(section) or {}).items():
            out.append((name, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None, "rust"))
    return out


def _block_bodies(content: str, word: str) -> list[tuple[int, str]]:
    """Bodies of ``word { ... }`` with matched braces, and where each begins."""
    out = []
    for m in re.finditer(rf"\b{word}\s*\{{", content):
        depth, i = 1, m.end()
        while i < len(content) and depth:
            depth += {"{": 1, "}": -1}.get(content[i], 0)
            i += 1
        out.append((m.end(), content[m.end() : i - 1]))
    return out


_CONF = r"\b(?P<kind>[A-Za-z]*(?:[iI]mplementation|[aA]pi|[cC]ompile(?:Only)?|[rR]untimeOnly|[kK]apt|[cC]lasspath|annotationProcessor))"
_LITERAL = re.compile(_CONF + r"""\s*\(?\s*["'](?P<g>[^"':]+):(?P<n>[^"':]+)(?::(?P<v>[^"']+))?["']""")
_NAMED = re.compile(_CONF + r"""\s*\(?\s*group\s*[:=]\s*["'](?P<g>[^"']+)["']\s*,\s*name\s*[:=]\s*["'](?P<n>[^"']+)["'](?:\s*,\s*version\s*[:=]\s*["'](?P<v>[^"']+)["'])?""")
_PROJECT = re.compile(_CONF + r"""\s*\(?\s*project\s*\(\s*(?:path\s*[:=]\s*)?["'](?P<n>:[^"']+)["']""")
_LIBS = re.compile(_CONF + r"""\s*\(?\s*(?P<n>libs\.[A-Za-z0-9_.]+)""")


def gradle_rows(content: str) -> list[tuple[str, str, str | None, str, str | None, int]]:
    """kind, notation, group, name, version, line (from 1)."""
    out = []
    for start, body in _block_bodies(content, "dependencies"):
        for r in (_LITERAL, _NAMED, _PROJECT, _LIBS):
            for m in r.finditer(body):
                d = m.groupdict()
                out.append((d["kind"], m[0].strip(), d.get("g"), d["n"], d.get("v"), content.count("\n", 0, start + m.start()) + 1))
    return sorted(out, key=lambda x: (x[5], x[1]))


def catalog_rows(content: str) -> list[tuple[str, str, str, str | None]]:
    """alias, group, name, version of a version catalog."""
    try:
        t = tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        return []
    versions, out = t.get("versions") or {}, []
    for alias, v in (t.get("libraries") or {}).items():
        if isinstance(v, str):
            g, _, rest = v.partition(":")
            n, _, ver = rest.partition(":")
        else:
            g, n = v.get("group"), v.get("name")
            if v.get("module"):
                g, _, n = v["module"].partition(":")
            ver = v.get("version")
            if isinstance(ver, dict):
                ver = versions.get(ver.get("ref"), ver.get("strictly"))
        out.append((alias, g, n, ver or None))
    return out


def _parsed(files: DataFrame, parse, schema: str, names: list[str]) -> DataFrame:
    import pandas as pd

    def run(parts):
        for p in parts:
            rows = [(repo, *r) for repo, c in zip(p["repo"], p["content"]) for r in parse(c or "")]
            yield pd.DataFrame(rows, columns=["repo", *names])

    return files.select("repo", "content").mapInPandas(run, f"repo string, {schema}")


def cargo(files: DataFrame) -> DataFrame:
    return _parsed(files, cargo_rows, "name string, version string, language string", ["name", "version", "language"])


def gradle(files: DataFrame) -> DataFrame:
    names = ["kind", "notation", "grp", "name", "version", "line"]
    return _parsed(files, gradle_rows, "kind string, notation string, grp string, name string, version string, line int", names)


def version_catalog(files: DataFrame) -> DataFrame:
    return _parsed(files, catalog_rows, "alias string, grp string, name string, version string", ["alias", "grp", "name", "version"])


def gradle_dependencies(gradle_files: DataFrame, catalogs: DataFrame) -> DataFrame:
    """repo, name, version, language: catalog aliases (libs.a.b for a-b) replaced."""
    g, c = gradle(gradle_files), version_catalog(catalogs)
    alias = F.regexp_replace(F.regexp_replace("alias", "[-_]", "."), "^", "libs.")
    c = c.select(F.col("repo").alias("c_repo"), alias.alias("c_alias"), F.concat_ws(":", "grp", "name").alias("c_name"), F.col("version").alias("c_version"))
    rows = g.join(c, (g.repo == c.c_repo) & (g.name == c.c_alias), "left")
    name = F.coalesce("c_name", F.when(F.col("grp").isNotNull(), F.concat_ws(":", "grp", "name")).otherwise(F.col("name")))
    return rows.select("repo", name.alias("name"), F.coalesce("c_version", "version").alias("version"), F.lit("java").alias("language")).distinct()


def dependencies(files: DataFrame) -> DataFrame:
    """(repo, path, content) of manifests at repository roots -> all of them.
    pyproject.toml is known but yields nothing."""
    of = lambda *names: files.filter(F.col("path").isin(*names))
    out = requirements(of("requirements.txt", "Pipfile")).unionByName(cargo(of("Cargo.toml")))
    return out.unionByName(gradle_dependencies(of("build.gradle", "build.gradle.kts"), of("gradle/libs.versions.toml")))


SBOM = "components array<struct<type: string, name: string, version: string, purl: string>>"


def sbom_components(sboms: DataFrame) -> DataFrame:
    """(sbom_id, repo, commit, json) -> sbom_id, repo, commit, name, version, purl,
    component (its JSON); malformed documents give none."""
    parsed = F.from_json("json", SBOM)
    raw = F.from_json("json", "components array<string>")
    each = sboms.withColumn("p", parsed).withColumn("r", raw).select("sbom_id", "repo", "commit", F.posexplode("p.components").alias("i", "c"), F.col("r.components").alias("all"))
    return each.select("sbom_id", "repo", "commit", "c.name", "c.version", "c.purl", F.get("all", F.col("i")).alias("component"))


def sbom_blob(sboms: DataFrame) -> DataFrame:
    return sboms.withColumn("json", F.decode(F.unbase64("blob"), "UTF-8"))


def sbom_for_commit(deps: DataFrame, repo: str, commit: str | None) -> DataFrame:
    """Components of a repository at a commit, else those of no commit; by name."""
    rows = deps.filter(F.col("repo") == repo).filter(F.col("commit").isNull() | (F.col("commit") == F.lit(commit)) if commit else F.lit(True))
    best = rows.withColumn("fit", F.rank().over(Window.partitionBy("repo").orderBy(F.col("commit").isNull())))
    return best.filter("fit = 1").drop("fit").orderBy(F.lower("name"), "version")


def dependencies_for_branches(deps: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (repo, branch or null), deps (repo, branch, name, version): those of the
    first branch that has any of: asked, main, master, trunk; by name."""
    cand = asked.select("repo", F.posexplode(F.array("branch", F.lit("main"), F.lit("master"), F.lit("trunk"))).alias("p", "branch"))
    hits = deps.join(cand, ["repo", "branch"])
    return hits.withColumn("fit", F.dense_rank().over(Window.partitionBy("repo").orderBy("p"))).filter("fit = 1").select("repo", "branch", "name", "version").distinct().orderBy("repo", F.lower("name"))


def repository_dependencies(declared: DataFrame, components: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (repo, branch or null) -> repo, name, version, source, by name: what the
    repository declares on the first branch that has any of: asked, main, master,
    trunk; where none has, the components of its bill of materials, those of a
    commit before those of none."""
    own = dependencies_for_branches(declared, asked).select("repo", "name", "version", F.lit("manifest").alias("source"))
    rest = asked.select("repo").distinct().join(own.select("repo"), "repo", "left_anti")
    c = components.join(rest, "repo")
    first = Window.partitionBy("repo").orderBy(F.col("commit").isNull(), F.desc("commit"))
    bill = c.withColumn("fit", F.dense_rank().over(first)).filter("fit = 1").select("repo", "name", "version", F.lit("sbom").alias("source")).distinct()
    return own.unionByName(bill).orderBy("repo", F.lower("name"), "version")
