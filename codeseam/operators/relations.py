"""Entities, files, commits and snapshots as keyed tables, and what relates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions.text import clean_json_text, normalise_git_url, owner_of, stable_id
from codeseam.sources.sinks import merge_table, read_table, table_exists

#: table -> its key
KEYS = {
    "repo": ["repo"],
    "commit": ["repo", "commit"],
    "file": ["file_id"],
    "entity": ["stable_id"],
    "snapshot": ["snapshot_id", "stable_id"],
    "relation": ["relation", "src", "dst"],
    "dependency": ["repo", "branch", "name", "version"],
    "sbom": ["sbom_id"],
    "sbom_component": ["sbom_id", "name", "version", "purl"],
}


def relational_tables(entities: DataFrame, edges: DataFrame, files: DataFrame, meta: DataFrame, ranks: DataFrame | None = None, project: str = "") -> dict[str, DataFrame]:
    """meta: (repo, url, branch, commit), a row a repository; ranks: (node, rank).

    An entity's id is a hash of project, repository, branch, commit, path (in the
    repository), name and signature, so it is the same on every run.  A method is
    an entity, too, related to its class.  A snapshot is an entity at a commit,
    with its rank and source text.  Call and import edges are those resolved over
    the whole repository, not within a batch.
    """
    m = meta.select("repo", "branch", "commit")
    e = entities.join(m, "repo", "left")
    sid = stable_id(F.lit(project), F.col("repo"), F.col("branch"), F.col("commit"), F.col("path"), F.col("name"), F.col("signature"))
    e = e.withColumn("stable_id", sid)
    file_id = F.sha2(F.concat_ws(":", "repo", "path"), 256)
    cols = ["stable_id", "repo", "path", "lang", "kind", "name", "parent", "signature", "start_line", "end_line", "doc"]
    own = e.select(*cols[:8], (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), clean_json_text(F.col("doc")).alias("doc"))
    each = e.select(F.col("stable_id").alias("of"), "repo", "path", "lang", F.col("name").alias("parent"), "branch", "commit", F.explode("methods").alias("m"))
    each = each.withColumn("stable_id", F.sha2(F.concat_ws("|", "of", "m.signature", F.col("m.start_line").cast("string")), 256))
    methods = each.select("stable_id", "repo", "path", "lang", F.lit("method").alias("kind"), "m.name", "parent", "m.signature", (F.col("m.start_line") + 1).alias("start_line"), (F.col("m.end_line") + 1).alias("end_line"), F.lit(None).cast("string").alias("doc"))
    entity = own.unionByName(methods).dropDuplicates(["stable_id"])

    rank = ranks if ranks is not None else e.select(F.col("id").alias("node"), F.lit(None).cast("double").alias("rank")).limit(0)
    text = files.select("repo", "path", F.split("content", "\n", -1).alias("ls"))
    body = lambda a, b: F.array_join(F.slice("ls", a + 1, F.greatest(b - a + 1, F.lit(0))), "\n")
    snap = e.join(rank.withColumnRenamed("node", "id"), "id", "left").join(text, ["repo", "path"], "left")
    snap_id = F.concat_ws("@", "repo", "commit").alias("snapshot_id")
    snapshot = snap.select(
        snap_id, "stable_id", "repo", "commit", "path", "kind", "name", (F.col("start_line") + 1).alias("start_line"), F.coalesce("rank", F.lit(0.0)).alias("rank"),
        F.when(F.col("kind") != "file", body(F.col("start_line"), F.col("end_line"))).alias("source_content"),
    ).dropDuplicates(["snapshot_id", "stable_id"])

    ids = e.select(F.col("id").alias("n"), "stable_id")
    src, dst = (ids.select(F.col("n").alias(c), F.col("stable_id").alias(f"{c}_id")) for c in ("src", "dst"))
    name = F.when(F.col("kind") == "call", "calls").when(F.col("kind") == "import", "imports").otherwise("contains")
    graph = edges.join(src, "src").join(dst, "dst").select(name.alias("relation"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    link = lambda rows, kind, a, b: rows.select(F.lit(kind).alias("relation"), a.alias("src"), b.alias("dst"))
    commit_key = F.concat_ws("@", "repo", "commit")
    relation = graph
    for rows, kind, a, b in (
        (e, "in_file", F.col("stable_id"), file_id),
        (e, "has_snapshot", F.col("stable_id"), F.concat_ws("#", commit_key, "stable_id")),
        (e, "snapshot_file", F.concat_ws("#", commit_key, "stable_id"), file_id),
        (e, "snapshot_commit", F.concat_ws("#", commit_key, "stable_id"), commit_key),
        (each, "has_method", F.col("of"), F.col("stable_id")),
        (e.select("repo", "path").distinct(), "file_repo", file_id, F.col("repo")),
        (m, "commit_repo", commit_key, F.col("repo")),
    ):
        relation = relation.unionByName(link(rows, kind, a, b))
    url = F.col("url")
    return {
        "repo": meta.select("repo", normalise_git_url(url).alias("url"), owner_of(url).alias("owner"), "branch"),
        "commit": meta.select("repo", "commit", "branch").filter("commit IS NOT NULL"),
        "file": entities.filter("kind = 'file'").select(file_id.alias("file_id"), "repo", "path", "lang"),
        "entity": entity,
        "snapshot": snapshot,
        "relation": relation.dropDuplicates(["relation", "src", "dst"]),
    }


def persist(spark: SparkSession, root: str, tables: dict[str, DataFrame], at) -> None:
    """Merges every table into its folder below ``root``, the rows written at ``at``
    (a timestamp) in place of earlier ones of their keys."""
    for name, rows in tables.items():
        merge_table(spark, f"{root}/{name}", rows.withColumn("written_at", F.lit(at).cast("timestamp")), KEYS[name], "written_at")


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{root}/{name}") for name in KEYS if table_exists(spark, f"{root}/{name}")}


def upsert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Content rows: those of new keys are put in as 'pending', those there keep
    their status and get the new text; NUL becomes a blank."""
    clean = rows.withColumn("content", clean_json_text(F.col("content")))
    old = table.select(*key, "status")
    new = clean.drop("status").join(old, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return table.join(clean.select(*key), key, "left_anti").unionByName(new.select(table.columns))


def fetch_snapshot(snapshots: DataFrame, stable_ids: list, start: int = 0, limit: int | None = None) -> DataFrame:
    """The snapshots of the ids, with ``limit`` characters of their source from
    ``start`` on, its whole length, and whether there is more; an id without one
    is a row, too, not found."""
    spark = snapshots.sparkSession
    asked = spark.createDataFrame([(x,) for x in stable_ids], f"stable_id {snapshots.schema['stable_id'].dataType.simpleString()}")
    text = F.coalesce("source_content", F.lit(""))
    cut = text if limit is None else F.substring(text, start + 1, limit)
    cut = F.substring(text, F.lit(start + 1), F.length(text)) if limit is None and start else cut
    more = F.lit(False) if limit is None else F.length(text) > start + limit
    last = snapshots.groupBy("stable_id").agg(F.max_by(F.struct("repo", "path", "start_line", "source_content"), "snapshot_id").alias("s"))
    rows = asked.join(last, "stable_id", "left").select("stable_id", F.col("s").isNotNull().alias("found"), "s.*")
    return rows.select("stable_id", "found", "repo", "path", "start_line", cut.alias("source_content"), F.length(text).alias("n_chars"), more.alias("has_more"))


def sbom_tables(sboms: DataFrame) -> dict[str, DataFrame]:
    """(repo, commit, json, at) -> sbom (one a repository and commit, the latest),
    its components, and relations: commit has_sbom, sbom has_component."""
    from codeseam.operators.deps import sbom_components

    one = sboms.groupBy("repo", "commit").agg(F.max_by("json", "at").alias("json"))
    one = one.withColumn("sbom_id", F.sha2(F.concat_ws("@", "repo", F.coalesce("commit", F.lit(""))), 256))
    comp = sbom_components(one.select("sbom_id", "repo", "commit", "json")).withColumn("version", F.coalesce("version", F.lit(""))).withColumn("purl", F.coalesce("purl", F.lit("")))
    comp = comp.filter("name IS NOT NULL").dropDuplicates(["sbom_id", "name", "version", "purl"])
    has = one.filter("commit IS NOT NULL").select(F.lit("has_sbom").alias("relation"), F.concat_ws("@", "repo", "commit").alias("src"), F.col("sbom_id").alias("dst"))
    parts = comp.select(F.lit("has_component").alias("relation"), F.col("sbom_id").alias("src"), F.concat_ws("@", "name", "version").alias("dst"))
    blob = F.base64(F.col("json").cast("binary")).alias("blob")
    return {"sbom": one.select("sbom_id", "repo", "commit", blob), "sbom_component": comp, "relation": has.unionByName(parts).distinct()}


def dependency_tables(files: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """Declared dependencies of repositories' manifests, and repo depends_on them."""
    from codeseam.operators.deps import dependencies

    d = dependencies(files).join(meta.select("repo", "branch"), "repo").withColumn("version", F.coalesce("version", F.lit("")))
    d = d.select("repo", "branch", "name", "version", "language").dropDuplicates(["repo", "branch", "name", "version"])
    return {"dependency": d, "relation": d.select(F.lit("depends_on").alias("relation"), F.col("repo").alias("src"), F.concat_ws("@", "name", "version").alias("dst")).distinct()}
