"""Entity and symbol search by name over (stable_id, name, kind, repo, path, rank, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(entities: DataFrame, query: str) -> DataFrame:
    """Entities of the name, in any case, or with a method of it (methods: an
    array<struct<name, start_line>> column, if there is one); each once, with the
    line of the method where that is what was found."""
    q = query.lower()
    own = entities.filter(F.lower("name") == q).withColumn("found", F.col("name")).withColumn("found_line", F.lit(None).cast("int"))
    if "methods" not in entities.columns:
        return own
    m = entities.withColumn("__m", F.explode("methods")).filter(F.lower("__m.name") == q)
    by_method = m.withColumn("found", F.lit(query)).withColumn("found_line", F.col("__m.start_line").cast("int")).drop("__m")
    return own.unionByName(by_method).dropDuplicates(["stable_id"])


def lexical(name: Column, query: str) -> Column:
    """1 equal, 0.8 begins, 0.5 holds, 0.3 - 0.1 * distance within two edits; else null."""
    n, q = F.lower(name), query.lower()
    d = F.levenshtein(n, F.lit(q), 2)
    return F.when(n == q, 1.0).when(n.startswith(q), 0.8).when(F.contains(n, F.lit(q)), 0.5).when(d >= 0, 0.3 - 0.1 * d)


def fuzzy_ranked(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """0.6 of the lexical score and 0.4 of the rank, scaled to [0, 1] over all
    entities (1 where all ranks are equal); files excluded; ties by id."""
    all_rows = entities.agg(F.min("rank").alias("__lo"), F.max("rank").alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    scaled = F.when(spread < 1e-9, 1.0).otherwise((F.col("rank") - F.col("__lo")) / F.nullif(spread, F.lit(0.0)))
    hits = entities.filter("kind <> 'file'").withColumn("lex", lexical(F.col("name"), query)).filter("lex IS NOT NULL")
    scored = hits.join(F.broadcast(all_rows)).withColumn("score", 0.6 * F.col("lex") + 0.4 * scaled)
    return scored.drop("__lo", "__hi", "lex").orderBy(F.desc("score"), "stable_id").limit(limit)


def contains(entities: DataFrame, query: str, repo: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    rows = entities.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    if repo is not None:
        rows = rows.filter(F.col("repo") == repo)
    return rows.orderBy("name", "stable_id").offset(offset).limit(limit)


def multi(entities: DataFrame, query: str, filters: list[str] | None = None, limit: int = 50, offset: int = 0, snapshot_id: str | None = None) -> DataFrame:
    """Name search over several repositories; a filter with '/' is a path prefix
    (the first one counts, and only if no repository is named); by rank."""
    rows = entities.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    repos = [f for f in filters or [] if "/" not in f]
    paths = [f for f in filters or [] if "/" in f]
    if repos:
        rows = rows.filter(F.col("repo").isin(*repos))
    elif paths:
        rows = rows.filter(F.col("path").startswith(paths[0]))
    if snapshot_id is not None:
        rows = rows.filter(F.col("snapshot_id") == snapshot_id)
    return rows.orderBy(F.desc_nulls_last("rank"), "stable_id").offset(offset).limit(limit)


def listing(entities: DataFrame, repo: str) -> DataFrame:
    w = Window.orderBy("path", "start_line", "stable_id")
    return entities.filter(F.col("repo") == repo).withColumn("position", F.row_number().over(w))


def repo_summaries(entities: DataFrame) -> DataFrame:
    """repo ('unknown' if null), entity_count, file_count, languages (sorted)."""
    return (
        entities.groupBy(F.coalesce("repo", F.lit("unknown")).alias("repo"))
        .agg(F.count("*").alias("entity_count"), F.countDistinct("path").alias("file_count"), F.sort_array(F.collect_set("lang")).alias("languages"))
        .orderBy(F.desc("entity_count"), "repo")
    )


__all__ = ["contains", "exact", "fuzzy_ranked", "lexical", "listing", "multi", "repo_summaries"]
