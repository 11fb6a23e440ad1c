"""Refs, commits, snapshots, patterns of branches and tags, the registry."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.plans.querylang import glob_to_regex, is_glob


def resolve_refs(asked: DataFrame, refs: DataFrame, commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """asked (repo, raw_ref) -> repo, raw_ref, ref_name, commit, snapshot_id.

    In order: the name as it is, under refs/heads/, under refs/tags/, then a
    commit of that id; without a name the branches main, master, trunk.
    """
    def tries(*cs: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("priority"), c.alias("name")) for i, c in enumerate(cs)])

    named = tries(F.col("raw_ref"), F.concat(F.lit("refs/heads/"), "raw_ref"), F.concat(F.lit("refs/tags/"), "raw_ref"))
    usual = tries(*[F.lit(f"refs/heads/{b}") for b in ("main", "master", "trunk")])
    cand = asked.select("repo", "raw_ref", F.explode(F.when(F.col("raw_ref").isNull(), usual).otherwise(named)).alias("c")).select("repo", "raw_ref", "c.*")
    by_ref = cand.join(refs.select("repo", "name", "target"), ["repo", "name"]).select("repo", "raw_ref", "priority", F.col("name").alias("ref_name"), F.col("target").alias("commit"))
    ids = commits.select("repo", F.col("id").alias("raw_ref"))
    by_id = asked.join(ids, ["repo", "raw_ref"]).select("repo", "raw_ref", F.lit(9).alias("priority"), F.lit(None).cast("string").alias("ref_name"), F.col("raw_ref").alias("commit"))
    best = by_ref.unionByName(by_id).groupBy("repo", "raw_ref").agg(F.min_by(F.struct("ref_name", "commit"), "priority").alias("b")).select(F.col("repo").alias("b_repo"), F.col("raw_ref").alias("r"), "b.*")
    out = asked.select("repo", "raw_ref").join(best, (F.col("repo") == F.col("b_repo")) & F.col("raw_ref").eqNullSafe(F.col("r")), "left").select("repo", "raw_ref", "ref_name", "commit")
    snap = snapshots.groupBy(F.col("repo").alias("s_repo"), F.col("commit").alias("s_commit")).agg(F.max("id").alias("snapshot_id"))
    return out.join(snap, (F.col("repo") == F.col("s_repo")) & (F.col("commit") == F.col("s_commit")), "left").drop("s_repo", "s_commit")


def _match(c: Column, p: str) -> Column:
    return c.rlike(glob_to_regex(p) if is_glob(p) else p)


def include_exclude(df: DataFrame, column: str, include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    """Excluding wins; no include pattern includes all.  A pattern with * ? [ is a
    glob on the whole name, else a regex anywhere in it."""
    c = F.col(column)
    if include:
        df = df.filter(reduce(or_, [_match(c, p) for p in include]))
    if exclude:
        df = df.filter(~reduce(or_, [_match(c, p) for p in exclude]))
    return df


def expand_branches(registered: DataFrame, refs: DataFrame) -> DataFrame:
    """(repo, pattern: comma list) -> repo, branch; globs among the repository's
    branches, plain names even if absent, blank is main; distinct."""
    p = registered.select("repo", F.explode(F.split(F.coalesce("pattern", F.lit("")), ",")).alias("p")).withColumn("p", F.trim("p"))
    p = p.withColumn("p", F.when((F.col("p") == ""), "main").otherwise(F.col("p")))
    glob = F.col("p").rlike(r"[*?\[]")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("p", r"([.+^$(){}|\\])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    hits = p.filter(glob).join(refs.select("repo", "branch"), "repo").filter(F.rlike("branch", F.concat(F.lit("^"), body, F.lit("$")))).select("repo", "branch")
    return p.filter(~glob).select("repo", F.col("p").alias("branch")).union(hits).distinct().orderBy("repo", "branch")


def top_tags(tags: DataFrame, limit: int = 200) -> DataFrame:
    """(repo, tag) -> repo, tag, position: versions first, newest first, a
    pre-release behind its release; then other names, descending; the first
    ``limit``, told in reverse."""
    m = lambda g: F.regexp_extract("tag", r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$", g)
    version = F.when(m(1) != "", F.struct(m(1).cast("decimal(38,0)"), m(2).cast("decimal(38,0)"), m(3).cast("decimal(38,0)"), (m(4) == "").alias("release"), _pre_release(m(4))))
    order = [F.desc_nulls_last(version), F.desc("tag")]
    first = tags.distinct().withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).filter(F.col("rn") <= limit)
    return first.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("rn")))).drop("rn")


def _pre_release(s: Column) -> Column:
    """Identifiers in order: numbers by value and below words."""
    return F.transform(F.split(s, r"\."), lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.when(x.rlike(r"^\d+$"), x.cast("decimal(38,0)")).alias("number"), x.alias("text")))


def choose_branches(branches: DataFrame, limit: int) -> DataFrame:
    """(repo, branch, is_head, time) -> the first ``limit``: HEAD, then the newest."""
    w = Window.partitionBy("repo").orderBy(F.desc("is_head"), F.desc("time"), "branch")
    return branches.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the last by ``order`` for each key; at a tie the new one."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")


def new_tags(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Tags of ``rows`` that don't exist yet; existing ones never move."""
    return rows.filter("kind = 'tag'").join(refs.select("repo", "name"), ["repo", "name"], "left_anti")


def unleased(registered: DataFrame, leases: DataFrame, now) -> DataFrame:
    """Registered (repo, branch) without a lease that runs beyond ``now``."""
    return registered.join(leases.filter(F.col("until") > now).select("repo", "branch"), ["repo", "branch"], "left_anti")


def index_status(registered: DataFrame, docs: DataFrame) -> DataFrame:
    """repo, indexed, n_docs of every registered repository."""
    counts = docs.groupBy("repo").agg(F.count("*").alias("n_docs"))
    return registered.select("repo").distinct().join(counts, "repo", "left").select("repo", F.col("n_docs").isNotNull().alias("indexed"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
