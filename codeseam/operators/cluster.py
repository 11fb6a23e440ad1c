"""Spherical k-means layers over (stable_id, repo, embedding), and retrieval.

Centres are k vectors (k is a parameter or the root of the row count), so they
go to tasks as literals; rows stay where they are, a round is one aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeseam.operators.graph import cut
from codeseam.operators.similarity import cosine_top_k


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    kind = rows.schema["stable_id"].dataType.simpleString()
    unit = _unit(centres)

    def run(parts):
        for p in parts:
            m = _unit(np.vstack(p["embedding"].to_list()).astype(np.float64)) if len(p) else np.zeros((0, centres.shape[1]))
            yield pd.DataFrame({"stable_id": p["stable_id"], "cluster": np.argmax(np.round(m @ unit.T, 12), axis=1).astype(np.int32)})

    return rows.select("stable_id", "embedding").mapInPandas(run, f"stable_id {kind}, cluster int")


def _moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres at the means of their members; an empty cluster keeps its own.  A
    task sends one sum a cluster it has members of, so k vectors a task move."""
    unit = _unit(centres)

    def run(parts):
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for p in parts:
            if len(p):
                m = np.vstack(p["embedding"].to_list()).astype(np.float64)
                at = np.argmax(np.round(_unit(m) @ unit.T, 12), axis=1)
                np.add.at(total, at, m)
                n += np.bincount(at, minlength=len(n))
        hit = np.flatnonzero(n)
        if len(hit):
            yield pd.DataFrame({"cluster": hit.astype(np.int32), "n": n[hit], "total": list(total[hit])})

    def added(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": p["cluster"].iloc[:1], "mean": [np.sum(p["total"].to_list(), axis=0) / p["n"].sum()]})

    sums = rows.select("embedding").mapInPandas(run, "cluster int, n long, total array<double>")
    out = centres.copy()
    for r in sums.groupBy("cluster").applyInPandas(added, "cluster int, mean array<double>").collect():  # k rows
        out[r.cluster] = r.mean
    return out


def kmeans(rows: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """stable_id, cluster: centres begin as the first k vectors by id; a round
    assigns by cosine (ties to the lower index), then moves each centre to the
    mean of its members; an empty cluster keeps its centre.  The assignment
    returned is the last round's, made before its centres moved."""
    rows = rows.filter("embedding IS NOT NULL AND size(embedding) > 0")
    centres = np.array([r.embedding for r in rows.orderBy("stable_id").limit(k).collect()], dtype=np.float64)
    if not len(centres):
        return rows.select("stable_id", F.lit(0).alias("cluster"))
    for _ in range(rounds - 1):
        centres = _moved(rows, centres)
    return _assigned(rows, centres)


def centroids(members: DataFrame, unit: bool = True) -> DataFrame:
    """cluster, centroid (the mean, of length 1), n_members, member_repos."""
    flat = members.select("cluster", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    c = flat.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    if unit:
        n = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
        c = c.withColumn("n", n).withColumn("centroid", F.when(F.col("n") > 0, F.transform("centroid", lambda x: x / F.col("n"))).otherwise(F.col("centroid"))).drop("n")
    about = members.groupBy("cluster").agg(F.count("*").alias("n_members"), F.sort_array(F.collect_set("repo")).alias("member_repos"))
    return c.join(about, "cluster")


def default_k(n: int, most: int = 4096) -> int:
    """The root of the row count, but no more than ``most``: k centres are what the
    driver and every task hold."""
    return min(n, most, max(2, round(math.sqrt(n)))) if n else 0


def first_layer(rows: DataFrame, k: int = 0, repo: str | None = None, summarise=lambda label: "") -> DataFrame:
    """layer 0: stable_id ('layer0::<c>' and the repository), label, members,
    centroid, member_repos, summary."""
    rows = rows if repo is None else rows.filter(F.col("repo") == repo)
    n = rows.count()
    return _layer(rows, kmeans(rows, min(k, n) or default_k(n)), 0, repo, summarise)


def _layer(rows: DataFrame, assigned: DataFrame, layer: int, repo: str | None, summarise) -> DataFrame:
    members = rows.join(assigned, "stable_id")
    lists = members.groupBy("cluster").agg(F.sort_array(F.collect_list(F.col("stable_id").cast("string"))).alias("members"))
    suffix = F.lit("" if repo is None else f"::repo::{repo}")
    name = F.concat(F.lit(f"layer{layer}::"), F.col("cluster").cast("string"), suffix)
    return centroids(members).join(lists, "cluster").select(
        F.lit(layer).alias("layer"), name.alias("stable_id"), F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("label"), "members", "centroid", "member_repos", F.lit(summarise("cluster")).alias("summary")
    )


def layers(rows: DataFrame, k: int = 0, min_clusters: int = 3, depth: int = 24, repo: str | None = None) -> DataFrame:
    """All layers: clusters of clusters, until there are fewer than
    ``min_clusters``, or as many clusters as members but one."""
    out = now = cut(first_layer(rows, k, repo))
    for layer in range(1, depth):
        below = now.select("stable_id", F.col("member_repos")[0].alias("repo"), F.col("centroid").alias("embedding"))
        n = below.count()
        parts = min(k, n) or default_k(n)
        if n < min_clusters or parts >= n - 1:
            break
        now = cut(_layer(below, kmeans(below, parts), layer, repo, lambda label: ""))
        out = out.unionByName(now)
    return out


def members_by_distance(members: DataFrame, centroid: list[float]) -> DataFrame:
    """stable_id, distance: nearest to the centroid first."""
    from codeseam.functions.vectors import cosine_distance

    c = F.array(*[F.lit(float(x)) for x in centroid])
    return members.select("stable_id", cosine_distance(F.col("embedding"), c).alias("distance")).orderBy("distance", "stable_id")


def cluster_relations(clusters: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """cluster, member, relation: has_member or has_member_cluster; with commits
    (stable_id, commit) also has_commit."""
    m = clusters.select(F.col("stable_id").alias("cluster"), F.explode("members").alias("member"))
    rel = m.withColumn("relation", F.when(F.col("member").startswith("layer"), "has_member_cluster").otherwise("has_member"))
    if commits is None:
        return rel
    c = m.join(commits.select(F.col("stable_id").cast("string").alias("member"), "commit"), "member").select("cluster", F.col("commit").alias("member"), F.lit("has_commit").alias("relation"))
    return rel.unionByName(c.distinct())


def cluster_snippets(clusters: DataFrame, rows: DataFrame, most: int = 20, look: int = 100) -> DataFrame:
    """cluster, snippets: texts of the members nearest to the centroid, up to
    ``most`` of them among the first ``look`` that have one.  rows: (stable_id,
    embedding, source_content)."""
    from codeseam.functions.vectors import cosine_distance

    m = clusters.select(F.col("stable_id").alias("cluster"), "centroid", F.explode("members").alias("member"))
    r = rows.select(F.col("stable_id").cast("string").alias("member"), "embedding", "source_content")
    near = m.join(r, "member").withColumn("distance", cosine_distance(F.col("embedding"), F.col("centroid")))
    rank = Window.partitionBy("cluster").orderBy("distance", "member")
    near = near.withColumn("nth", F.row_number().over(rank)).filter(F.col("nth") <= look).filter("source_content IS NOT NULL AND source_content <> ''")
    kept = near.withColumn("pick", F.row_number().over(Window.partitionBy("cluster").orderBy("nth"))).filter(F.col("pick") <= most)
    return kept.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "source_content"))), lambda s: s["source_content"]).alias("snippets"))


def retrieve(rows: DataFrame, clusters: DataFrame, query: list[float], k: int, repos: list[str] | None = None, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The k nearest rows (of the allowed repositories), and the clusters that
    have any of them as a member."""
    base = rows if repos is None else rows.filter(F.col("repo").isin(*repos))
    top = cosine_top_k(base, query, k, sample)
    ids = top.select(F.col("stable_id").cast("string").alias("member"))
    hit = clusters.select("*", F.explode("members").alias("member")).join(ids, "member", "left_semi").drop("member").dropDuplicates(["stable_id"])
    return top, hit
