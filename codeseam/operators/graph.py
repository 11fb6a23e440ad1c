"""Graph operators over an edge table (src, dst, kind, line)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeseam.sources.folders import mounted, written

WEIGHTS = {"call": 1.0, "import": 0.5, "containment": 0.25}


def neighbours(edges: DataFrame, node, limit: int | None = None) -> DataFrame:
    """relation (callers, callees, imports), other: of one node, each once, the
    first ``limit`` of each relation by id."""
    parts = [
        edges.filter((F.col("kind") == "call") & (F.col("dst") == node)).select(F.lit("callers").alias("relation"), F.col("src").alias("other")),
        edges.filter((F.col("kind") == "call") & (F.col("src") == node)).select(F.lit("callees").alias("relation"), F.col("dst").alias("other")),
        edges.filter((F.col("kind") == "import") & (F.col("src") == node)).select(F.lit("imports").alias("relation"), F.col("dst").alias("other")),
    ]
    out = reduce(DataFrame.unionByName, parts).distinct()
    if limit is None:
        return out
    w = Window.partitionBy("relation").orderBy("other")
    return out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def entity_graph(edges: DataFrame, entities: DataFrame, stable_id, limit: int = 50) -> DataFrame:
    """relation, stable_id, name; none for an unknown id."""
    return neighbours(edges, stable_id, limit).join(entities.select(F.col("stable_id").alias("other"), "name"), "other").select("relation", F.col("other").alias("stable_id"), "name")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder."""
    return written(df, "graph")


def reachable(edges: DataFrame, start, depth: int, forward: bool = True, kind: str | None = "call") -> DataFrame:
    """node, depth of all nodes within ``depth`` steps, the start excluded: a join
    and an anti join a level, only the frontier moves.  A frontier is written, so
    its size is known and beside a small one edges are scanned where they lie; edges
    may repeat."""
    if kind is not None:
        edges = edges.filter(F.col("kind") == kind)
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    kind_of = edges.schema["src"].dataType
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).cast(kind_of).alias("node"), F.lit(0).alias("depth"))
    frontier = seen.select("node")
    for d in range(1, depth + 1):
        frontier = cut(frontier.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
        if d < depth and frontier.isEmpty():
            break
    return seen.filter("depth > 0")


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node, id) of distinct nodes, ids from 0 without gaps, and how many."""
    raw = cut(nodes.select("node").distinct().withColumn("raw", F.monotonically_increasing_id()))
    part = F.shiftright("raw", 33)
    sizes = raw.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    at, rows = 0, []
    for r in sizes:  # one a task that wrote
        rows.append((r.part, at))
        at += r.n
    first = raw.sparkSession.createDataFrame(rows or [(0, 0)], "part long, first long")
    ids = raw.withColumn("part", part).join(F.broadcast(first), "part").select("node", (F.col("first") + F.col("raw").bitwiseAND((1 << 33) - 1)).alias("id"))
    return cut(ids), at


def _put(path: str, at: int, values: np.ndarray) -> None:
    """A stretch of a file that others write other stretches of."""
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(values.tobytes())


def _blank(path: str, size: int) -> None:
    with open(path, "wb") as f:
        f.truncate(size)


def _write_edges(out: DataFrame, folder: str, chunk: int) -> list[int]:
    """(src, dst, w), of numbered nodes, as files of flat arrays by the target's
    chunk (targets count from its start); returns the chunks there are."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag, made = uuid.uuid4().hex, set()
        for p in parts:
            for c, g in p.groupby("chunk"):
                made.add(int(c))
                for what, values in (("src", g["src"].to_numpy(np.int64)), ("dst", (g["dst"] - c * chunk).to_numpy(np.int32)), ("w", g["w"].to_numpy(np.float64))):
                    with open(f"{folder}/{c}.{what}.{tag}", "ab") as f:
                        f.write(values.tobytes())
        for c in made:
            for what in ("src", "dst", "w"):
                os.replace(f"{folder}/{c}.{what}.{tag}", f"{folder}/{c}.{what}")
        yield pd.DataFrame({"chunk": sorted(made)}, dtype="int64")

    spread = out.withColumn("chunk", F.floor(F.col("dst") / chunk).cast("long")).repartition("chunk")
    return [r.chunk for r in spread.mapInPandas(write, "chunk long").collect()]


def pagerank(edges: DataFrame, nodes: DataFrame, weights: dict[str, float] = WEIGHTS, damping: float = 0.85, iterations: int = 10, eps: float = 1e-6, chunk: int = 1 << 16) -> DataFrame:
    """node, rank: weighted, containment in both directions, the mass of nodes
    without out-edges spread over all; sums to 1.  nodes: (node).

    Nodes are numbered and edges laid in files of the shared folder (mounted on
    executors) by ``chunk`` targets, once.  A round maps the vector of ranks, eight
    bytes a node, and writes the next one: no shuffle, and no more than a million
    edges held by a task.
    """
    if damping < 0 or damping > 1:
        raise ValueError("damping lies in [0, 1]")
    w = F.lit(0.0)
    for k, x in weights.items():
        w = F.when(F.col("kind") == k, x).otherwise(w)
    ids, n = _numbered(nodes)
    if n == 0:
        return ids.select("node", F.lit(0.0).alias("rank"))
    if damping == 0 or iterations < 1:
        return ids.select("node", F.lit(1.0 / n).alias("rank"))
    spark = edges.sparkSession
    folder = mounted(spark, "pagerank")
    e = edges.select("src", "dst", "kind", w.alias("w"))
    e = e.union(e.filter("kind = 'containment'").select(F.col("dst"), F.col("src"), "kind", "w")).filter("w > 0")
    named = lambda x: ids.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id"))
    # ends that are no nodes (-1) take their share along, but have no rank of their own
    e = e.join(named("src"), "src").join(named("dst"), "dst", "left").select(F.col("src_id").alias("src"), F.coalesce("dst_id", F.lit(-1)).alias("dst"), "w")
    out = written(e, "pagerank-edges")
    there = set(_write_edges(out.filter("dst >= 0"), folder, chunk))
    chunks = -(-n // chunk)
    tasks = spark.range(0, chunks, 1, max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism)))

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for p in parts:
            for c, g in p.groupby("chunk"):
                held.setdefault(int(c), np.zeros(min(chunk, n - int(c) * chunk)))[g["src"].to_numpy() - int(c) * chunk] = g["w"]
        for c, values in held.items():
            _put(f"{folder}/total", 8 * c * chunk, values)
        yield pd.DataFrame({"done": [True]})

    # of each node what its out-edges weigh; none, none
    _blank(f"{folder}/total", 8 * n)
    by_chunk = out.groupBy("src").agg(F.sum("w").alias("w")).withColumn("chunk", F.floor(F.col("src") / chunk).cast("long")).repartition("chunk")
    by_chunk.mapInPandas(sums, "done boolean").write.format("noop").mode("overwrite").save()

    def step(i: int, dangling: float) -> tuple[float, float, float]:
        """Writes the ranks of round ``i`` (0: the first ones); their sum, that of
        nodes without out-edges, and how far they moved."""
        base = 1.0 / n if i == 0 else (1 - damping) / n + damping * dangling / n
        _blank(f"{folder}/rank{i}", 8 * n)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.memmap(f"{folder}/total", np.float64, "r")
            old = np.memmap(f"{folder}/rank{i - 1}", np.float64, "r") if i else None
            for p in parts:
                for c in p["id"]:
                    low, high = c * chunk, min((c + 1) * chunk, n)
                    got = np.zeros(high - low)
                    if i and c in there:
                        arrays = [np.memmap(f"{folder}/{c}.{x}", t, "r") for x, t in (("src", np.int64), ("dst", np.int32), ("w", np.float64))]
                        for s in range(0, len(arrays[0]), 1 << 20):
                            src, dst, weight = (a[s : s + (1 << 20)] for a in arrays)
                            got += np.bincount(dst, old[src] / total[src] * weight, high - low)
                    rank = base + damping * got
                    _put(f"{folder}/rank{i}", 8 * low, rank)
                    moved = float(np.abs(rank - old[low:high]).sum()) if i else 0.0
                    yield pd.DataFrame({"total": [rank.sum()], "dangling": [rank[total[low:high] == 0].sum()], "moved": [moved]})

        r = tasks.mapInPandas(run, "total double, dangling double, moved double").agg(F.sum("total"), F.sum("dangling"), F.sum("moved")).first()
        return r[0], r[1], r[2]

    total_rank, dangling, _ = step(0, 0.0)
    for i in range(1, iterations + 1):
        total_rank, dangling, moved = step(i, dangling)
        if i > 1:
            os.remove(f"{folder}/rank{i - 2}")
        if eps > 0 and moved <= eps:
            break
    last = f"{folder}/rank{i}"

    def ranks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.memmap(last, np.float64, "r")
        for p in parts:
            yield pd.DataFrame({"node": p["node"], "rank": rank[p["id"].to_numpy()] / total_rank})

    kind = nodes.schema["node"].dataType.simpleString()
    return ids.mapInPandas(ranks, f"node {kind}, rank double")


def rank_listing(entities: DataFrame, limit: int = 500, repo: str | None = None) -> DataFrame:
    rows = entities if repo is None else entities.filter(F.col("repo") == repo)
    return rows.withColumn("rank", F.coalesce("rank", F.lit(0.0))).orderBy(F.desc("rank"), "stable_id").limit(limit)
