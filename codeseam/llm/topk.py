"""Exact top-k inner product search, block at a time.

Vectors are quantised to integers, sorted by id and cut into document-range
blocks.  A block holds, for every dimension ("term"), its largest and smallest
component, and the components of its rows (its forward index).  For a query, the
sum over terms of the larger of q * max and q * min bounds every score in the
block; blocks are scored in the order of their bounds until one falls below the
k-th best score so far.

Blocks lie in files that workers map into memory, with their bounds in files of
their own.  A task is one group of queries against one segment of files, made by a
join of the two tables that tell of them.  It reads the bounds of the segment; a
block's forward index is read when a bound survives, and at most ``HELD`` bytes of
them are kept.  The best k of each segment are merged by a window of at most k rows
a segment.  Nothing is collected or broadcast.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeseam.llm.shared import materialise, shared_path, write_atomic

BLOCK, PER_FILE, QUERIES_A_GROUP, FILES_A_SEGMENT = 128, 1 << 14, 512, 64
HELD = 256 << 20  # bytes of forward indexes that a task keeps

ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    e = F.col(f"`{embedding}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(e.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & finite).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(e, lambda x: F.floor(scale * x.cast("double"))).alias("v")
    )


def _write(rows: DataFrame, folder: str, per_file: int, block: int, bounds: bool) -> DataFrame:
    """Rows sorted by (dimension, id) in files: an array of ids, one of components
    and, with ``bounds``, one of each block's largest and smallest; returns a table
    (file, d) of what was written: a row a file."""
    files = max(1, -(-rows.count() // per_file))
    spread = rows.withColumn("d", F.size("v")).repartitionByRange(files, "d", "id").sortWithinPartitions("d", "id")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        i, made = TaskContext.get().partitionId(), {}
        for p in parts:
            for d, g in p.groupby("d"):
                v = np.vstack(g["v"].to_list()).astype(np.int64) if d else np.zeros((len(g), 0), np.int64)
                made.setdefault(int(d), []).append((g["id"].to_numpy(np.int64), v))
        for d, chunks in made.items():
            v = np.ascontiguousarray(np.concatenate([v for _, v in chunks]))
            write_atomic(f"{folder}/{i}-{d}.v", v if d else b"")
            if bounds:
                starts = range(0, len(v), block)
                both = np.array([(v[s : s + block].max(axis=0), v[s : s + block].min(axis=0)) for s in starts]) if d else np.zeros((len(starts), 2, 0), np.int64)
                write_atomic(f"{folder}/{i}-{d}.bound", np.ascontiguousarray(both) if d else b"")
            write_atomic(f"{folder}/{i}-{d}.id", np.concatenate([x for x, _ in chunks]))
            yield pd.DataFrame({"file": [i], "d": [d]})

    return materialise(spread.mapInPandas(write, "file int, d int"), "topk-files")


class Stored:
    """What ``_write`` wrote of one file and dimension."""

    def __init__(self, folder: str, i: int, d: int, block: int) -> None:
        self.path, self.d, self.block = f"{folder}/{i}-{d}", d, block
        self.ids = np.memmap(f"{self.path}.id", dtype=np.int64, mode="r")
        empty = not d or not os.path.getsize(f"{self.path}.v")
        self.v = np.zeros((len(self.ids), 0), np.int64) if empty else np.memmap(f"{self.path}.v", dtype=np.int64, mode="r").reshape(-1, d)

    def blocks(self) -> int:
        return -(-len(self.ids) // self.block)

    def bounds(self) -> np.ndarray:
        """blocks x 2 x d: largest, smallest."""
        return np.fromfile(f"{self.path}.bound", np.int64).reshape(-1, 2, self.d) if self.d else np.zeros((self.blocks(), 2, 0), np.int64)


def search(query_ids: np.ndarray, queries: np.ndarray, files: list[Stored], k: int, held: int = HELD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best k (ids, scores), score descending, id ascending."""
    where = [(f, b) for f in files for b in range(f.blocks())]
    bounds = np.concatenate([f.bounds() for f in files])
    largest = int(np.abs(bounds).max(initial=0))
    exact = max(1, queries.shape[1]) * max(1, largest) * max(1, int(np.abs(queries).max(initial=0))) < 1 << 53
    kind = np.float64 if exact else np.int64  # doubles are exact here and run on BLAS
    high, low = bounds[:, 0].astype(kind), bounds[:, 1].astype(kind)
    forward: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    room = max(1, held // max(1, 8 * files[0].block * (queries.shape[1] + 1))) if files else 1

    def block(b: int) -> tuple[np.ndarray, np.ndarray]:
        found = forward.get(b)
        if found is None:
            f, nth = where[b]
            part = slice(nth * f.block, (nth + 1) * f.block)
            if len(forward) >= room:
                forward.pop(next(iter(forward)))
            found = forward[b] = np.array(f.ids[part]), np.array(f.v[part], dtype=kind)
        return found

    for s in range(0, len(query_ids), 64):
        some = queries[s : s + 64].astype(kind)
        every = np.maximum(some, 0) @ high.T + np.minimum(some, 0) @ low.T
        for q_id, q, bound in zip(query_ids[s : s + 64], some, every):
            best_s, best_i, kth = np.empty(0, kind), np.empty(0, np.int64), None
            for b in np.argsort(-bound, kind="stable"):
                if kth is not None and bound[b] < kth:
                    break
                ids, v = block(int(b))
                score = v @ q
                good = ids != q_id if kth is None else (score >= kth) & (ids != q_id)
                if good.any():
                    best_s, best_i = np.concatenate((best_s, score[good])), np.concatenate((best_i, ids[good]))
                    order = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[order], best_i[order]
                    kth = best_s[-1] if len(order) == k else None
            yield q_id, best_i, best_s.astype(np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 5, per_file: int = PER_FILE, queries_a_group: int = QUERIES_A_GROUP, files_a_segment: int = FILES_A_SEGMENT, block: int = BLOCK, held: int = HELD, **columns: str) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: for every vector for whose id
    ``is_query`` (a function of a column) holds, the k others of the same length
    with the highest integer inner product, ties to the smaller id.

    Null ids, null vectors and such with null or non-finite components take no
    part; rows with the query's own id are none of its results; equal rows of one
    query id are one query; other columns are ignored; an empty table gives an
    empty one; products that leave 64 bits wrap.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, **columns)
    asked = rows.filter(is_query(F.col("id"))).dropDuplicates(["id"])
    folder, q_folder = shared_path(spark, "vectors"), shared_path(spark, "queries")
    files = _write(rows, folder, per_file, block, True)
    groups = _write(asked, q_folder, queries_a_group, block, False).withColumnRenamed("file", "g")
    nth = F.row_number().over(Window.partitionBy("d").orderBy("file")) - 1  # rows are files
    segments = files.withColumn("s", F.floor(nth / files_a_segment)).groupBy("d", "s").agg(F.sort_array(F.collect_list("file")).alias("files"))
    tasks = materialise(groups.join(segments, "d"), "topk-tasks")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for g, d, names in zip(p["g"], p["d"], p["files"]):
                q = Stored(q_folder, g, d, block)
                segment = [Stored(folder, i, d, block) for i in names]
                for q_id, i, sc in search(np.asarray(q.ids), np.asarray(q.v), segment, k, held):
                    yield pd.DataFrame({"query_id": np.full(len(i), q_id), "vec_id": i, "score": sc})

    width = max(1, min(tasks.count(), 20_000))
    found = tasks.repartition(width, F.xxhash64("g", "d", "s")).mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(vectors: DataFrame) -> DataFrame:
    """The contract's columns: the five best of every fiftieth vector."""
    return top_k(vectors.select("vec_id", "embedding"), lambda i: i % 50 == 0)
