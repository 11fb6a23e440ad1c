"""Vector search and similarity edges over (stable_id, repo, embedding).

Similarity joins are exact.  Vectors are written once, in blocks, to the shared
folder (mounted on executors); a task takes some sources through all blocks of
candidates, by matrix products, and keeps each source's best k.  Products in
single precision, whose error is bounded, tell which pairs can be among them;
those are computed in double.  Neither vectors nor pairs go through a shuffle, k
rows a source do.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeseam.functions.vectors import cosine, norm
from codeseam.sources.folders import mounted, written


def cosine_top_k(candidates: DataFrame, query: list[float], k: int, sample: int | None = None) -> DataFrame:
    """The k nearest by cosine, ties by id; vectors of another length or without
    a norm are skipped; an empty or zero query finds none.  ``sample``: only the
    first so many by id."""
    rows = candidates if sample is None else candidates.orderBy("stable_id").limit(sample)
    q = F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")
    return rows.withColumn("score", cosine(F.col("embedding"), q)).filter("score IS NOT NULL").orderBy(F.desc("score"), "stable_id").limit(k)


def _write_blocks(snapshots: DataFrame, folder: str, rows_a_block: int) -> DataFrame:
    """Unit vectors in the order of (length, repo, id), in files of about
    ``rows_a_block``; returns (file, d, n, low, high): a row a file and length, with
    its number of vectors and the repositories it begins and ends with."""
    e = F.col("embedding").cast("array<double>")
    rows = snapshots.filter("embedding IS NOT NULL AND size(embedding) > 0").select("stable_id", F.coalesce(F.col("repo").cast("string"), F.lit("")).alias("repo"), e.alias("v"), F.size("embedding").alias("d"))
    n = norm(F.col("v"))
    rows = rows.filter((n > 0) & (n < float("inf")))
    files = max(1, -(-rows.count() // rows_a_block))
    spread = rows.repartitionByRange(files, "d", "repo", "stable_id").sortWithinPartitions("d", "repo", "stable_id")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        i, held = TaskContext.get().partitionId(), {}
        for p in parts:
            for d, g in p.groupby("d"):
                held.setdefault(int(d), []).append(g)
        for d, gs in held.items():
            g = pd.concat(gs, ignore_index=True)
            m = np.vstack(g["v"].to_list()).astype(np.float64)
            m /= np.linalg.norm(m, axis=1)[:, None]
            repos = g["repo"].to_numpy(object)
            runs = np.append(np.flatnonzero(np.append(True, repos[1:] != repos[:-1])), len(repos))
            for what, a in (("m", m), ("s", m.astype(np.float32)), ("id", g["stable_id"].to_numpy()), ("repo", repos[runs[:-1]]), ("run", runs)):
                tmp = f"{folder}/{i}-{d}.{what}.{uuid.uuid4().hex}"
                with open(tmp, "wb") as f:
                    np.save(f, a, allow_pickle=True)
                os.replace(tmp, f"{folder}/{i}-{d}.{what}")
            yield pd.DataFrame({"file": [i], "d": [d], "n": [len(g)], "low": [g["repo"].iloc[0]], "high": [g["repo"].iloc[-1]]})

    return written(spread.mapInPandas(write, "file int, d int, n int, low string, high string"), "similar-blocks")


def _best(row: np.ndarray, score: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """Which of (row, score, to) are their row's best k, in order; ties go to the
    smaller id."""
    order = np.lexsort((np.unique(to, return_inverse=True)[1], -score, row))
    sorted_rows = row[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def _nearest(read, i: int, start: int, stop: int, others, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, score): the best k of each source start .. stop - 1 of a file in
    the other files.  ``read(file, what)`` gives their arrays."""
    m, m32, ids = read(i, "m")[start:stop], read(i, "s")[start:stop], read(i, "id")[start:stop]
    names, runs = read(i, "repo"), read(i, "run")
    error = (m.shape[1] + 16) * 2.0**-23  # a single-precision product of unit vectors, twice over
    least = np.full(len(m), -np.inf)  # of each source the k-th best score, once it has k
    row, score, to = np.zeros(0, np.int64), np.zeros(0), ids[:0]
    first = int(np.searchsorted(runs, start, "right")) - 1
    for o in others:
        n, n32, cand = read(o, "m"), read(o, "s"), read(o, "id")
        at, cuts = {r: j for j, r in enumerate(read(o, "repo"))}, read(o, "run")
        twins = int(np.unique(cand, return_counts=True)[1].max())
        rows, scores, tos = [row], [score], [to]
        for j in range(first, len(names)):
            low, high = max(int(runs[j]) - start, 0), min(int(runs[j + 1]) - start, len(m))
            if low >= high:
                break
            lo, hi = (int(cuts[at[names[j]]]), int(cuts[at[names[j]] + 1])) if names[j] in at else (0, 0)
            for c, e in ((lo, hi),) if same else ((0, lo), (hi, len(cand))):
                if c >= e:
                    continue
                s = m32[low:high] @ n32[c:e].T
                bound = least[low:high] - error
                if e - c > k + twins and np.isinf(bound).any():
                    # at least k others than the source itself are as near as that
                    place = e - c - k - twins
                    bound = np.maximum(bound, np.partition(s, place, axis=1)[:, place] - 2 * error)
                # rounding down keeps the bound one
                r, x = np.divmod(np.flatnonzero(s >= np.nextafter(bound.astype(np.float32), np.float32(-np.inf))[:, None]), e - c)
                r, x = r + low, x + c
                keep = ids[r] != cand[x]
                r, x = r[keep], x[keep]
                rows.append(r)
                tos.append(cand[x])
                scores += [np.round(np.einsum("ij,ij->i", m[r[z : z + 65536]], n[x[z : z + 65536]]), 12) for z in range(0, len(r), 65536)]
        row, score, to = np.concatenate(rows), np.concatenate(scores), np.concatenate(tos)
        best = _best(row, score, to, k)
        row, score, to = row[best], score[best], to[best]
        held = np.bincount(row, minlength=len(m))
        full = held >= k
        least[full] = score[np.cumsum(held)[full] - 1]
    return ids[row], to, score


def similar_edges(snapshots: DataFrame, scope: str = "same", max_edges: int | None = None, threshold: float | None = None, min_store: float = 0.0, rows_a_block: int = 4096, rows_a_task: int = 1024) -> DataFrame:
    """src, dst, score, scope: of every source its ``max_edges`` nearest (10 in the
    same repository, 25 in others), and of those the ones of the threshold (0.85,
    0.90); an edge found from both ends is stored once, smaller id first.

    Vectors lie in files by repository; a task takes ``rows_a_task`` vectors of one
    through the others.  Within repositories these are files that share one; across
    them all are, but for one that holds the same repository only.
    """
    same = scope == "same"
    k = max_edges if max_edges is not None else 10 if same else 25
    least = threshold if threshold is not None else 0.85 if same else 0.90
    folder = mounted(snapshots.sparkSession, "similar")
    blocks = _write_blocks(snapshots, folder, rows_a_block)
    other = blocks.select(F.col("file").alias("o"), "d", F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    touching = (F.col("low") <= F.col("o_high")) & (F.col("o_low") <= F.col("high"))
    one = (F.col("low") == F.col("high")) & (F.col("o_low") == F.col("o_high")) & (F.col("low") == F.col("o_low"))
    pairs = blocks.join(other, "d").filter(touching if same else ~one).groupBy("file", "d", "n").agg(F.sort_array(F.collect_list("o")).alias("others"))
    tasks = written(pairs.select("file", "d", "n", "others", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(rows_a_task))).alias("start")), "similar-tasks")
    width = max(1, min(tasks.count(), 20_000))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i, d, rows, others, start in zip(p["file"], p["d"], p["n"], p["others"], p["start"]):

                def read(file: int, what: str, d: int = d) -> np.ndarray:
                    return np.load(f"{folder}/{file}-{d}.{what}", **({"mmap_mode": "r"} if what in "ms" else {"allow_pickle": True}))

                src, dst, score = _nearest(read, i, start, min(start + rows_a_task, rows), others, same, k)
                yield pd.DataFrame({"src": src, "dst": dst, "score": score})

    kind = snapshots.schema["stable_id"].dataType.simpleString()
    near = tasks.repartition(width).mapInPandas(run, f"src {kind}, dst {kind}, score double")
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    kept = near.withColumn("rn", F.row_number().over(w)).filter((F.col("rn") <= k) & ~((F.col("score") < least) & (F.col("score") >= min_store)))
    return kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "score", F.lit(scope).alias("scope")).dropDuplicates(["src", "dst"])


def similar_of(edges: DataFrame, entities: DataFrame, stable_id, limit: int = 10) -> DataFrame:
    """scope, stable_id, name, score of an entity's similar ones, best first."""
    e = edges.filter((F.col("src") == stable_id) | (F.col("dst") == stable_id))
    other = F.when(F.col("src") == stable_id, F.col("dst")).otherwise(F.col("src"))
    w = Window.partitionBy("scope").orderBy(F.desc("score"), "stable_id")
    rows = e.select("scope", other.alias("stable_id"), "score").join(entities.select("stable_id", "name"), "stable_id")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def duplicate_pairs(edges: DataFrame, entities: DataFrame, repo, external: bool = False, min_score: float | None = None, language: str | None = None, kind: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """a, b, score: both in the repository, or a in it and b elsewhere.  Filters,
    then order (score, ids), then one page."""
    cols = ["stable_id", "repo", *[c for c in ("lang", "kind") if c in entities.columns]]
    a = entities.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = entities.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    e = edges.select("src", "dst", "score")
    if external:
        # both directions of a row that is made once
        both = [F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "score") for x, y in (("src", "dst"), ("dst", "src"))]
        e = e.select(F.inline(F.array(*both)))
    rows = e.join(a, F.col("src") == F.col("a_stable_id")).join(b, F.col("dst") == F.col("b_stable_id"))
    rows = rows.filter((F.col("a_repo") == repo) & ((F.col("b_repo") != repo) if external else (F.col("b_repo") == repo)))
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    for value, c in ((language, "lang"), (kind, "kind")):
        if value is not None:
            rows = rows.filter((F.lower(f"a_{c}") == value.lower()) & (F.lower(f"b_{c}") == value.lower()))
    out = rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), "score").orderBy(F.desc("score"), "a", "b")
    return out if limit is None else out.offset(offset).limit(limit)


def chunk_windows(payloads: DataFrame, limit: int = 8192, overlap: int = 256) -> DataFrame:
    """stable_id, chunk (from 0), words of windows of ``limit`` blank-separated
    words, each ``max(limit - overlap, 1)`` further; the last reaches the end."""
    step = max(limit - overlap, 1)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.size("w")
    count = F.when(n <= limit, 1).otherwise(F.ceil((n - limit) / step).cast("int") + 1)
    at = F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("w", i * step + 1, limit)))
    return payloads.select("stable_id", words.alias("w")).select("stable_id", at.alias("chunk", "words"))


def chunk_mean(chunks: DataFrame) -> DataFrame:
    """(stable_id, chunk, embedding) -> the mean of the chunks that have one of the
    first such chunk's length, how many they are, and whether any is missing."""
    some = chunks.filter("embedding IS NOT NULL AND size(embedding) > 0")
    first = Window.partitionBy("stable_id").orderBy("chunk")
    some = some.withColumn("len", F.first(F.size("embedding")).over(first)).filter(F.size("embedding") == F.col("len"))
    flat = some.select("stable_id", "chunk", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = flat.groupBy("stable_id", "i").agg(F.avg("x").alias("x")).groupBy("stable_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    used = some.groupBy("stable_id").agg(F.count("*").alias("n_used"))
    return chunks.groupBy("stable_id").agg(F.count("*").alias("n_chunks")).join(used, "stable_id", "left").join(means, "stable_id", "left").select("stable_id", "embedding", F.coalesce("n_used", F.lit(0)).alias("n_used"), (F.coalesce("n_used", F.lit(0)) < F.col("n_chunks")).alias("partial"))
