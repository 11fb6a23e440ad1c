"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made from the XXH64 of 3-word shingles.  Distinct fingerprints
are sorted by their population counts, that of the whole word first, then those
of its halves, quarters and bytes, and cut into tiles.  Two words within r bits
differ by r or less in population count, and the same holds for the sum over the
parts of the word; so a tile pair whose ranges of counts lie further apart is
skipped.  All others are compared exactly, word against word, by numpy
exclusive-or and bit counts.

Tiles lie in files in the shared folder, which workers map into memory, with the
ranges of their counts.  Tasks first compare ranges of files (15 pairs of numbers a
file) and name the file pairs that may hold a link; only those become work, a
task reading 2 x 256 KB: nothing is broadcast or sent to the driver.  Links found
in a pair of files are reduced to a spanning forest before they leave the task; a
group of copies costs as many rows as it has members, never its pairs.  The work is quadratic in distinct fingerprints, less
what is skipped, as the method is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.llm.components import components, local_labels
from codeseam.llm.shared import fresh_names, materialise, shared_path, write_atomic

RADIUS, SHINGLE, SEED = 3, 3, 42
TILE, FILE = 1024, 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII spaces only
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with fp, the fingerprint as a signed
    long.  Null and empty texts have 0.  Row local."""
    names = [c for c in docs.columns if c not in (text, "fp")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py() or "") for x in batch.column(text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(fp)], [*names, "fp"])

    return docs.mapInArrow(run, schema)


def _counts_key(fp: Column) -> Column:
    """Population counts of the word, its halves, quarters and bytes in one long;
    a part's second half follows from the first."""
    part = lambda shift, bits: F.bit_count(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1)))
    key = F.bit_count(fp).cast("long")
    for shift, bits in [(32, 32), (48, 16), (16, 16), (56, 8), (40, 8), (24, 8), (8, 8)]:
        key = key * 64 + part(shift, bits).cast("long")
    return key


def part_counts(words: np.ndarray) -> np.ndarray:
    """Population counts of the word, 2 halves, 4 quarters and 8 bytes: n x 15."""
    b = np.bitwise_count(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)).astype(np.int16)
    q = b.reshape(-1, 4, 2).sum(axis=2)
    h = q.reshape(-1, 2, 2).sum(axis=2)
    return np.concatenate((h.sum(axis=1, keepdims=True), h, q, b), axis=1)


LEVELS = ((0, 1), (1, 3), (3, 7), (7, 15))


def tile_ranges(words: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Least and largest part counts of each tile: tiles x 2 x 15."""
    counts = [part_counts(words[i : i + tile]) for i in range(0, len(words), tile)]
    return np.array([(c.min(axis=0), c.max(axis=0)) for c in counts], np.int16).reshape(-1, 2, 15)


def write_files(fps: DataFrame, folder: str, per_file: int) -> int:
    """Distinct fingerprints (fp), sorted by counts, in files of about ``per_file``,
    with the ranges of their tiles; returns the number of files."""
    n = fps.count()
    files = max(1, -(-n // per_file))
    spread = fps.select("fp", _counts_key(F.col("fp")).alias("k")).repartitionByRange(files, "k", "fp").sortWithinPartitions("k", "fp")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words = [p["fp"].to_numpy(np.int64) for p in parts]
        if words:
            i, w = TaskContext.get().partitionId(), np.concatenate(words).view(np.uint64)
            write_atomic(f"{folder}/{i}.u64", w)
            write_atomic(f"{folder}/{i}.range", tile_ranges(w))
            yield pd.DataFrame({"file": [i]})

    written = spread.select("fp").mapInPandas(write, "file int")
    return max((r.file for r in written.collect()), default=-1) + 1  # a row a file


def _mapped(folder: str, i: int) -> np.ndarray:
    import os

    path = f"{folder}/{i}.u64"
    return np.memmap(path, dtype=np.uint64, mode="r") if os.path.exists(path) else np.empty(0, np.uint64)


def _ranges(folder: str, i: int) -> np.ndarray:
    import os

    path = f"{folder}/{i}.range"
    return np.fromfile(path, np.int16).reshape(-1, 2, 15) if os.path.exists(path) else np.empty((0, 2, 15), np.int16)


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Least distance the counts allow between tile a and each of tiles b."""
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    return np.max([gap[:, s:e].sum(axis=1) for s, e in LEVELS], axis=0)


def compare_files(a: np.ndarray, b: np.ndarray, same: bool, radius: int, tile: int = TILE, ranges: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within and between a and b (within a, if
    they are the same): index pairs, b's behind a's.  ranges: their tiles' ones."""
    found_a, found_b = [], []
    ra, rb = ranges or (tile_ranges(a, tile), tile_ranges(b, tile))
    low_a, high_a, low_b, high_b = ra[:, 0], ra[:, 1], rb[:, 0], rb[:, 1]
    shift = 0 if same else len(a)
    for i in range(len(low_a)):
        near = np.flatnonzero(_apart(low_a[i], high_a[i], low_b, high_b) <= radius)
        x = np.ascontiguousarray(a[i * tile : (i + 1) * tile])
        for j in near[near >= i] if same else near:
            y = np.ascontiguousarray(b[j * tile : (j + 1) * tile])
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            r, c = r + i * tile, c + j * tile + shift
            keep = r != c
            if keep.any():
                nodes, at = np.unique(np.concatenate((r[keep], c[keep])), return_inverse=True)
                label = local_labels(len(nodes), at[: keep.sum()], at[keep.sum() :])
                moved = label != np.arange(len(nodes))
                found_a.append(nodes[moved])
                found_b.append(nodes[label[moved]])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = np.concatenate(found_a), np.concatenate(found_b)
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = local_labels(len(nodes), at[: len(u)], at[len(u) :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


STRIP = 1024  # files whose ranges a row of the first step compares with one


def near_files(spark: SparkSession, folder: str, files: int, radius: int) -> DataFrame:
    """(i, j), i <= j: the file pairs that hold tiles within ``radius`` by their counts."""
    strips = -(-files // STRIP)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}

        def whole(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in held:
                if len(held) >= 4 * STRIP:
                    held.clear()
                r = _ranges(folder, i)
                held[i] = (r[:, 0].min(axis=0), r[:, 1].max(axis=0)) if len(r) else (np.full(15, 99, np.int16), np.full(15, -99, np.int16))
            return held[i]

        for p in parts:
            for x in p["id"]:
                i, s = int(x) // strips, int(x) % strips
                js = np.arange(max(i, s * STRIP), min(files, (s + 1) * STRIP))
                if not len(js) or not len(_ranges(folder, i)):
                    continue
                low, high = (np.array(v) for v in zip(*(whole(int(j)) for j in js)))
                near = js[(low[:, 0] <= high[:, 0]) & (_apart(*whole(i), low, high) <= radius)]
                r = _ranges(folder, i)
                for j in near:
                    o = _ranges(folder, int(j))
                    if any((_apart(t[0], t[1], o[:, 0], o[:, 1]) <= radius).any() for t in r):
                        yield pd.DataFrame({"i": [i], "j": [int(j)]})

    return spark.range(0, files * strips, 1, max(1, min(files * strips, 2000))).mapInPandas(run, "i int, j int")


def near_links(fps: DataFrame, radius: int = RADIUS, per_file: int = FILE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what pairs
    within ``radius`` bits connect."""
    spark = fps.sparkSession
    folder = shared_path(spark, "simhash")
    files = write_files(fps, folder, per_file)
    pairs = materialise(near_files(spark, folder, files, radius), "near-files")
    width = max(1, min(pairs.count(), 20000))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i, j in zip(p["i"], p["j"]):
                a, b = _mapped(folder, i), _mapped(folder, j)
                u, v = compare_files(a, b, i == j, radius, ranges=(_ranges(folder, i), _ranges(folder, j)))
                words = a if i == j else np.concatenate((a, b))
                yield pd.DataFrame({"a": words[u].view(np.int64), "b": words[v].view(np.int64)})

    # a pair is a row, and a task by its hash: near pairs lie side by side otherwise
    return pairs.repartition(width, F.xxhash64("i", "j")).mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id", per_file: int = FILE) -> DataFrame:
    """The columns of ``docs`` but the text, with fp and component_id: the
    smallest id reachable by links between fingerprints within ``radius`` bits.

    Equal fingerprints are linked (so are all null and empty texts, of
    fingerprint 0); null ids count only where a component has no other; repeated
    rows repeat; an empty table gives an empty one.
    """
    return labelled(docs, radius, text, doc_id, per_file).drop("__label")


def labelled(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id", per_file: int = FILE, label: str = "__label") -> DataFrame:
    """near_duplicates with ``label``, a fingerprint that names the component: ids
    may be null or repeated, it tells components apart all the same."""
    rows = materialise(fingerprints(docs, text), "fingerprints")
    each = materialise(rows.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("least")), "distinct-fingerprints")
    labels = materialise(components(materialise(near_links(each.select("fp"), radius, per_file), "near-links")), "labels")
    known = each.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = known.join(least, "label").select("fp", "component_id", F.col("label").alias(label))
    kept = [c for c in rows.columns if c not in ("component_id", label)]
    return rows.select(*[F.col(f"`{c}`") for c in kept]).join(by_fp, "fp").select(*[F.col(f"`{c}`") for c in kept], "component_id", label)


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document; null texts count as empty
    (fingerprint 0), null ids only where a component has no other."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, of
    those with that id (or, where all are null, with none) the one whose text has
    the smallest hash; rows of the same id and text are copies and go, too.  Null
    and empty texts are one group; an empty table gives an empty one; columns of
    any name stay as they are."""
    none, key_id, h, g, label = fresh_names(docs, "none", "id", "h", "g", "label")
    key = {none: F.col("doc_id").isNull(), key_id: F.coalesce("doc_id", F.lit(0)), h: F.xxhash64("text"), g: F.xxhash64(F.lit(1), "text")}
    rows = labelled(docs.select("doc_id", "text", key[h].alias(h), key[g].alias(g)), label=label, **options).filter("doc_id <=> component_id")
    first = rows.groupBy(label).agg(F.min(F.struct(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(key_id), h, g)).alias("k"))
    # join and deduplication go by one key, so the texts are shuffled once
    return docs.withColumns(key).join(first.select("k.*"), list(key), "left_semi").dropDuplicates(list(key)).drop(*key)
