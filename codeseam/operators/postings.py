"""Posting lists made by segments of documents, as numpy sees them.

Texts are shuffled once, by their key, so equal keys lie together; a task cuts
its documents into segments of a few megabytes and sorts each segment's postings
on its own (a trigram is a number under 2 ** 16).  Postings never go through a
shuffle, and memory is bounded by a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_"
BASE = len(ALPHABET)
SEGMENT = 8 << 20
Postings = tuple[np.ndarray, np.ndarray, np.ndarray]


def _classes() -> np.ndarray:
    """Of every byte: 1 + its place in the alphabet, capitals as small letters; else 0."""
    out = np.zeros(256, np.uint8)
    for i, c in enumerate(ALPHABET):
        out[ord(c)] = out[ord(c.upper())] = i + 1
    return out


CLASSES = _classes()


def number(tri: str) -> int | None:
    """Of a trigram of the alphabet; null of any other string."""
    if len(tri) != 3 or any(c not in ALPHABET for c in tri):
        return None
    a, b, c = map(ALPHABET.index, tri)
    return (a * BASE + b) * BASE + c


def names() -> pa.Array:
    return pa.array([a + b + c for a in ALPHABET for b in ALPHABET for c in ALPHABET])


def by_key(docs: DataFrame, each: int = 32 << 20) -> DataFrame:
    """Rows with equal (repo, doc_id) next to each other, in parts by the size of
    what is scanned."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if size >= 1 << 60 else spark.sparkContext.defaultParallelism
    width = max(least, min(size // each, 1 << 16) if size < 1 << 60 else 1)
    return docs.repartition(width, "repo", "doc_id").sortWithinPartitions("repo", "doc_id")


def _new(column: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it (nulls are equal)."""
    if len(column) < 2:
        return np.ones(len(column), bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])


def _sizes(body: pa.Array) -> np.ndarray:
    """About how many bytes each row's text or list of strings has."""
    if pa.types.is_list(body.type) or pa.types.is_large_list(body.type):
        return pc.fill_null(pc.list_value_length(body), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 12
    return pc.fill_null(pc.binary_length(body), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows (repo, doc_id, body) of about ``most`` bytes, and each row's document
    (from 0); documents are never cut."""
    held, size = [], 0

    def cut(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        return rows, np.cumsum(_new(rows["repo"].combine_chunks()) | _new(rows["doc_id"].combine_chunks())) - 1

    for batch in batches:
        ends = np.cumsum(_sizes(batch.column(2)) + 16)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - done)
            at = to
            if size >= most:
                rows, doc = cut(pa.Table.from_batches(held).combine_chunks())
                last = int(np.searchsorted(doc, doc[-1]))
                if last:
                    yield rows.slice(0, last), doc[:last]
                rest = rows.slice(last)
                held = rest.to_batches()
                size = int((_sizes(rest["body"].combine_chunks()) + 16).sum())
    if held:
        yield cut(pa.Table.from_batches(held).combine_chunks())


def _sorted(code: np.ndarray, doc: np.ndarray, at: np.ndarray, repeated: bool) -> Postings:
    """In the order of (code, document, place); documents and places ascend but for
    documents of several rows."""
    order = np.lexsort((at, doc, code)) if repeated else np.argsort(code, kind="stable")
    return code[order], doc[order], at[order]


def trigram_postings(body: pa.Array, doc: np.ndarray, only: np.ndarray | None = None) -> Postings:
    """code, document and byte of every trigram of a column of texts, in this order."""
    body = pc.fill_null(body.cast(pa.large_string()), "")
    offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    raw = body.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if len(data) < 3:
        return np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0, np.int32)
    c = CLASSES[data]
    ok = (c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0)
    ends = offsets[1:]
    for back in (1, 2):  # those would reach into the next text
        e = ends - back
        ok[e[(e >= 0) & (e < len(ok))]] = False
    wide = c.astype(np.uint16) - np.uint16(1)
    code = wide[:-2] * np.uint16(BASE * BASE) + wide[1:-1] * np.uint16(BASE) + wide[2:]
    if only is not None:
        ok &= np.isin(code, only)
    at = np.flatnonzero(ok)
    row = np.repeat(np.arange(len(body), dtype=np.int32), np.diff(np.searchsorted(at, offsets)))
    return _sorted(code[at], doc.astype(np.int32)[row], (at - offsets[row]).astype(np.int32), len(doc) > 0 and doc[-1] + 1 < len(doc))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a value of any of the keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _ends(starts: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(starts, n).astype(np.int32))


def _keys(rows: pa.Table, doc: np.ndarray, which: np.ndarray) -> list[pa.Array]:
    first = pa.array(_starts(doc)[which])
    return [rows[c].combine_chunks().take(first) for c in ("repo", "doc_id")]


def _sliced(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _typed(docs: DataFrame) -> tuple[str, str]:
    return tuple(docs.schema[c].dataType.simpleString() for c in ("repo", "doc_id"))


def _mapped(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.mapInArrow(run, schema)


def flat_trigrams(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """tri, repo, doc_id, positions (bytes, ascending): a row a posting."""
    codes = None if only is None else np.array([n for t in only if (n := number(t)) is not None], np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = names()
        for rows, doc in segments(batches, SEGMENT // 4):
            code, of, at = trigram_postings(rows["body"].combine_chunks(), doc, codes)
            s = _starts(code, of)
            repo, doc_id = _keys(rows, doc, of[s])
            out = [vocabulary.take(pa.array(code[s])), repo, doc_id, pa.ListArray.from_arrays(_ends(s, len(code)), pa.array(at))]
            yield from _sliced(pa.RecordBatch.from_arrays(out, ["tri", "repo", "doc_id", "positions"]))

    repo, doc_id = _typed(docs)
    rows = by_key(docs.select("repo", "doc_id", F.col("content").alias("body")))
    return _mapped(rows, run, f"tri string, repo {repo}, doc_id {doc_id}, positions array<int>")


def _lists(rows: pa.Table, doc: np.ndarray, code: np.ndarray, of: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Of postings that begin at ``s``: each code's beginning among them, number of
    documents, the documents; and where the lists end."""
    k = _starts(code[s])
    ends = _ends(k, len(s))
    repo, doc_id = _keys(rows, doc, of[s])
    each = pa.StructArray.from_arrays([repo, doc_id], ["repo", "doc_id"])
    return k, pa.array(np.diff(np.append(k, len(s)))), pa.ListArray.from_arrays(ends, each), ends


def packed_trigrams(docs: DataFrame) -> DataFrame:
    """tri, n, docs (array of repo, doc_id), positions (an array a document): a row
    a trigram and segment, in the order of trigrams within a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = names()
        for rows, doc in segments(batches, SEGMENT):
            code, of, at = trigram_postings(rows["body"].combine_chunks(), doc)
            s = _starts(code, of)
            k, n, lists, ends = _lists(rows, doc, code, of, s)
            places = pa.ListArray.from_arrays(ends, pa.ListArray.from_arrays(_ends(s, len(code)), pa.array(at)))
            out = [vocabulary.take(pa.array(code[s][k])), n, lists, places]
            yield from _sliced(pa.RecordBatch.from_arrays(out, ["tri", "n", "docs", "positions"]), 1024)

    repo, doc_id = _typed(docs)
    rows = by_key(docs.select("repo", "doc_id", F.col("content").alias("body")))
    return _mapped(rows, run, f"tri string, n long, docs array<struct<repo:{repo},doc_id:{doc_id}>>, positions array<array<int>>")


def packed_terms(docs: DataFrame, tokens) -> DataFrame:
    """token, n, docs: likewise, of ``tokens`` (a function on the content) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, doc in segments(batches, SEGMENT):
            body = rows["body"].combine_chunks()
            words = body.flatten().dictionary_encode()
            row = pc.list_parent_indices(body).to_numpy(zero_copy_only=False)
            place = pc.sort_indices(words.dictionary).to_numpy()
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            code = rank[words.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)
            of = doc.astype(np.int64)[row]
            order = np.argsort(code * (int(doc[-1]) + 1) + of)
            code, of = code[order], of[order]
            s = _starts(code, of)
            k, n, lists, _ = _lists(rows, doc, code, of, s)
            out = [words.dictionary.take(pa.array(place)).take(pa.array(code[s][k])), n, lists]
            yield from _sliced(pa.RecordBatch.from_arrays(out, ["token", "n", "docs"]), 1024)

    repo, doc_id = _typed(docs)
    rows = by_key(docs.select("repo", "doc_id", "content")).select("repo", "doc_id", tokens(F.col("content")).alias("body"))
    return _mapped(rows, run, f"token string, n long, docs array<struct<repo:{repo},doc_id:{doc_id}>>")
