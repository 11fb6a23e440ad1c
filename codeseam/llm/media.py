"""Media columns as content-defined chunks.

A payload (here a WAV file of 8-bit samples) is cut where a rolling gear hash of
its last 32 bytes has zeros in its top bits, so equal stretches of different
payloads give equal chunks.  Chunk digests are deduplicated by Spark joins; each
distinct chunk is stored once, in compressed blocks of pack files in the shared
folder; a payload is its ordered chunk list.  Reading joins the list with the
places of the chunks, reads the packs and verifies every chunk's digest.

Only digests, lengths and places are shuffled, never payloads.  Which chunks a
task must store comes to it as sorted arrays of the chunks that others store
(memory-mapped, by a hash of the digest and the place), so the second pass needs
no join with payloads.  Chunks repeated in thousands of payloads are one row each
after a partial aggregation.  Files are named by content or attempt and listed in
tables that Spark commits, so a lost executor's work is simply done again.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeseam.llm.shared import materialise, shared_path, shuffle_width, write_atomic

UNIT = 64
LEAST, MEAN_BITS, MOST = 512, 12, 32 << 10
BLOCK_BYTES = 256 << 10
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of 64."""
    b = (text or "").encode()
    return b + bytes(-len(b) % UNIT if b else UNIT)


def wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples at 8 kHz: a lossless container."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def samples(media: bytes) -> bytes:
    """The sample bytes of such a container."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    n = struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + n]


def feature_of(payload: bytes) -> str:
    """Peak, mean absolute level, zero crossings and a 16-bin histogram of samples."""
    a = np.frombuffer(payload, np.uint8)
    level = a.astype(np.int16) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    bins = np.bincount(a >> 4, minlength=16)
    return f"{int(np.abs(level).max())},{int(np.abs(level).sum(dtype=np.int64)) * 1000 // len(a)},{crossings}," + "-".join(map(str, bins))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks.  hash[i] = sum of gear[byte i - j] << j over j < 32, as
    the rolling gear hash in 32 bits is; five doublings make it for all i."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = int(marks[i]) if i < len(marks) and marks[i] <= at + MOST else min(n, at + MOST)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[s:e] for s, e in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


KEY = ["none", "id", "h"]


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """none (no id), id and h (of the text) tell rows apart."""
    t, i = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`").cast("long")
    return docs.select(i.isNull().alias("none"), F.coalesce(i, F.lit(0)).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))


def chunk_lists(rows: DataFrame) -> DataFrame:
    """(none, id, h, t) -> none, id, h, seq, digest, length and n_bytes of the text: a row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seqs, digests, lengths, sizes = [], [], [], [], []
            for i, x in enumerate(batch.column("t")):
                t = x.as_py()
                n = len(t.encode())
                for k, c in enumerate(chunks(wav(payload_of(t)))):
                    at.append(i)
                    seqs.append(k)
                    digests.append(digest(c))
                    lengths.append(len(c))
                    sizes.append(n)
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in KEY]
            made = [pa.array(seqs, pa.int32()), pa.array(digests, pa.binary()), pa.array(lengths, pa.int32()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(keys + made, [*KEY, "seq", "digest", "length", "n_bytes"])

    return rows.mapInArrow(run, "none boolean, id long, h long, seq int, digest binary, length int, n_bytes long")


def _places(none: np.ndarray, key: np.ndarray, h: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a chunk's place."""
    x = (key.astype(np.uint64) + none.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0x9E3779B97F4A7C15) ^ h.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x += seq.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def write_others(repeats: DataFrame, folder: str, parts: int) -> None:
    """The places (none, id, h, seq) of chunks that are stored elsewhere, as sorted arrays."""

    def write(p: pd.DataFrame) -> pd.DataFrame:
        part = int(p["h"].iloc[0] % parts)
        write_atomic(f"{folder}/{part}.u64", np.sort(_places(*(p[c].to_numpy().astype(np.int64) for c in (*KEY, "seq")))))
        return pd.DataFrame({"part": [part]})

    repeats.groupBy(F.pmod("h", F.lit(parts))).applyInPandas(write, "part long").write.format("noop").mode("overwrite").save()


class Packs:
    """Reads chunks by place; keeps the last blocks it decompressed."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.folder, self.blocks, self.open = folder, {}, zstandard.ZstdDecompressor().decompress

    def get(self, pack: str, block: int, size: int, at: int, length: int) -> bytes:
        raw = self.blocks.get((pack, block))
        if raw is None:
            with open(f"{self.folder}/{pack}", "rb") as f:
                f.seek(block)
                raw = self.open(f.read(size))
            if len(self.blocks) >= 64:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[pack, block] = raw
        return raw[at : at + length]


def store(rows: DataFrame, folder: str, others: str, parts: int) -> DataFrame:
    """Writes the chunks that are not others' to pack files; returns digest, pack,
    block (offset), size (of the block), at (in the block).  A chunk whose place
    hashes like a repeated one's would be missed; ``write_media`` looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        name = f"{uuid.uuid4().hex}.pack"
        known: dict[int, np.ndarray] = {}

        def stored_elsewhere(none: bool, key: int, h: int, n: int) -> np.ndarray:
            part = h % parts
            if part not in known:
                path = f"{others}/{part}.u64"
                known[part] = np.memmap(path, np.uint64, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, np.uint64)
            a = known[part]
            if not len(a):
                return np.zeros(n, bool)
            places = _places(np.full(n, none), np.full(n, key, np.int64), np.full(n, h, np.int64), np.arange(n))
            return a[np.minimum(np.searchsorted(a, places), len(a) - 1)] == places

        with open(f"{folder}/{name}", "wb") as pack:
            held, rows_held, fill, offset = [], [], 0, 0

            def flush() -> pa.RecordBatch:
                nonlocal held, rows_held, fill, offset
                b = squeeze(b"".join(held))
                pack.write(b)
                n = len(rows_held)
                out = pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in rows_held], pa.binary()), pa.array([name] * n), pa.array([offset] * n, pa.int64()), pa.array([len(b)] * n, pa.int32()), pa.array([a for _, a in rows_held], pa.int32())],
                    ["digest", "pack", "block", "size", "at"],
                )
                offset += len(b)
                held, rows_held, fill = [], [], 0
                return out

            for batch in batches:
                for none, key, h, t in zip(*(batch.column(c).to_pylist() for c in KEY), batch.column("t")):
                    made = chunks(wav(payload_of(t.as_py())))
                    for c, other in zip(made, stored_elsewhere(none, key, h, len(made))):
                        if not other:
                            rows_held.append((digest(c), fill))
                            held.append(c)
                            fill += len(c)
                            if fill >= BLOCK_BYTES:
                                yield flush()
            if held:
                yield flush()
            pack.flush()
            os.fsync(pack.fileno())

    return rows.mapInArrow(run, "digest binary, pack string, block long, size int, at int")


def write_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, str]:
    """Stores every row's media.  Returns the table of payloads (none, id, h, n_bytes,
    n), the table of their chunks (none, id, h, seq, digest, length, pack, block,
    size, at), and the folder of the packs.

    Rows equal in id and text are one stored media, counted n.  Null and empty
    texts are the same payload, 64 zero bytes; other columns are ignored; an
    empty table stores nothing.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, text, doc_id)
    every = materialise(chunk_lists(rows), "media-lists")
    keys = every.filter("seq = 0").groupBy(*KEY).agg(F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    listed = every.select(*KEY, "seq", "digest", "length").dropDuplicates([*KEY, "seq"])
    # the owner of a digest stores it; partial aggregation keeps hot chunks small
    owners = listed.groupBy("digest").agg(F.min(F.struct(*KEY, "seq")).alias("own"))
    repeats = listed.join(owners, "digest").filter(F.struct(*KEY, "seq") != F.col("own")).select(*KEY, "seq")
    parts = shuffle_width(docs)
    others, folder = shared_path(spark, "media-others"), shared_path(spark, "media-packs")
    write_others(repeats, others, parts)
    placed = materialise(store(rows, folder, others, parts).dropDuplicates(["digest"]), "media-places")
    missed = owners.join(placed, "digest", "left_anti").limit(1).count()
    if missed:
        raise RuntimeError("a chunk was not stored")
    return keys, listed.join(placed, "digest"), folder


def read_media(keys: DataFrame, listed: DataFrame, folder: str, row, schema: str, width: int | None = None) -> DataFrame:
    """doc_id, n_bytes (of the text) and what row(media bytes) gives, one row for every row stored; each
    media is put together from its chunks, whose digests are verified.  width: tasks
    that read, by the size of what they read, not of the lists that tell of it."""
    ordered = listed.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "length", "pack", "block", "size", "at"))).alias("list"))
    ordered = ordered.withColumn("first", F.struct(F.col("list")[0]["pack"].alias("pack"), F.col("list")[0]["block"].alias("block")))
    # near places are read together, so that a block is decompressed about once
    place = F.xxhash64("first.pack", F.floor(F.col("first.block") / (2 << 20)))
    doc_id = F.when(~F.col("none"), F.col("id")).alias("doc_id")
    ordered = ordered.join(keys, KEY)
    ordered = (ordered.repartition(width, place) if width else ordered.repartition(place)).sortWithinPartitions("first").select(doc_id, "n_bytes", "n", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Packs(folder)
        for batch in batches:
            copies = batch.column("n").to_pylist()
            out = []
            for n_bytes, listed_chunks in zip(batch.column("n_bytes").to_pylist(), batch.column("list")):
                found = []
                for c in listed_chunks.as_py():
                    b = packs.get(c["pack"], c["block"], c["size"], c["at"], c["length"])
                    if digest(b) != c["digest"]:
                        raise ValueError(f"chunk {c['digest'].hex()} is damaged")
                    found.append(b)
                out.append((n_bytes, *row(b"".join(found))))
            arrays = [pa.array([o[k] for o in out], kinds[t]) for k, (_, t) in enumerate(columns)]
            again = pa.array(np.repeat(np.arange(len(out)), copies))
            yield pa.RecordBatch.from_arrays([a.take(again) for a in [batch.column("doc_id"), *arrays]], ["doc_id", *[n for n, _ in columns]])

    columns = [tuple(x.split()) for x in f"n_bytes long, {schema}".split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return ordered.mapInArrow(run, f"doc_id long, n_bytes long, {schema}")


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the media as read back, one row per document;
    null ids stay null, null texts count as empty, repeated rows repeat."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(media: bytes) -> tuple:
        p = samples(media)
        return len(p), sha(p), zlib.crc32(p[-UNIT:]), len(media), sha(media), feature_of(p)

    docs = docs.select("doc_id", "text")
    keys, listed, folder = write_media(docs)
    return read_media(keys, listed, folder, row, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", shuffle_width(docs))
