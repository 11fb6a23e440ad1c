"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encoding is a map from texts to token lists whose join is nearly concatenation:
``encode`` splits a text in halves down to leaves, and ``join`` merges two
neighbours by encoding anew only a window around the seam.

*Between pre-tokens.*  In the split pattern a space character can only begin a
match or lie in a run of spaces, so wherever a non-space is followed by a space
the full scan has a boundary, whatever surrounds it, and no look-ahead passes
it.  Pre-tokens are encoded separately, so tokens on either side of such a place
are those of the full text.  The window grows outward from the seam, doubling,
until it has such a place on both sides (or ends with the text).

*Within one long pre-token.*  A token list is the BPE encoding of its bytes iff
every two neighbours in it encode to themselves.  The window takes k tokens from
either side of the seam; where its encoding starts with the left one's k-th last
token and ends with the right one's k-th, all neighbouring pairs outside and at
its edges are pairs of encodings already, hence everything outside is stable.
Else k doubles.

Decoding maps ids to bytes and concatenates up the tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 256, 128, 1 << 14
SENT_CHARS = 1 << 20  # characters whose results a worker holds at most, but for one text's


class TreeCodec:
    """ranks: token bytes -> id; pattern: the pre-token split."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import tiktoken

        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern).findall
        # a non-space before a space
        self.begins, self.begin = regex.compile(r"\S(?=\s)").finditer, regex.compile(r"\S(?=\s)").search
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = self.base._encode_single_piece

    # one pre-token
    def piece(self, b: bytes) -> list[int]:
        if len(b) <= LEAF_BYTES:
            return self.single(b)
        mid = len(b) // 2
        return self.join_pieces(self.piece(b[:mid]), self.piece(b[mid:]))

    def join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            a, z = left[-k:], right[:k]
            window = b"".join(map(self.bytes.__getitem__, a + z))
            new = self.single(window)
            fits_left = k >= len(left) or new[0] == a[0]
            fits_right = k >= len(right) or new[-1] == z[-1]
            if fits_left and fits_right:
                return left[: max(0, len(left) - k)] + new + right[k:]
            k *= 2

    # whole texts
    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.base.encode_ordinary(text)
        mid = len(text) // 2
        return self.join(text, mid, self.encode(text[:mid]), self.encode(text[mid:]))

    def join(self, text: str, seam: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the whole from those of the halves.  Both boundaries are token
        boundaries of a half, so the bytes up to the seam tell which tokens go."""
        first, last = self.boundary_before(text, seam), self.boundary_after(text, seam)
        size = self.bytes
        keep, over = len(left), len(text[first:seam].encode())
        while over:
            keep -= 1
            over -= len(size[left[keep]])
        skip, over = 0, len(text[seam:last].encode())
        while over:
            over -= len(size[right[skip]])
            skip += 1
        left[keep:] = self.window(text[first:last])
        left += right[skip:]
        return left

    def window(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.base.encode_ordinary(text)
        return [i for p in self.find(text) for i in self.piece(p.encode())]

    def boundary_before(self, text: str, seam: int) -> int:
        """The last place before the seam with a non-space before and a space after, or 0."""
        reach = 32
        while True:
            start = max(0, seam - reach)
            found = [m.start() + 1 for m in self.begins(text, start, seam)]
            if found:
                return found[-1]
            if not start:
                return 0
            reach *= 2

    def boundary_after(self, text: str, seam: int) -> int:
        found = self.begin(text, seam)
        return found.start() + 1 if found else len(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> TreeCodec:
    """One codec a worker; ``path`` names a rank file (base64 token, rank)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeCodec(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def _mapped(docs: DataFrame, text: str, out: list[tuple[str, str, pa.DataType]], path: str, pattern: str, row: Callable) -> DataFrame:
    """The columns of docs but the text, then ``out`` = (name, Spark type, Arrow
    type): what row(codec, text) returns.  Arrow batches, a text at a time."""
    names = [c for c in docs.columns if c != text and c not in {n for n, _, _ in out}]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{n} {t}" for n, t, _ in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)

        def packed(rows: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([m[k] for m in made], t) for k, (_, _, t) in enumerate(out)]
            return pa.RecordBatch.from_arrays([rows.column(n) for n in names] + arrays, names + [n for n, _, _ in out])

        for batch in batches:
            first, made, chars = 0, [], 0
            for i, x in enumerate(batch.column(text)):
                t = x.as_py() or ""
                made.append(row(c, t))
                chars += len(t)
                if chars >= SENT_CHARS:  # ids are larger than their text: send them on early
                    yield packed(batch.slice(first, i + 1 - first), made)
                    first, made, chars = i + 1, [], 0
            if made:
                yield packed(batch.slice(first), made)

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns of ``docs`` but the text, with ids array<int>, n_tokens long and
    decoded binary, the ids decoded again.  Null and empty texts have no ids;
    repeated rows repeat; an empty table gives an empty one.  Columns of the
    input named like the new ones are replaced."""
    own = default_vocabulary()

    def row(c: TreeCodec, x: str) -> tuple:
        ids = c.encode(x)
        return np.array(ids, np.int32), len(ids), c.decode(ids)

    out = [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "long", pa.int64()), ("decoded", "binary", pa.binary())]
    return _mapped(docs, text, out, path or own[0], pattern or own[1], row)


def op3(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, one row per document; null texts count as
    empty (no ids, the digests of nothing), null ids stay null.  The digests are
    made where the ids are, so neither ids nor bytes leave the worker."""

    def row(c: TreeCodec, x: str) -> tuple:
        ids = c.encode(x)
        said = str(ids)[1:-1].replace(" ", "")
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    out = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs.select("doc_id", F.col("text")), "text", out, *default_vocabulary(), row)
