"""Exact token counts at every prefix of a text, by dynamic programming.

A token list is the byte-pair encoding of its bytes iff every two neighbours
encode to themselves.  So the encoding of a prefix ends with the one token t for
which the last token of the shorter prefix and t are such a pair, and
``count[i] = count[i - len(t)] + 1``; one pass over a pre-token gives the count
of each of its prefixes.  Counts of a text's prefixes add those of the pre-tokens
before.  Cutting a text changes its pre-tokens in two places only: a run of
spaces cut right behind its last character is one pre-token, and a contraction
cut short is two.

With the table, truncation to a budget and every other question about a prefix
are look-ups; nothing is encoded anew.  The table of a text is stored with it, as
the steps of its counts from one character to the next: a byte each (a step beyond
127 takes five).  It is put together from the tables of its pre-tokens, which are
cached, so it costs no more than the count.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pre-tokens in each of two generations of the cache, their bytes, cached prefixes and pairs
CACHE, CACHED_BYTES, PREFIXES, PAIRS = 300_000, 64, 900_000, 1_000_000
SENT_CHARS = 4 << 20  # characters whose tables a worker holds at most, but for one text's


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        """path: a byte-level BPE of the tokenizers library (vocabulary, merges,
        added tokens as special strings)."""
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        single = sorted(model["model"]["vocab"], key=model["model"]["vocab"].get)
        order = [raw(t) for t in single if len(t) == 1] + [raw(a + b) for a, b in merges]
        self.rank = {t: i for i, t in enumerate(order)}
        if len(self.rank) != len(order) or len([t for t in order if len(t) == 1]) != 256:
            raise ValueError("not a byte-level BPE with one merge a token")
        self.token = order
        self.longest = max(map(len, order))
        self.reach: dict[bytes, int] = {}  # last 3 bytes -> length of the longest token that ends so
        for t in order:
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        self.special = [t["content"] for t in model.get("added_tokens", ())]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").split
        self.find = regex.compile(PATTERN).findall
        base = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.rank, special_tokens={})
        self.merge = base._encode_single_piece
        self.pairs: dict[int, bool] = {}
        self.prefix: dict[bytes, int] = {}  # a pre-token's prefix -> count << 17 | last token
        self.known: dict[str, bytes] = {}  # pre-token -> the steps of its table
        self.old: dict[str, bytes] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 17 | b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return found

    def fill(self, b: bytes) -> list[int]:
        """The table's entries for the prefixes of b, (part of) one pre-token; makes
        those that aren't known.  Pre-tokens share the entries of prefixes."""
        table, pairs, rank, reach = self.prefix, self.pairs, self.rank, self.reach
        made: list[int] = []
        for end in range(1, len(b) + 1):
            now = table.get(b[:end])
            if now is None:
                far = reach.get(b[end - 3 : end], 2) if end > 2 else end
                for at in range(end - far if far < end else 0, end):
                    t = rank.get(b[at:end])
                    if t is not None:
                        if not at:
                            now = 1 << 17 | t
                            break
                        before = made[at - 1]
                        key = (before & 0x1FFFF) << 17 | t
                        fits = pairs.get(key)
                        if self.follows(key >> 17, t) if fits is None else fits:
                            now = ((before >> 17) + 1) << 17 | t
                            break
                table[b[:end]] = now
            made.append(now)
        return made

    def byte_counts(self, b: bytes) -> list[int]:
        """count[i]: tokens of b[:i]; the same table as an array, for long pre-tokens."""
        rank, pairs = self.rank, self.pairs
        last, count = [-1] * (len(b) + 1), [0] * (len(b) + 1)
        for end in range(1, len(b) + 1):
            for at in range(max(0, end - self.longest), end):
                t = rank.get(b[at:end])
                if t is not None:
                    fits = not at or pairs.get(last[at] << 17 | t)
                    if self.follows(last[at], t) if fits is None else fits:
                        last[end], count[end] = t, count[at] + 1
                        break
        return count

    def piece_counts(self, piece: str) -> list[int]:
        """count[j]: tokens of the first j characters of a pre-token, as a text's end."""
        b = piece.encode()
        count = self.byte_counts(b)
        if piece in ("'re", "'ve", "'ll"):
            return [0, 1, 2, count[-1]]
        return count if piece.isascii() else [count[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]

    def piece_steps(self, piece: str) -> bytes:
        """The table of a pre-token, as steps."""
        found = self.old.get(piece)
        if found is None:
            b = piece.encode()
            if len(b) > CACHED_BYTES or piece in ("'re", "'ve", "'ll"):
                found = encode_steps(np.diff(np.array(self.piece_counts(piece), np.int64)))
                if len(b) > CACHED_BYTES:
                    return found
            else:
                if len(self.prefix) >= PREFIXES:
                    self.prefix.clear()
                now = [x >> 17 for x in self.fill(b)]
                if len(b) != len(piece):
                    now = [now[e - 1] for e in accumulate(len(c.encode()) for c in piece)]
                # fewer than 64 tokens: a byte holds any step
                found = bytes([now[0], *[(y - x) & 255 for x, y in zip(now, now[1:])]])
        if len(self.known) >= CACHE:
            self.old, self.known = self.known, {}
        self.known[piece] = found
        return found

    def piece_total(self, piece: str) -> int:
        return int(decode_steps(self.known.get(piece) or self.piece_steps(piece)).sum())

    def stretch_table(self, pieces: list[str], spaced: bool) -> tuple[bytes, np.ndarray]:
        """(steps, counts from the empty prefix on) of a text without special strings.
        spaced: whether it may hold two spaces in a row."""
        parts = list(map(self.known.get, pieces))
        if None in parts:
            parts = [self.piece_steps(p) if c is None else c for p, c in zip(pieces, parts)]
        steps = b"".join(parts)
        counts = counts_of(steps)
        if spaced:
            # a run of spaces that look-ahead ended is one pre-token with its last
            # character where the text is cut behind that
            at, fixed = 0, False
            for p, after in zip(pieces, pieces[1:]):
                if p.isspace() and after[0].isspace():
                    counts[at + len(p) + 1] = counts[at] + self.piece_total(p + after[0])
                    fixed = True
                at += len(p)
            if fixed:
                steps = encode_steps(np.diff(counts))
        return steps, counts

    def table(self, text: str) -> tuple[bytes, np.ndarray]:
        """(steps, counts) of a text: counts[j] tokens are those of text[:j]."""
        parts = self.pieces(text)
        if len(parts) == 1:
            return self.stretch_table(parts[0], _SPACED(text) is not None)
        counts = np.array(self.prefix_counts(text), np.int64)
        return encode_steps(np.diff(counts)), counts

    def total(self, pieces: list[str]) -> int:
        """The last entries of the pre-tokens' tables, summed."""
        return int(self.stretch_table(pieces, False)[1][-1])

    def pieces(self, text: str) -> list[list[str]]:
        """The pre-tokens of each stretch between special strings."""
        if any(s in text for s in self.special):
            return [self.find(x) for x in self.split_special(text)]
        return [self.find(text)]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the table's last entry."""
        parts = self.pieces(text)
        return sum(map(self.total, parts)) + len(parts) - 1

    def prefix_counts(self, text: str) -> list[int]:
        """count[j]: tokens of text[:j], for every j."""
        stretches = self.split_special(text) if self.special else [text]
        seps = _found(self.special, text)
        out, base = [0], 0
        for k, x in enumerate(stretches):
            tail = seps[k][:-1] if k < len(seps) else ""
            part = [base]
            self._prefix_of_stretch(x + tail, part)
            whole = [base]
            self._prefix_of_stretch(x, whole)
            out.extend(whole[1:])
            if k < len(seps):
                out.extend(part[len(x) + 1 :])
                base = base + self.total(self.find(x)) + 1
                out.append(base)
        return out

    def _prefix_of_stretch(self, x: str, out: list[int]) -> None:
        base, at = out[0], 0
        spaces = None
        for p in self.find(x):
            counts = self.piece_counts(p)
            inner = [base + c for c in counts[1:]]
            if spaces is not None:
                inner[0] = spaces[1] + self.piece_counts(spaces[0] + p[0])[-1]
            out.extend(inner)
            # a run of spaces that look-ahead ended: its last character begins the next pre-token
            spaces = (p, base) if _ended_by_look_ahead(p, x, at + len(p)) else None
            base += counts[-1]
            at += len(p)

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return fitting(self.table(text)[1], budget)


_SPACED = re.compile(r"\s\s").search


def encode_steps(steps: np.ndarray) -> bytes:
    """A byte for each step from -127 to 127, else -128 and four bytes."""
    if not len(steps) or np.abs(steps).max() <= 127:
        return steps.astype(np.int8).tobytes()
    return b"".join(struct.pack("b", s) if -128 < s < 128 else b"\x80" + struct.pack("<i", s) for s in steps.tolist())


def decode_steps(b: bytes) -> np.ndarray:
    if b"\x80" not in b:
        return np.frombuffer(b, np.int8)
    out, at = [], 0
    while at < len(b):
        if b[at] == 0x80:
            out.append(struct.unpack_from("<i", b, at + 1)[0])
            at += 5
        else:
            out.append(struct.unpack_from("b", b, at)[0])
            at += 1
    return np.array(out, np.int64)


def counts_of(table: bytes) -> np.ndarray:
    """The count at every prefix, from the empty one on, of a stored table."""
    steps = decode_steps(table)
    counts = np.zeros(len(steps) + 1, np.int64)
    np.cumsum(steps, out=counts[1:])
    return counts


def fitting(counts: np.ndarray, budget: int) -> int:
    return int(np.flatnonzero(counts <= budget)[-1])


@F.pandas_udf(LongType())
def tokens_of_prefix(table: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` characters (of all, if there are fewer)."""
    return pd.Series([int(decode_steps(t)[: max(0, n)].sum()) for t, n in zip(table, chars)], dtype="int64")


@F.pandas_udf(LongType())
def chars_within(table: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return pd.Series([fitting(counts_of(t), max(0, n)) for t, n in zip(table, budget)], dtype="int64")


def _ended_by_look_ahead(p: str, x: str, end: int) -> bool:
    return p.isspace() and end < len(x) and x[end].isspace()


def _found(special: list[str], text: str) -> list[str]:
    import regex

    return regex.findall("|".join(map(regex.escape, special)), text) if special else []


@functools.lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_vocabulary() -> str:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, limit: int = 512, prefixes: bool = False, text: str = "text", path: str | None = None) -> DataFrame:
    """Columns of ``docs`` but the text, with n_bytes, n_tokens, over_limit,
    fitting_chars (characters of the longest prefix within the limit) and
    prefix_table binary, the stored table, which ``tokens_of_prefix`` and
    ``chars_within`` answer from; with ``prefixes`` also prefix_tokens array<int>,
    the count at every prefix from the empty one on.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows repeat; an empty
    table gives an empty one; columns named like the new ones are replaced.
    Row local: one scan, no shuffle; caches are bounded per worker.
    """
    vocabulary = path or default_vocabulary()
    new = [("n_bytes", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("over_limit", "boolean", pa.bool_()), ("fitting_chars", "long", pa.int64()), ("prefix_table", "binary", pa.binary())]
    if prefixes:
        new.append(("prefix_tokens", "array<int>", pa.list_(pa.int32())))
    names = [c for c in docs.columns if c != text and c not in {n for n, _, _ in new}]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{n} {t}" for n, t, _ in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)

        def packed(rows: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[k] for r in made], t) for k, (_, _, t) in enumerate(new)]
            return pa.RecordBatch.from_arrays([rows.column(n) for n in names] + arrays, names + [n for n, _, _ in new])

        for batch in batches:
            first, made, chars = 0, [], 0
            for i, x in enumerate(batch.column(text)):
                s = x.as_py() or ""
                steps, counts = c.table(s)
                n = int(counts[-1])
                made.append((len(s.encode()), n, n > limit, len(s) if n <= limit else fitting(counts, limit), steps, *([counts.astype(np.int32)] if prefixes else [])))
                chars += len(s)
                if chars >= SENT_CHARS:
                    yield packed(batch.slice(first, i + 1 - first), made)
                    first, made, chars = i + 1, [], 0
            if made:
                yield packed(batch.slice(first), made)

    return docs.mapInArrow(run, schema)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the table of every text; one row per document:
    null texts count as empty, null ids stay null, other columns are ignored."""
    return count_tokens(docs.select("doc_id", "text"))
