"""An interpolated modified Kneser-Ney model of order 3, counted in Spark, stored as
sorted hash arrays that workers map into memory to score texts.

Counting.  Workers hash words (64 bits, vectorised over the text buffer) and
count them a task at a time; partial counts travel as packed columns, a row for
each part of the hash range, and each part's reducer writes one sorted array.  A
word's number is its place in these arrays.  Trigrams (u, v, w) are then counted
likewise, in parts by v; a word v that occurs more than ``HOT`` times is salted by
u.  A part's reducer writes its trigrams and their contexts (u, v), with what the
contexts' trigrams sum to, and sends on in how many trigrams each pair (v, w)
ends: the pair's continuation count, which goes to the part where (v, w) is a
context.  From the pairs come, by word number, the same sums of each context v and
the continuation count of each word.  Pairs at a text's start have no word before
them and count as often as they occur.

Scoring.  A task maps the arrays into memory; look-ups are sorted searches of a
few million bytes of text at a time.  Nothing but totals and a row a part reaches
the driver; nothing is broadcast.  Parts are as many as the input's size asks for.

Words are told apart by 64-bit hashes: of n distinct ones, some two count as one
with a chance of about n * n / 3.7e19 (for words as they come; the hash is no
secret, so words can be made that collide).  Pairs and trigrams are counted exactly
by their words' numbers, but found in the arrays by their part and 40 bits and more
of a hash: of the about 500,000 of a part, some two have the same with a chance of
about 2e-6.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeseam.llm.shared import fold, shared_path, shuffle_width, write_atomic

CHUNK = 2 << 20  # bytes of text worked on at once
HELD = 2 << 20  # partial counts a task holds before it merges or sends them
HOT = 1 << 22  # occurrences of a word from which trigrams around it are salted
PART_BYTES = 4 << 20  # of input for each part
OPEN = 4096  # files that a worker keeps mapped
SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
VALUE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
BASE = 0x9E3779B97F4A7C15
END, BEGIN = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


@functools.lru_cache(4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    """BASE ** i (or its inverse's) modulo 2 ** 64 for i < n."""
    b = pow(BASE, -1, 1 << 64) if inverse else BASE
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * _U(pow(b, k, 1 << 64))
        k *= 2
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """buf: bytes of texts end to end, starts: where texts begin.  Hashes of all
    words (A-Z lower-cased) and the place of each word's first byte."""
    n = len(buf)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    edge = first[:n]
    edge[1:] |= space[:-1]
    edge[0] = True
    begin = np.flatnonzero(edge & ~space)
    last = np.empty(n, bool)
    last[:-1] = space[1:] | first[1:n]
    last[-1] = True
    end = np.flatnonzero(last & ~space) + 1
    size = max(CHUNK, 1 << (n - 1).bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUE[buf] * _powers(size, False)[:n], out=total[1:])
    h = (total[end] - total[begin]) * _powers(size, True)[begin]
    return _mix(h + (end - begin).astype(np.uint64) * _U(BASE)), begin


def token_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, tokens, where each row's tokens begin) for stretches of
    rows of about CHUNK bytes.  Every row's tokens are its words' hashes, then
    END.  A text beyond CHUNK is hashed in stretches that end at spaces."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1)
        buf, starts = raw[off[row] : off[last]], off[row : last + 1] - off[row]
        if len(buf) > 2 * CHUNK:  # one long text
            parts, at = [], 0
            while at < len(buf):
                to = min(len(buf), at + CHUNK)
                while to < len(buf) and not SPACE[buf[to]]:
                    ahead = np.flatnonzero(SPACE[buf[to : to + CHUNK]])
                    to = to + int(ahead[0]) if len(ahead) else min(len(buf), to + CHUNK)
                parts.append(word_hashes(buf[at:to], np.zeros(1, np.int64))[0])
                at = to
            h, count = np.concatenate(parts), np.array([sum(map(len, parts))])
        else:
            h, begin = word_hashes(buf, starts[:-1])
            count = np.diff(np.searchsorted(begin, starts))
        docs = len(count)
        firsts = np.concatenate(([0], np.cumsum(count + 1)))
        tokens = np.full(firsts[-1], END)
        tokens[np.arange(len(h)) + np.repeat(np.arange(docs), count)] = h
        yield row, docs, tokens, firsts[:-1]
        row = last


# packed columns


def pack(columns: list[np.ndarray], deltas: int = 1) -> bytes:
    """Integer columns of one length, not negative, the first ``deltas`` of them
    ascending and told by their steps: as few bytes a number as the largest needs,
    byte by byte, compressed."""
    import zstandard

    cols = [np.diff(c.astype(np.uint64), prepend=_U(0)) if i < deltas else c.astype(np.uint64) for i, c in enumerate(columns)]
    widths = [next(k for k in (1, 2, 4, 8) if not len(c) or int(c.max()) < 1 << 8 * k) for c in cols]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes() for c, k in zip(cols, widths)]
    head = np.array([len(cols[0]), len(cols), deltas, *widths], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    b = zstandard.ZstdDecompressor().decompress(blob)
    n, k, deltas = np.frombuffer(b, np.int64, 3).tolist()
    at, out = 24 + 8 * k, []
    for i, width in enumerate(np.frombuffer(b, np.int64, k, 24).tolist()):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(b, np.uint8, n * width, at).reshape(width, n).T
        c = wide.reshape(-1).view(np.uint64)
        out.append(np.cumsum(c, dtype=np.uint64) if i < deltas else c)
        at += n * width
    return out


def firsts_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows in the order of the keys (the first one first), equal ones added up."""
    if len(keys) > 1 and all(int(k.max(initial=0)) < 1 << 32 for k in keys[:2]):
        order = np.lexsort([*keys[:1:-1], keys[0] << _U(32) | keys[1]])  # two keys in one sort
    else:
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys, counts = [k[order] for k in keys], counts[order]
    first = firsts_of(*keys)
    return [k[first] for k in keys], np.add.reduceat(counts, first) if len(first) else counts


def gathered(blobs) -> tuple[list[np.ndarray], np.ndarray]:
    """Key columns and counts (the last column) of packed partial counts, added up."""
    parts = [unpack(b) for b in blobs]
    *keys, counts = (np.concatenate(c) for c in zip(*parts))
    return summed(keys, counts)


class Partial:
    """Counts of a task, merged as they grow, sent by parts."""

    def __init__(self, part_of, send_early: bool) -> None:
        self.part_of, self.early, self.held, self.size = part_of, send_early, [], 0

    def add(self, keys: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """keys: distinct rows of columns."""
        self.held.append((keys, counts.astype(np.uint64)))
        self.size += len(counts)
        if self.size > HELD and len(self.held) > 1:
            self.merge()
            if self.early or self.size > HELD:
                yield from self.send()

    def merge(self) -> None:
        keys = [np.concatenate(k) for k in zip(*(k for k, _ in self.held))]
        self.held = [summed(keys, np.concatenate([c for _, c in self.held]))]
        self.size = len(self.held[0][1])

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.merge()
            keys, counts = self.held[0]
            for p, rows in by_part(self.part_of(*keys)):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pack([*(k[rows] for k in keys), counts[rows]])], pa.binary())], ["part", "blob"])
            self.held, self.size = [], 0


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its rows in order)."""
    order = np.argsort(part, kind="stable")
    first = firsts_of(part[order])
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        yield int(part[order[s]]), order[s:e]


# arrays in the shared folder


def small(name: str, a: np.ndarray) -> dict[str, np.ndarray]:
    """A byte for each number below 255, the others apart."""
    large = np.flatnonzero(a >= 255)
    return {name: np.minimum(a, 255).astype(np.uint8), f"{name}.at": large.astype(np.int64), f"{name}.more": a[large].astype(np.int64)}


def hashed(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted 64-bit keys, in buckets of their first bits (about 4 to 8 a bucket): where
    these begin, and the 40 bits that follow, in 5 bytes."""
    b = min(24, (len(keys) // 4).bit_length() - 1) if len(keys) >= 4 else 0
    first = (keys >> _U(64 - b)).astype(np.int64) if b else np.zeros(len(keys), np.int64)
    rest = keys << _U(b) >> _U(24)
    starts = np.searchsorted(first, np.arange((1 << b) + 1)).astype(np.uint32)
    return {f"{name}.first": starts, f"{name}.low": (rest & _U(0xFFFFFFFF)).astype(np.uint32), f"{name}.high": (rest >> _U(32)).astype(np.uint8)}


def put(folder: str, name: str, part: int, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line that tells of the arrays, then the arrays."""
    told, at = {}, 0
    for k, a in arrays.items():
        told[k] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(told).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    blocks = [head, *(x for a in arrays.values() for x in (a.tobytes(), bytes(-a.nbytes % 8)))]
    write_atomic(f"{folder}/{name}-{part}", b"".join(blocks))


class Arrays:
    """What ``put`` wrote, mapped on use; the files used first are let go."""

    def __init__(self, folder: str) -> None:
        self.folder, self.found = folder, {}

    def file(self, name: str, part: int) -> dict[str, np.ndarray]:
        got = self.found.get((name, part))
        if got is None:
            path, got = f"{self.folder}/{name}-{part}", {}
            if os.path.exists(path):
                raw = np.memmap(path, np.uint8, "r")
                with open(path, "rb") as f:
                    head = f.readline()
                for k, (kind, at, n) in json.loads(head).items():
                    at += len(head)
                    got[k] = raw[at : at + n * np.dtype(kind).itemsize].view(kind)
            if len(self.found) >= OPEN:
                self.found.pop(next(iter(self.found)))
            self.found[name, part] = got
        return got

    def get(self, name: str, part: int, key: str, kind=np.int64) -> np.ndarray:
        return self.file(name, part).get(key, np.empty(0, kind))

    def find(self, name: str, part: int, key: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``keys`` that ``hashed`` stored, their places): by halving, in the
        buckets of all keys at once."""
        got = self.file(name, part)
        starts = got.get(f"{key}.first")
        if starts is None or not starts[-1]:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = got[f"{key}.low"], got[f"{key}.high"]
        b = (len(starts) - 1).bit_length() - 1
        bucket = (keys >> _U(64 - b)).astype(np.int64) if b else np.zeros(len(keys), np.int64)
        rest = keys << _U(b) >> _U(24)
        at = starts[bucket].astype(np.int64)
        end = starts[bucket + 1].astype(np.int64)
        last, rows = end.copy(), np.flatnonzero(at < end)
        told = lambda i: high[i].astype(np.uint64) << _U(32) | low[i]
        while len(rows):
            mid = (at[rows] + end[rows]) >> 1
            less = told(mid) < rest[rows]
            at[rows[less]] = mid[less] + 1
            end[rows[~less]] = mid[~less]
            rows = rows[at[rows] < end[rows]]
        rows = np.flatnonzero(at < last)
        rows = rows[told(at[rows]) == rest[rows]]
        return rows, at[rows]

    def at(self, name: str, part: int, key: str, i: np.ndarray) -> np.ndarray:
        """Numbers that ``small`` stored, by place."""
        out = np.asarray(self.get(name, part, key)[i]).astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self.get(name, part, f"{key}.more")[np.searchsorted(self.get(name, part, f"{key}.at"), i[large])]
        return out


@dataclass
class Vocabulary:
    """Words by number: part p has the numbers from first[p] on."""

    folder: str
    parts: int  # a power of two
    first: np.ndarray
    tokens: int
    texts: int
    hot: int = HOT

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def part_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(65 - self.parts.bit_length())).astype(np.int64) if self.parts > 1 else np.zeros(len(h), np.int64)

    def numbers(self, arrays: Arrays, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (or -1) and count of each of the sorted hashes."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for p, rows in by_part(self.part_of(h)):
            a = arrays.get("word", p, "hash", np.uint64)
            if len(a):
                i = np.minimum(np.searchsorted(a, h[rows]), len(a) - 1)
                hit = np.asarray(a[i]) == h[rows]
                number[rows] = np.where(hit, i + self.first[p], -1)
                count[rows] = np.where(hit, arrays.get("word", p, "count")[i], 0)
        return number, count

    def word_part(self, number: np.ndarray) -> np.ndarray:
        """Where what is told by number lies; BEGIN's (and what is beyond) behind the rest."""
        part = np.searchsorted(self.first, number.astype(np.int64), "right") - 1
        return np.where(number >= self.size, self.parts, part)

    def by_number(self, arrays: Arrays, file: str, keys: list[str], number: np.ndarray) -> list[np.ndarray]:
        """Entries of arrays by number, 0 for -1; BEGIN has the number ``size``."""
        out = [np.zeros(len(number), np.int64) for _ in keys]
        some = np.flatnonzero(number >= 0)
        for p, rows in by_part(self.word_part(number[some])):
            start = self.size if p == self.parts else int(self.first[p])
            for o, k in zip(out, keys):
                a = arrays.get(file, p, k)
                if len(a):
                    o[some[rows]] = a[number[some[rows]] - start]
        return out

    def salts(self, arrays: Arrays, number: np.ndarray) -> np.ndarray:
        """Into how many parts what stands beside a word goes."""
        words, at = np.unique(number.astype(np.int64), return_inverse=True)
        n = np.full(len(words), self.texts, np.int64)
        inside = words < self.size
        n[inside] = self.by_number(arrays, "word", ["count"], words[inside])[0]
        return (1 + n // self.hot)[at]


@dataclass
class Model:
    """pairs, trigrams: parts of their arrays; discounts of trigrams, pairs, words;
    kinds: distinct pairs; low: words with 1, 2, more different words before them."""

    vocabulary: Vocabulary
    discounts: list[tuple[float, float, float]]
    kinds: int
    low: tuple[int, int, int]

    @property
    def parts(self) -> int:
        return self.vocabulary.parts


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers."""
    return _mix(_mix(a.astype(np.uint64) + _U(0xA0761D6478BD642F)) * _U(0x9E3779B97F4A7C15) + b.astype(np.uint64) * _U(0xE7037ED1A0B428DB))


def triple_key(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(pair * _U(0x8EBC6AF09C88C6E3) + w.astype(np.uint64) * _U(0x589965CC75374CC3))


def pair_part(a: np.ndarray, b: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    """Where (a, b) lies as a context: by b; for a hot b also by a, modulo its salts."""
    return (_mix(b.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + a.astype(np.uint64) % salt.astype(np.uint64)) % _U(parts)).astype(np.int64)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """From the numbers of kinds that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.95, 2.95)))


def _often(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in range(1, 5)]


def _power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def count_words(texts: DataFrame, folder: str, parts: int, hot: int) -> Vocabulary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Partial(Vocabulary("", parts, np.zeros(1), 0, 0).part_of, False)
        for batch in batches:
            for _, _, tokens, _ in token_chunks(batch.column(0)):
                k, c = np.unique(tokens, return_counts=True)
                yield from held.add([k], c)
        yield from held.send()

    def reduce(p: pd.DataFrame) -> pd.DataFrame:
        part = int(p["part"].iloc[0])
        (keys,), counts = gathered(p["blob"])
        put(folder, "word", part, {"hash": keys, "count": counts.astype(np.int64)})
        return pd.DataFrame({"part": [part], "n": [len(keys)], "total": [int(counts.sum())], "texts": [int(counts[keys == END].sum())]})

    rows = texts.mapInArrow(run, "part int, blob binary").groupBy("part").applyInPandas(reduce, "part int, n long, total long, texts long").collect()
    n = np.zeros(parts, np.int64)
    for r in rows:
        n[r.part] = r.n
    return Vocabulary(folder, parts, np.concatenate(([0], np.cumsum(n))), sum(r.total for r in rows), sum(r.texts for r in rows), hot)


def _places(v: Vocabulary, arrays: Arrays, tokens: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct tokens' numbers and counts; each token's place among them, and that
    of the token before, which at a text's start is BEGIN's, behind the others."""
    h, at = np.unique(tokens, return_inverse=True)
    number, count = v.numbers(arrays, h)
    before = np.empty(len(at), np.int64)
    before[1:] = at[:-1]
    before[firsts] = len(h)
    return number, count, at, before


def _distinct(columns: list[np.ndarray], bound: int, **more) -> tuple:
    """np.unique of rows of small numbers below ``bound``: (columns, *what it returns)."""
    if bound ** len(columns) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * bound + c
        key, *rest = np.unique(key, **more)
        out = []
        for _ in columns[1:]:
            out.append(key % bound)
            key = key // bound
        return [key, *out[::-1]], *rest
    rows, *rest = np.unique(np.stack(columns, axis=1), axis=0, **more)
    return [rows[:, i] for i in range(len(columns))], *(r.reshape(-1) for r in rest)


def train(texts: DataFrame, parts: int | None = None, hot: int = HOT) -> Model:
    """A model of the (one) text column's rows; null texts count as empty, an empty
    table gives a model that knows no word."""
    parts = _power_of_two(min(parts or shuffle_width(texts, PART_BYTES), 1 << 20))
    folder = shared_path(texts.sparkSession, "lm")
    v = count_words(texts, folder, parts, hot)
    begin, nothing = v.size, v.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(folder)

        def part_of(mid: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return pair_part(np.where(mid == begin, right, left), mid, v.salts(arrays, mid), parts)

        held = Partial(part_of, True)
        for batch in batches:
            for _, _, tokens, firsts in token_chunks(batch.column(0)):
                number, _, at, before = _places(v, arrays, tokens, firsts)
                number = np.concatenate((number, [begin, nothing])).astype(np.uint64)
                left = np.empty(len(at), np.int64)
                left[1:] = before[:-1]
                left[firsts] = len(number) - 1
                rows, counts = _distinct([before, left, at], len(number), return_counts=True)
                yield from held.add([number[r] for r in rows], counts)
        yield from held.send()

    def count_triples(p: pd.DataFrame) -> pd.DataFrame:
        """Writes a part of the trigrams and their contexts; sends on the pairs."""
        part, arrays = int(p["part"].iloc[0]), Arrays(folder)
        (mid, left, right), counts = gathered(p["blob"])
        counts = counts.astype(np.int64)
        start = mid == begin
        raw = right[start], counts[start]
        mid, left, right, counts = mid[~start], left[~start], right[~start], counts[~start]
        first = firsts_of(mid, left)
        add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        key = pair_key(left, mid)
        order = np.argsort(key[first], kind="stable")
        stats = {"total": add(counts), "n1": add(counts == 1), "n2": add(counts == 2), "n3": add(counts > 2)}
        files = hashed("pair", key[first][order]) | {k: x for name, a in stats.items() for k, x in small(name, a[order]).items()}
        triple = triple_key(key, right)
        order = np.argsort(triple, kind="stable")
        put(folder, "triple", part, files | hashed("triple", triple[order]) | small("times", counts[order]))
        (w, m), n = summed([right, mid], np.ones(len(mid), np.uint64))
        w, m, n = np.concatenate((w, raw[0])), np.concatenate((m, np.full(len(raw[0]), begin, np.uint64))), np.concatenate((n, raw[1].astype(np.uint64)))
        order = np.lexsort((m, w))
        w, m, n = w[order], m[order], n[order]
        out = [(to, pack([w[r], m[r], n[r]])) for to, r in by_part(pair_part(m, w, v.salts(arrays, w), parts))]
        out.append((-1, pack([np.array(_often(counts))], 0)))
        return pd.DataFrame(out, columns=["to", "blob"])

    def count_pairs(p: pd.DataFrame) -> pd.DataFrame:
        """Writes the continuation counts of a part's pairs, beside their contexts'
        sums; sends on the sums of their first words, and how many their last have."""
        q = int(p["to"].iloc[0])
        if q < 0:
            return pd.DataFrame({"to": [-3], "kind": ["often"], "blob": [pack([np.sum([unpack(b)[0].astype(np.int64) for b in p["blob"]], axis=0)], 0)]})
        (w, a), n = gathered(p["blob"])
        n = n.astype(np.int64)
        key, arrays = pair_key(a, w), Arrays(folder)
        rows, i = arrays.find("triple", q, "pair", key)
        beside, alone = np.zeros(len(arrays.get("triple", q, "n1")), np.int64), np.ones(len(key), bool)
        beside[i], alone[rows] = n[rows], False
        order = np.argsort(key[alone], kind="stable")  # pairs that end texts are no contexts
        put(folder, "pair", q, small("cont", beside) | hashed("rest", key[alone][order]) | small("rest_cont", n[alone][order]))
        out = []

        def send(kind: str, number: np.ndarray, columns: list[np.ndarray]) -> None:
            for to, r in by_part(v.word_part(number)):
                out.append((to, kind, pack([number[r], *(c[r] for c in columns)])))

        order = np.argsort(a, kind="stable")
        by, m = a[order], n[order]
        first = firsts_of(by)
        add = lambda x: np.add.reduceat(x.astype(np.int64), first)
        send("context", by[first], [add(m), add(m == 1), add(m == 2), add(m > 2)])
        first = firsts_of(w)
        send("word", w[first], [np.diff(np.append(first, len(w)))])
        out.append((-2, "often", pack([np.array(_often(n))], 0)))
        return pd.DataFrame(out, columns=["to", "kind", "blob"])

    def place(p: pd.DataFrame) -> pd.DataFrame:
        """Writes the arrays by number of one part of the words."""
        q = int(p["to"].iloc[0])
        if q < 0:
            answer = np.sum([unpack(b)[0].astype(np.int64) for b in p["blob"]], axis=0)
            return pd.DataFrame({"to": [q], "answer": [answer.tolist()]})
        start, size = (v.size, 1) if q == parts else (int(v.first[q]), int(v.first[q + 1] - v.first[q]))
        sums = {"context": np.zeros((4, size), np.int64), "word": np.zeros((1, size), np.int64)}
        for kind, b in zip(p["kind"], p["blob"]):
            number, *columns = (c.astype(np.int64) for c in unpack(b))
            for s, c in zip(sums[kind], columns):
                s[number - start] += c
        cont = sums["word"][0]
        put(folder, "low", q, dict(zip(("total", "n1", "n2", "n3"), sums["context"])) | {"cont": cont})
        return pd.DataFrame({"to": [q], "answer": [[*_often(cont), int((cont > 2).sum()), int(cont.sum())]]})

    rows = (
        texts.mapInArrow(run, "part int, blob binary").groupBy("part").applyInPandas(count_triples, "to int, blob binary")
        .groupBy("to").applyInPandas(count_pairs, "to int, kind string, blob binary")
        .groupBy("to").applyInPandas(place, "to int, answer array<long>").collect()
    )
    of = lambda q: next((r.answer for r in rows if r.to == q), [0] * 4)
    low = np.sum([r.answer for r in rows if r.to >= 0] or [[0] * 6], axis=0)
    return Model(v, [_discounts(of(-3)), _discounts(of(-2)), _discounts(low[:4])], int(low[5]), (int(low[0]), int(low[1]), int(low[4])))


def _less(d: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.m, self.arrays = model, Arrays(model.vocabulary.folder)

    def low(self, cont: np.ndarray) -> np.ndarray:
        """Probability of words by their continuation counts, 0 for unknown ones."""
        m = self.m
        if not m.kinds:
            return np.full(len(cont), 1 / (m.vocabulary.size + 1))
        d = m.discounts[2]
        return _less(d, cont) / m.kinds + sum(a * b for a, b in zip(d, m.low)) / m.kinds / (m.vocabulary.size + 1)

    def pairs(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of known pairs: their key and part, continuation count, and as contexts
        their total and the numbers of trigrams that occur once, twice, more often."""
        key, part = pair_key(a, b), pair_part(a, b, salt, self.m.parts)
        out = np.zeros((5, len(key)), np.int64)
        for p, rows in by_part(part):
            for name, keys, columns in (("triple", "pair", (("pair", "cont"), ("triple", "total"), ("triple", "n1"), ("triple", "n2"), ("triple", "n3"))), ("pair", "rest", (("pair", "rest_cont"),))):
                hit, i = self.arrays.find(name, p, keys, key[rows])
                for k, (file, column) in enumerate(columns if len(hit) else ()):
                    out[k, rows[hit]] = self.arrays.at(file, p, column, i)
        return key, part, *out

    def times(self, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Counts of trigrams."""
        out = np.zeros(len(key), np.int64)
        for p, rows in by_part(part):
            hit, i = self.arrays.find("triple", p, "triple", key[rows])
            if len(hit):
                out[rows[hit]] = self.arrays.at("triple", p, "times", i)
        return out

    def score(self, tokens: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base and model log10 probability."""
        m, v = self.m, self.m.vocabulary
        number, count, at, before = _places(v, self.arrays, tokens, firsts)
        base = np.log10((count + 0.5) / (v.tokens + 0.5 * (v.size + 1)))
        number, n = np.append(number, v.size), len(number) + 1
        total, n1, n2, n3, cont = v.by_number(self.arrays, "low", ["total", "n1", "n2", "n3", "cont"], number)
        p = self.low(cont[:-1])[at]

        # pairs: a pair, one place on, is the context of a trigram
        (a, b), pair = _distinct([before, at], n, return_inverse=True)
        known = np.flatnonzero((number[a] >= 0) & (number[b] >= 0))
        salt = (1 + np.append(count, v.texts) // v.hot)[b[known]]
        key, part, *found = self.pairs(number[a[known]], number[b[known]], salt)
        place = np.full(len(a), -1, np.int64)
        place[known] = np.arange(len(known))
        pair = place[pair]
        pick = lambda column, i: np.where(i >= 0, column[np.maximum(i, 0)], 0) if len(column) else np.zeros(len(i), np.int64)
        d = m.discounts[1]
        t = total[before]
        back = d[0] * n1[before] + d[1] * n2[before] + d[2] * n3[before]
        p = np.where(t > 0, (_less(d, pick(found[0], pair)) + back * p) / np.maximum(t, 1), p)

        # trigrams: of all tokens but the first of each text
        context = np.empty(len(at), np.int64)
        context[1:] = pair[:-1]
        context[firsts] = -1
        d = m.discounts[0]
        t, k1, k2, k3 = (pick(c, context) for c in found[1:])
        asked = np.flatnonzero((t > 0) & (number[at] >= 0))
        c = np.zeros(len(at), np.int64)
        if len(asked):
            (x, w), where = _distinct([context[asked], at[asked]], max(n, len(key)), return_inverse=True)
            c[asked] = self.times(triple_key(key[x], number[w]), part[x])[where]
        p = np.where(t > 0, (_less(d, c) + (d[0] * k1 + d[1] * k2 + d[2] * k3) * p) / np.maximum(t, 1), p)
        per = lambda x: np.add.reduceat(x, firsts)
        return np.diff(np.append(firsts, len(tokens))), per((count[at] > 0).astype(np.int64)), per(base[at]), per(np.log10(p))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, train_tokens,
    base_score and score, log10 probabilities.  Null texts are empty: one token,
    the end.  Repeated rows repeat; an empty table gives an empty one; columns named
    like the new ones are replaced."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in docs.columns if c != text and c not in new]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for row, n, tokens, firsts in token_chunks(batch.column(text)):
                count, known, base, own = scorer.score(tokens, firsts)
                made = [pa.array(count, pa.int64()), pa.array(known), pa.array(np.full(n, model.vocabulary.tokens)), pa.array(base), pa.array(own)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, n) for c in names] + made, [*names, *new])

    return docs.mapInArrow(run, schema)


def op2(docs: DataFrame) -> DataFrame:
    """The contract's columns and the perplexity, one row per document: null texts
    are empty (one token, the end), null ids of the fold of the empty text."""
    rows = docs.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "text")
    model = train(rows.filter("NOT held_out").select("text"))
    return score(rows, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
