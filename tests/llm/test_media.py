import glob
import hashlib
import io
import random
import wave
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeseam.llm import media


def slow_cuts(data):
    """The rolling hash a byte at a time."""
    out, start, h = [], 0, 0
    hashes = []
    for b in data:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    n = len(data)
    while n - start > media.LEAST:
        end = next((i for i in range(start + media.LEAST, min(n, start + media.MOST) + 1) if hashes[i - 1] >> (32 - media.MEAN_BITS) == 0), min(n, start + media.MOST))
        out.append(end)
        start = end
    return out + ([n] if start < n else [])


def test_cuts_follow_the_rolling_hash():
    rng = random.Random(1)
    for n in (0, 1, 500, 513, 3000, 60_000):
        data = rng.randbytes(n)
        assert media.cuts(data) == slow_cuts(data) and b"".join(media.chunks(data)) == data
    assert media.cuts(bytes(100_000)) == slow_cuts(bytes(100_000))


def test_a_change_moves_few_chunks():
    data = random.Random(2).randbytes(200_000)
    a, b = set(media.chunks(data)), set(media.chunks(data[:90_000] + b"inserted" + data[90_000:]))
    assert len(a - b) <= 4


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_container(payload):
    m = media.wav(payload)
    assert media.samples(m) == payload
    with wave.open(io.BytesIO(m)) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)


def test_query_is_a_round_trip(spark, make_docs, sample):
    long = " ".join(str(i * i) for i in range(30_000))
    texts = [None, "", "x", "x", "tail\0\0", "é" * 100, "a" * 64, long, long[:90_000] + "!" + long[90_000:]]
    docs = make_docs([*texts, (3, "x", "again"), (None, long, None), (None, None, None), (-(1 << 63), "least", "s"), (0, long, None)], extra=True).unionByName(sample, allowMissingColumns=True)
    want = []
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        m = media.wav(p)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((r.doc_id, len(b), len(p), sha(p), zlib.crc32(p[-64:]), len(m), sha(m), media.feature_of(p)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, media.op7(docs).collect()), key=key) == sorted(want, key=key)
    assert media.op7(make_docs([])).count() == 0


def test_chunks_are_stored_once_and_damage_is_seen(spark, make_docs):
    long = " ".join(str(i * 7) for i in range(40_000))
    docs = make_docs([long + str(i % 3) for i in range(12)])
    keys, listed, folder = media.write_media(docs)
    assert listed.count() == 12 * listed.filter("id = 0").count()
    chunks = {r.digest: r.length for r in listed.collect()}
    stored = listed.select("digest", "pack", "block", "at").distinct().count()
    assert stored == len(chunks) < 1.4 * listed.filter("id = 0").count()
    for pack in glob.glob(f"{folder}/*.pack"):
        with open(pack, "r+b") as f:
            b = f.read()
            if b:
                import zstandard

                raw = bytearray(zstandard.ZstdDecompressor().decompressobj().decompress(b))
                raw[500] ^= 1
                f.seek(0)
                f.write(zstandard.ZstdCompressor(level=3).compress(bytes(raw))[: len(b)])
    with pytest.raises(Exception):
        media.read_media(keys, listed, folder, lambda m: (len(m),), "n long").collect()
