"""Secret scan with DataFrame functions only.

Three base patterns (assignments, access keys, hex runs) are found leftmost and
non-overlapping; to them the method adds spans of candidate strings in which a
sliding window holds high Shannon entropy for its character class.  The window
entropy is kept by incremental counts: a packed count string and the running
sum of ``c log2 c`` are updated for the character that leaves and the one that
enters.  An allow-list suppresses added spans (never base ones): candidates of
plain forms, and windows that touch a placeholder, which parts its candidate.

Row local: one scan, no shuffle, no Python.  Time and memory grow as the text,
whatever the number of hits or the length of a candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions.text import let, located

ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: class name -> (candidate pattern, alphabet, window, bits from which a window counts)
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9])[0-9A-Fa-f]{16,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 16, 2.75),
    "entropy_base64": (
        r"[A-Za-z0-9+/_-]{20,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
        20,
        3.8,
    ),
}

#: Candidates that match are no secrets: counters and card-like numbers, plain
#: words and identifiers of one case or of capitalised words, UUIDs.
ALLOW = (
    r"^(?:[0-9]+|[A-Z_/+-]*|[a-z_/+-]*|(?!.*(?:[A-Za-z][A-Z]|[A-Z](?![a-z])|[_/+-](?![A-Za-z])))[A-Za-z][A-Za-z_/+-]*"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
)
#: What stands for something else; windows that touch it don't count.
PLACEHOLDER = r"EXAMPLE|example|xxxx|XXXX|0000000|1234567"
KINDS = ["assign", "access", "hex", *CLASSES]


SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _spans(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), h["end"].alias("end")))


def window_entropy_span(candidate: Column, alphabet: str, window: int, bits: float) -> Column:
    """(first, last) of the windows of an ASCII ``candidate`` whose entropy reaches
    ``bits``: offset of the first one's start and of the last one's end, or
    null.  A window's entropy is log2(window) - S / window for S the sum of
    c log2 c over its counts; S changes by two table look-ups a step."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most = window * (math.log2(window) - bits) + 1e-9

    def place(b: Column, i: Column) -> Column:
        return F.instr(F.lit(alphabet), F.substring(b, i + 1, F.lit(1)).cast("string"))

    def changed(acc: Column, at: Column, by: int, made) -> Column:
        """made(counts, s) with the count of the at-th character changed."""
        old = F.ascii(F.substring(acc["counts"], at, F.lit(1))) - 48
        return let(old, lambda n: made(F.overlay(acc["counts"], F.char(n + 48 + by), at, F.lit(1)), acc["s"] + table[n + by] - table[n]))

    def enter(acc: Column, b: Column, i: Column) -> Column:
        def made(counts: Column, s: Column) -> Column:
            full = (i >= window - 1) & (s <= most)
            return F.struct(
                counts.alias("counts"), s.alias("s"),
                F.when(full & acc["first"].isNull(), i - window + 1).otherwise(acc["first"]).alias("first"),
                F.when(full, i + 1).otherwise(acc["last"]).alias("last"),
            )

        return let(place(b, i), lambda at: changed(acc, at, 1, made))

    def leave(acc: Column, b: Column, i: Column) -> Column:
        made = lambda counts, s: F.struct(counts.alias("counts"), s.alias("s"), acc["first"].alias("first"), acc["last"].alias("last"))
        return let(place(b, i), lambda at: changed(acc, at, -1, made))

    def walked(b: Column) -> Column:
        step = lambda acc, i: F.when(i >= window, let(leave(acc, b, i - window), lambda a: enter(a, b, i))).otherwise(enter(acc, b, i))
        none = F.lit(None).cast("int")
        start = F.struct(F.lit("0" * len(alphabet)).alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.octet_length(b) - 1), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return let(candidate.cast("binary"), walked)


def _entropy_spans(text: Column, kind: str, allow: str, placeholder: str) -> Column:
    pattern, alphabet, window, bits = CLASSES[kind]

    def pieces(h: Column) -> Column:
        """(start, s) of what lies between a candidate's placeholders."""
        whole = F.array(F.struct(h["start"].alias("start"), h["hit"].alias("s")))

        def parted(marks: Column) -> Column:
            after = lambda i: F.when(i == 0, 0).otherwise(F.get(marks, i - 1)["end"])
            return F.transform(F.split(h["hit"], placeholder, -1), lambda s, i: F.struct((h["start"] + after(i)).alias("start"), s.alias("s")))

        return F.when(h["hit"].rlike(placeholder), let(located(h["hit"], placeholder), parted)).otherwise(whole)

    hits = F.filter(located(text, pattern), lambda h: ~h["hit"].rlike(allow) & (F.lit(kind == "entropy_hex") | ~h["hit"].rlike("^[0-9A-Fa-f]+$")))
    parts = F.filter(F.flatten(F.transform(hits, pieces)), lambda p: F.length(p["s"]) >= window)
    found = F.transform(parts, lambda p: F.struct(p["start"].alias("start"), window_entropy_span(p["s"], alphabet, window, bits).alias("at")))
    row = lambda p: F.struct((p["start"] + p["at"]["first"]).alias("start"), (p["start"] + p["at"]["last"]).alias("end"))
    return _spans(F.transform(F.filter(found, lambda p: p["at"]["first"].isNotNull()), row), kind)


def _said(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find_secrets(docs: DataFrame, text: str = "text", allow: str = ALLOW, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Adds base_spans and added_spans, arrays of (start, ord, kind, end) in code
    points, end exclusive, to every row; other columns stay as they are.

    Null and empty texts have no spans.  Repeated rows repeat; an empty table gives
    an empty one.  A column of the input named base_spans or added_spans is
    replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    assigned = F.filter(located(t, ASSIGN), lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 2)) >= 8)
    access = F.when(F.contains(t, F.lit("AKIA")), _spans(located(t, ACCESS), "access")).otherwise(F.array().cast(SPANS))
    base = F.concat(_spans(assigned, "assign"), access, _spans(located(t, HEX), "hex"))
    added = F.concat(*[_entropy_spans(t, kind, allow, placeholder) for kind in CLASSES])
    return docs.withColumns({"base_spans": base, "added_spans": added})


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, one row per document; null ids stay null,
    null texts count as empty, other columns are ignored."""
    found = find_secrets(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_said(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _said(F.concat("base_spans", "added_spans")).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )
