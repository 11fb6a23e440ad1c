"""Text, path, URL and id functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "md": "markdown",
}
ENTITY_LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "c_sharp", "swift": "swift", "v": "verilog"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: Column) -> Column:
    """By extension, for search; null if unknown."""
    return _lookup(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), INDEX_LANGUAGES)


def entity_language(path: Column) -> Column:
    """By extension, case-sensitive, for entity extraction."""
    return _lookup(F.regexp_extract(path, r"\.([^./]+)$", 1), ENTITY_LANGUAGES)


def is_text(content: Column) -> Column:
    """No NUL, and under 30 % control bytes of the first 4096; empty is binary."""
    head = F.substring(content.cast("binary"), 1, 4096)
    s = F.decode(head, "ISO-8859-1")
    bad = F.length(s) - F.length(F.regexp_replace(s, r"[\x01-\x08\x0b\x0e-\x1f]", ""))
    return (F.length(s) > 0) & ~F.contains(F.decode(content.cast("binary"), "ISO-8859-1"), F.lit("\0")) & (bad < 0.3 * F.length(s))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def let(value: Column, f) -> Column:
    """f(value) with the value made once, as a lambda variable."""
    return F.transform(F.array(value), f)[0]


STRETCH = 256


def running(lengths: Column) -> Column:
    """Sums of all elements before each one of an array<int>.  Sums grow within
    stretches of the array, so no step copies more than a stretch or a number a
    stretch: n elements cost about n * STRETCH / 2 moves."""
    empty = F.array().cast("array<int>")

    def grown(xs: Column, start: Column) -> Column:
        return F.aggregate(
            xs, F.struct(start.alias("at"), empty.alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"],
        )

    def whole(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int")), lambda b: F.slice(xs, b * STRETCH + 1, F.lit(STRETCH)))
        sums = lambda parts: F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return let(cut, lambda parts: F.flatten(F.zip_with(parts, grown(sums(parts), F.lit(0)), grown)))

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(empty))


def newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def located(text: Column, pattern: str, **measures) -> Column:
    """Leftmost non-overlapping hits as an array of (start, end, hit), characters
    from 0, end exclusive; ``measures`` (name = width of a string) are told of
    what lies before a hit, the first one instead of start if there are any.
    What lies between hits gives the places, so time and memory grow as the text,
    however many hits it has.  Hits of no length have no reliable place."""
    measures = measures or {"start": F.length}
    first = next(iter(measures))
    kinds = ",".join(f"{m}:int" for m in measures)
    empty = F.array().cast(f"array<struct<{kinds},end:int,hit:string>>")

    def placed(hits: Column) -> Column:
        def before(gaps: Column, width) -> Column:
            sizes = F.zip_with(gaps, hits, lambda g, h: width(g) + width(h))
            return F.zip_with(running(sizes), gaps, lambda a, g: a + width(g))

        def rows(gaps: Column) -> Column:
            table = F.struct(*[before(gaps, w).alias(m) for m, w in measures.items()])

            def row(t: Column) -> Column:
                at = lambda i: [F.get(t[m], i).alias(m) for m in measures]
                return F.transform(hits, lambda h, i: F.struct(*at(i), (F.get(t[first], i) + measures[first](h)).alias("end"), h.alias("hit")))

            return let(table, row)

        return let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), rows)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(empty))


def tokens(content: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(content), TOKEN_SPLIT), lambda t: t != ""))


def trigrams(content: Column) -> Column:
    """All overlapping three-character pieces of runs of [a-z0-9_], in order."""
    runs = F.regexp_extract_all(ascii_lower(content), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, F.lit(3)))))


def trigram_positions(content: Column) -> Column:
    """Array of (tri, byte): with the UTF-8 offset of each first byte."""
    each = lambda p: F.transform(F.sequence(F.lit(0), F.length(p["hit"]) - 3), lambda i: F.struct(F.substring(p["hit"], i + 1, F.lit(3)).alias("tri"), (p["start"] + i).alias("byte")))
    return F.flatten(F.transform(located(ascii_lower(content), "[a-z0-9_]{3,}", start=F.octet_length), each))


def trim_last(s: Column, n: int, mark: bool = True) -> Column:
    """The last n characters, an ellipsis before them if some were cut."""
    if n <= 0:
        return F.lit("")
    cut = F.concat(F.lit("…" if mark else ""), F.right(s, F.lit(n)))
    return F.when(F.length(s) <= n, s).otherwise(cut)


def trim_first(s: Column, n: int, mark: bool = True) -> Column:
    """The first n characters, an ellipsis behind them if some were cut."""
    if n <= 0:
        return F.lit("")
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n)), F.lit("…" if mark else "")))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def content_id(content: Column) -> Column:
    return F.sha2(content, 256)


def repo_name(url: Column) -> Column:
    """Last segment of a URL without '.git'."""
    return F.regexp_extract(F.regexp_replace(F.rtrim(url, F.lit("/")), r"\.git$", ""), r"([^/:]+)$", 1)


def normalise_git_url(url: Column) -> Column:
    """ssh forms become https, credentials and '.git' go."""
    u = F.regexp_replace(url, r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    u = F.regexp_replace(u, r"^(https?://)[^/@]*@", "$1")
    return F.regexp_replace(F.rtrim(u, F.lit("/")), r"\.git$", "")


def owner_of(url: Column) -> Column:
    """All path segments but the last; '' if there is one only."""
    path = F.regexp_replace(normalise_git_url(url), r"^[a-z]+://[^/]+/?", "")
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


def without_uuid(name: Column) -> Column:
    """A name without the '-<uuid>' it may end with."""
    return F.regexp_replace(name, f"^(.+)-{_UUID}$", "$1")


def uuid_repo(path: Column) -> Column:
    """The first part of a path that ends with a uuid, or null."""
    return F.nullif(F.regexp_extract(path, f"(?:^|/)([^/]+-(?:{_UUID}|[0-9a-fA-F]{{32}}))(?=/|$)", 1), F.lit(""))


def clean_path(path: Column, clones: str = "clones") -> Column:
    """A path in its repository: what leads up to the clone below /tmp or a folder
    of clones goes, and so do uuids that parts end with, and empty parts."""
    p = F.regexp_replace(path, rf"^/?tmp/[^/]+/(?:[^/]+-{_UUID}/)?", "")
    p = F.regexp_replace(p, rf"(?:^|.*/){clones}/[^/]+/", "")
    parts = F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, f"^(.+)-(?:{_UUID}|[0-9a-fA-F]{{32,}})$", "$1"))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise(path)


def repo_relative(path: Column, repo: Column) -> Column:
    """What follows the first part that is the repository (or it with a suffix, or
    with '_' for '-'); else the clean path."""
    parts = F.split(clean_path(path), "/")

    def named(x: Column) -> Column:
        return (x == repo) | x.startswith(F.concat(repo, F.lit("-"))) | (x == F.replace(repo, F.lit("-"), F.lit("_")))

    hits = F.filter(F.transform(parts, lambda x, i: F.when(named(x), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.array_join(F.slice(parts, F.element_at(hits, 1) + 2, F.size(parts)), "/")).otherwise(clean_path(path))


def source_url(url: Column, branch: Column, path: Column, line: Column | None = None) -> Column:
    """Where a file is shown, .../blob/<branch>/<path>[#L<line>]; null for a
    repository that no web address is known of."""
    base = normalise_git_url(url)
    web = base.rlike("^https?://")
    at = F.lit("") if line is None else F.coalesce(F.concat(F.lit("#L"), line.cast("string")), F.lit(""))
    return F.when(web, F.concat(base, F.lit("/blob/"), branch, F.lit("/"), path, at))


def short_display(url: Column, repo: Column) -> Column:
    """owner/repository[/path] of such an address (also .../-/blob/...); else what
    follows the repository's name, else the address itself."""
    m = lambda i: F.regexp_extract(url, r"^https?://[^/]+/(?:[^/]+/)*?([^/]+/[^/]+)/(?:-/)?blob/[^/]+(?:/([^#?]*))?", i)
    tail = F.substring(url, F.instr(url, repo), F.length(url))
    named = F.when(F.contains(url, repo), tail).otherwise(url)
    return F.when(F.coalesce(url, F.lit("")) == "", repo).when(m(1) != "", F.concat_ws("/", m(1), F.nullif(m(2), F.lit("")))).otherwise(named)


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out


def clean_json_text(s: Column) -> Column:
    """NUL becomes a blank, other control characters but tab and line ends go."""
    return F.regexp_replace(F.translate(s, "\0", " "), r"[\x01-\x08\x0b\x0c\x0e-\x1f]", "")
