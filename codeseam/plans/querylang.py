"""The query language: one line of words and ``key:value`` filters.

All words form one pattern.  Filters: repo: branch: lang: file: case: select:
content: path: re: (or regex:).  Unknown keys stay in the pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TRUE = {"1", "yes", "true"}
_META = set("^$.|()[]{}*+?\\")


def split_words(line: str) -> list[str]:
    """Words by blanks; quotes keep blanks and are removed; no escapes."""
    words, now, quote, some = [], [], None, False
    for c in line:
        if quote:
            if c == quote:
                quote = None
            else:
                now.append(c)
        elif c in "\"'":
            quote, some = c, True
        elif c.isspace():
            if now or some:
                words.append("".join(now))
            now, some = [], False
        else:
            now.append(c)
    if now or some:
        words.append("".join(now))
    return words


def glob_to_regex(glob: str) -> str:
    """Anchored; * any run (across '/'), ? any character, brackets as they are."""
    out, inside = [], False
    for c in glob:
        if inside:
            inside = c != "]"
            out.append("^" if c == "!" and out[-1] == "[" else c)
        elif c == "[" and "]" in glob:
            inside = True
            out.append(c)
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
    return f"^(?s:{''.join(out)})$"


def is_glob(s: str) -> bool:
    return any(c in "*?[" for c in s)


def looks_like_regex(s: str) -> bool:
    return any(c in _META for c in s if c != ".")


def valid_regex(s: str) -> bool:
    try:
        re.compile(s)
    except re.error:
        return False
    return True


@dataclass(frozen=True)
class QueryPlan:
    pattern: str = ""
    repos: tuple[str, ...] = ()
    repo_globs: tuple[str, ...] = ()
    repo_regexes: tuple[str, ...] = ()
    branches: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    file_globs: tuple[str, ...] = ()
    file_regexes: tuple[str, ...] = ()
    select: str = "file"
    case_sensitive: bool = False
    content_only: bool = False
    path_only: bool = False
    regex: bool = False
    words: tuple[str, ...] = field(default=(), compare=False)


def parse(line: str) -> QueryPlan:
    got: dict[str, list[str]] = {k: [] for k in ("repos", "repo_globs", "repo_regexes", "branches", "langs", "file_globs", "file_regexes")}
    flags: dict[str, object] = {}
    words = []
    for w in split_words(line):
        if w.startswith("select="):
            w = "select:" + w[7:]
        key, colon, value = w.partition(":")
        if not colon:
            words.append(w)
        elif key in ("repo", "file"):
            if not looks_like_regex(value):
                got["repos" if key == "repo" else "file_globs"].append(value)
            elif valid_regex(value):
                got[f"{key}_regexes"].append(value)
            elif is_glob(value):
                got[f"{key}_globs"].append(value)
            elif key == "repo":
                got["repos"].append(value)
        elif key == "branch":
            got["branches"].append(value)
        elif key == "lang":
            got["langs"].append(value.lower())
        elif key == "case":
            flags["case_sensitive"] = value in ("yes", "true", "sensitive")
        elif key == "select":
            flags["select"] = value if value in ("repo", "symbol") else "file"
        elif key in ("content", "path"):
            flags[f"{key}_only"] = value in ("only", "yes", "true")
        elif key in ("re", "regex"):
            flags["regex"] = value in _TRUE
        else:
            words.append(w)
    return QueryPlan(pattern=" ".join(words), words=tuple(words), **{k: tuple(v) for k, v in got.items()}, **flags)


# boolean expressions, built by callers


@dataclass(frozen=True)
class Literal:
    text: str
    case_sensitive: bool = False


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object
