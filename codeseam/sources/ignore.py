"""Ignore files of working trees: patterns of every folder, the last match wins."""

from __future__ import annotations

import re
from dataclasses import dataclass


def _body(glob: str) -> str:
    """'*' and '?' stay within a path segment, '**' spans segments."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    test: re.Pattern
    keep: bool
    folders_only: bool


def rules(lines: list[str]) -> list[Rule]:
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip("\r")
        line = line if line.endswith("\\ ") else line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep or line.startswith(("\\!", "\\#")) else line
        folders_only = line.endswith("/")
        glob = line.rstrip("/")
        anchored = "/" in glob
        glob = glob.removeprefix("/")
        if not glob:
            continue
        try:
            test = re.compile(("" if anchored else "(?:.*/)?") + _body(glob))
        except re.error:
            continue
        out.append(Rule(test, keep, folders_only))
    return out


def ignored(chain: list[tuple[str, list[Rule]]], path: str, folder: bool) -> bool:
    """chain: (folder, its rules) from the root down; path: relative to the root."""
    found = False
    for base, own in chain:
        rel = path[len(base) + 1 :] if base else path
        for r in own:
            if (folder or not r.folders_only) and r.test.fullmatch(rel):
                found = not r.keep
    return found
