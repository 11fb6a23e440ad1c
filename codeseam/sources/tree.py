"""A data source of working trees and one of git branches.

Planning lists names and sizes only (on the driver); content is read by tasks, in
partitions of about ``BYTES``.  Both give (path, size, is_text, content); content is
decoded with replacement, '' for empty files and null for binary ones.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeseam.sources.ignore import ignored, rules

BYTES = 16 << 20
SCHEMA = "path string, size long, is_text boolean, content string"


def looks_like_text(b: bytes) -> bool:
    """No NUL, and under 30 % control bytes of the first 4096; empty is binary."""
    head = b[:4096]
    bad = sum(c < 32 and c not in b"\t\n\r\x0c" and c != 0 for c in head)
    return bool(b) and 0 not in b and bad < 0.3 * len(head)


def _row(path: str, b: bytes) -> tuple:
    text = looks_like_text(b)
    return path, len(b), text, b.decode("utf-8", "replace") if text or not b else None


@dataclass
class Group(InputPartition):
    items: list


def _groups(found: list[tuple[str, int]]) -> list[Group]:
    """(item, bytes) in order -> partitions of about BYTES."""
    out, size = [Group([])], 0
    for item, n in found:
        if size + n > BYTES and out[-1].items:
            out.append(Group([]))
            size = 0
        out[-1].items.append(item)
        size += n
    return out


def _ignore_lines(folder: str) -> list[str]:
    try:
        with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []


def walk(root: str, options: dict) -> list[tuple[str, int]]:
    """(relative path, size) of the tree's files, in order of path."""
    hidden = options.get("include_hidden", "false") == "true"
    links = options.get("follow_symlinks", "false") == "true"
    most = int(options.get("max_file_size", 1_000_000))
    inc, exc = (re.compile(options[k]) if options.get(k) else None for k in ("include_regex", "exclude_regex"))
    out: list[tuple[str, int]] = []
    seen: set[str] = set()

    def visit(rel: str, chain: list) -> None:
        folder = os.path.join(root, rel) if rel else root
        real = os.path.realpath(folder)
        if real in seen:  # a link that leads back
            return
        seen.add(real)
        chain = [*chain, (rel, rules(_ignore_lines(folder)))]
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{rel}/{e.name}" if rel else e.name
            if e.name == ".git" or (e.name.startswith(".") and not hidden) or (e.is_symlink() and not links):
                continue
            if e.is_dir(follow_symlinks=links):
                if not ignored(chain, path, True):
                    visit(path, chain)
            elif e.is_file(follow_symlinks=links) and not ignored(chain, path, False):
                size = e.stat(follow_symlinks=links).st_size
                if size <= most and (inc is None or inc.search(path)) and (exc is None or not exc.search(path)):
                    out.append((path, size))

    visit("", [])
    return out


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.root = options, options["path"]

    def partitions(self) -> list[Group]:
        return _groups(walk(self.root, self.options))

    def read(self, partition: Group) -> Iterator[tuple]:
        for path in partition.items:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield _row(path, f.read())
            except FileNotFoundError:  # gone since the listing
                continue


class TreeSource(DataSource):
    """Options: path, include_hidden, follow_symlinks, max_file_size, include_regex,
    exclude_regex.  The path must be mounted on executors."""

    @classmethod
    def name(cls) -> str:
        return "codeseam_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def git(root: str, *args: str, text: bool = True):
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=text, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"}).stdout


class BranchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.root = options, options["path"]

    def partitions(self) -> list[Group]:
        most = int(self.options.get("max_file_size", 1_000_000))
        out = git(self.root, "ls-tree", "-r", "-l", "-z", self.options["branch"])
        found = []
        for line in filter(None, out.split("\0")):
            meta, path = line.split("\t", 1)
            _, kind, sha, size = meta.split()
            if kind == "blob" and int(size) <= most:
                found.append(((sha, path), int(size)))
        return _groups(found)

    def read(self, partition: Group) -> Iterator[tuple]:
        if not partition.items:
            return
        p = subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for sha, path in partition.items:
                p.stdin.write(f"{sha}\n".encode())
                p.stdin.flush()
                size = int(p.stdout.readline().split()[2])
                b = p.stdout.read(size)
                p.stdout.read(1)
                yield _row(path, b)
        finally:
            p.stdin.close()
            p.stdout.close()
            p.wait()


class BranchSource(DataSource):
    """Options: path (a clone that executors can read), branch, max_file_size.
    Blobs come from the object store, nothing is checked out."""

    @classmethod
    def name(cls) -> str:
        return "codeseam_branch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BranchReader:
        return BranchReader(dict(self.options))
