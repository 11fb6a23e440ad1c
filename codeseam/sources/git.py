"""Git sources: clones, branch trees, refs of remotes.  Needs the git program."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions.text import language
from codeseam.operators.refs import choose_branches
from codeseam.sources.tree import BranchSource, git

HOSTS = {"github.com": "GITHUB", "gitlab.com": "GITLAB", "bitbucket.org": "BITBUCKET"}


class CloneError(RuntimeError):
    """A clone that failed for another reason than those below."""


class CloneDenied(CloneError):
    """The remote asks for other credentials."""


class RepoNotFound(CloneError):
    """There is no such repository."""


def with_credentials(url: str, env: dict | None = None) -> str:
    """An https URL of a known host with the user and token that the environment
    names (<HOST>_USERNAME, <HOST>_TOKEN); others as they are.  Never log it."""
    env = os.environ if env is None else env
    parts = urlsplit(url)
    name = HOSTS.get(parts.hostname or "")
    if parts.scheme != "https" or parts.password or not name:
        return url
    user, token = env.get(f"{name}_USERNAME"), env.get(f"{name}_TOKEN")
    if not user or not token:
        return url
    host = parts.netloc.rpartition("@")[2]
    return urlunsplit(parts._replace(netloc=f"{quote(user, safe='')}:{quote(token, safe='')}@{host}"))


def clone_error(said: str) -> CloneError:
    low = said.lower()
    has = lambda *xs: any(x in low for x in xs)
    if has("authentication failed", "permission denied", "could not read username", "could not read password"):
        return CloneDenied(said.strip())
    if has("not found", "does not exist", "does not appear to be", "404"):
        return RepoNotFound(said.strip())
    return CloneDenied(said.strip()) if has("fatal: could not read") else CloneError(said.strip())


def _run(args: list[str]) -> subprocess.CompletedProcess:
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "GIT_SSH_COMMAND": "ssh -o BatchMode=yes", "LC_ALL": "C"}
    return subprocess.run(args, capture_output=True, text=True, env=env)


def clone(url: str, folder: str, depth: int | None = 1, run: Callable = _run) -> str:
    """A clone of ``url`` in ``folder`` (shared by executors, if they are to read it)."""
    how = [] if depth is None else ["--depth", str(depth)]
    done = run(["git", "clone", "--quiet", *how, with_credentials(url), folder])
    if done.returncode:
        raise clone_error(done.stderr)
    return folder


def branches(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """repo, branch, is_head, time of a clone's branches."""
    head = _run(["git", "-C", root, "symbolic-ref", "--short", "-q", "HEAD"]).stdout.strip()
    lines = git(root, "for-each-ref", "--format=%(refname:short)%09%(committerdate:unix)", "refs/heads").splitlines()
    rows = [(repo, name, name == head, int(time)) for name, time in (x.rsplit("\t", 1) for x in lines)]
    return spark.createDataFrame(rows, "repo string, branch string, is_head boolean, time long")


def branch_documents(spark: SparkSession, root: str, repo: str, names: list[str] | None = None, most: int = 1, max_file_size: int = 1_000_000) -> DataFrame:
    """Documents of several branches, one a (branch, file): those named, else HEAD
    and then the newest, ``most`` in all."""
    if names is None:
        names = [r.branch for r in choose_branches(branches(spark, root, repo), most).orderBy("position").collect()]
    spark.dataSource.register(BranchSource)
    out = None
    for b in names:
        rows = spark.read.format(BranchSource.name()).option("branch", b).option("max_file_size", str(max_file_size)).load(root)
        rows = rows.select(
            F.lit(repo).alias("repo"), F.xxhash64(F.lit(repo), F.lit(b), "path").alias("doc_id"), "path", language(F.col("path")).alias("lang"),
            F.array(F.lit(b)).alias("branches"), "content", "size", "is_text",
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no branches")
    return out


REFS = "repo string, url string, kind string, name string, target string, error string"


def remote_refs(registry: DataFrame) -> DataFrame:
    """(name, url) -> repo, url, kind (branch or tag), name, target: what the remotes
    list; a remote that can't be asked is one row with its error.  Runs in tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for repo, url in zip(p["name"], p["url"]):
                done = _run(["git", "ls-remote", "--heads", "--tags", with_credentials(url)])
                if done.returncode:
                    rows.append((repo, url, None, None, None, type(clone_error(done.stderr)).__name__))
                tags = {}
                for line in done.stdout.splitlines() if not done.returncode else ():
                    target, ref = line.split("\t", 1)
                    if ref.startswith("refs/heads/"):
                        rows.append((repo, url, "branch", ref[11:], target, None))
                    elif ref.startswith("refs/tags/"):
                        tags[ref[10:].removesuffix("^{}")] = target  # the commit an annotated tag names comes last
                rows += [(repo, url, "tag", t, target, None) for t, target in tags.items()]
            yield pd.DataFrame(rows, columns=["repo", "url", "kind", "name", "target", "error"])

    return registry.select("name", "url").mapInPandas(run, REFS)
