"""Queues and jobs: publishing, micro-batch writers, retries, workers, polling,
heartbeats.  A queue is a folder of JSON lines that a stream follows; a job is
done when its micro-batch is committed, so a lost one is done again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from codeseam.functions.text import owner_of
from codeseam.operators import cluster, relations, similarity
from codeseam.operators.refs import top_tags
from codeseam.sources.sinks import dead_letters, merge_table, read_table


def publish(events: DataFrame, path: str) -> None:
    """Appends events to a queue's folder, a JSON line each."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def with_retries(handle: Callable[[DataFrame], None], letters: str | None = None, attempts: int = 3, key: str = "id", smallest: int = 1) -> Callable[[DataFrame], None]:
    """A handler that is tried again; a batch that fails ``attempts`` times is split
    in halves by a hash of its key, down to ``smallest`` rows, and what still
    fails goes to the dead letters (id, body), or is raised where there are none."""

    def run(rows: DataFrame, depth: int = 0) -> None:
        for n in range(attempts):
            try:
                return handle(rows)
            except Exception as e:  # whatever a handler does
                why = e
        if depth < 30 and rows.limit(smallest + 1).count() > smallest:
            half = F.pmod(F.shiftright(F.xxhash64(F.col(key).cast("string")), depth), F.lit(2))
            for k in (0, 1):
                part = rows.filter(half == k)
                if not part.isEmpty():
                    run(part, depth + 1)
            return None
        if letters is None:
            raise why
        body = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
        dead_letters(rows.select(F.col(key).cast("string").alias("id"), body.alias("body")), f"{type(why).__name__}: {why}"[:200], letters)
        return None

    return run


def writer(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, letters: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Upserts a stream into a keyed table, a micro-batch at a time (all there is,
    or every ``interval``); the same batch again changes nothing."""
    put = with_retries(lambda rows: merge_table(rows.sparkSession, path, rows, key, order), letters, key=key[0])
    sink = stream.writeStream.foreachBatch(lambda batch, _: put(batch)).option("checkpointLocation", checkpoint)
    return (sink.trigger(processingTime=interval) if interval else sink.trigger(availableNow=True)).start()


# jobs of (repo, commit)


def similarity_job(spark: SparkSession, root: str, branch_refs: Callable[[], DataFrame], least_chars: int = 256, **options) -> Callable[[DataFrame, int], None]:
    """For the repositories of a batch: similarity edges within them and to others
    at default branches, from the snapshots with vectors below ``root`` (texts
    below ``least_chars`` take no part), merged into root/similar."""
    from codeseam.operators.pages import default_commits, on_default_branch

    def run(batch: DataFrame, epoch: int) -> None:
        snaps = read_table(spark, f"{root}/embedding").filter(F.col("n_chars") >= least_chars)
        jobs = batch.select("repo", "commit").distinct()
        mine = snaps.join(jobs, ["repo", "commit"], "left_semi")
        repos = read_table(spark, f"{root}/repo").select("repo", "branch")
        others = on_default_branch(snaps, default_commits(branch_refs(), repos))
        same = similarity.similar_edges(mine, "same", **options)
        both = mine.unionByName(others.join(jobs.select("repo").distinct(), "repo", "left_anti")).dropDuplicates(["stable_id"])
        found = same.unionByName(similarity.similar_edges(both, "external", **options))
        merge_table(spark, f"{root}/similar", found.withColumn("epoch", F.lit(epoch)), ["src", "dst", "scope"], "epoch")

    return run


def cluster_job(spark: SparkSession, root: str, k: int = 0) -> Callable[[DataFrame, int], None]:
    """For each repository of a batch: its cluster layers, merged into root/cluster."""

    def run(batch: DataFrame, epoch: int) -> None:
        for r in batch.select("repo").distinct().collect():  # the repositories of a micro-batch
            rows = read_table(spark, f"{root}/embedding").filter(F.col("repo") == r.repo)
            if not rows.isEmpty():
                merge_table(spark, f"{root}/cluster", cluster.layers(rows, k, repo=r.repo).withColumn("epoch", F.lit(epoch)), ["stable_id"], "epoch")

    return run


def embedding_job(spark: SparkSession, root: str, embed: Callable[[list[str]], list[list[float]]], batch_rows: int = 100, batch_bytes: int = 80_000, limit: int = 8192, overlap: int = 256) -> Callable[[DataFrame, int], None]:
    """Vectors of the batch's snapshots, merged into root/embedding: long texts are
    windows whose mean counts; what couldn't be embedded goes to root/letters."""

    def run(batch: DataFrame, epoch: int) -> None:
        jobs = batch.select("repo", "commit").distinct()
        snaps = read_table(spark, f"{root}/snapshot").join(jobs, ["repo", "commit"], "left_semi").filter("source_content IS NOT NULL")
        made = embedded(similarity.chunk_windows(snaps.select("stable_id", F.col("source_content").alias("text")), limit, overlap), embed, batch_rows, batch_bytes)
        means = similarity.chunk_mean(made)
        done = snaps.select("stable_id", "repo", "commit", F.length("source_content").alias("n_chars")).join(means.filter("embedding IS NOT NULL"), "stable_id")
        merge_table(spark, f"{root}/embedding", done.withColumn("epoch", F.lit(epoch)), ["stable_id"], "epoch")
        lost = made.filter("embedding IS NULL").select(F.concat_ws("#", "stable_id", "chunk").alias("id"), F.array_join("words", " ").alias("body"))
        if not lost.isEmpty():
            dead_letters(lost, "not embedded", f"{root}/letters")

    return run


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch_rows: int = 100, batch_bytes: int = 80_000) -> DataFrame:
    """(stable_id, chunk, words) with embedding: texts go to ``embed`` in groups of
    at most so many rows and bytes; a group that fails is split, a single text
    that fails has none."""
    kind = chunks.schema["stable_id"].dataType.simpleString()

    def ask(texts: list[str]) -> list:
        try:
            return list(embed(texts))
        except Exception:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return ask(texts[:half]) + ask(texts[half:])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, out, at = [" ".join(w) for w in p["words"]], [], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at].encode())
                while end < len(texts) and end - at < batch_rows and size + len(texts[end].encode()) <= batch_bytes:
                    size += len(texts[end].encode())
                    end += 1
                out += ask(texts[at:end])
                at = end
            yield p.assign(embedding=out)[["stable_id", "chunk", "words", "embedding"]]

    return chunks.select("stable_id", "chunk", "words").mapInPandas(run, f"stable_id {kind}, chunk int, words array<string>, embedding array<double>")


def sbom_job(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """Bills of materials of a batch (repo, commit, json, at) into keyed tables."""

    def run(batch: DataFrame, epoch: int) -> None:
        relations.persist(spark, root, relations.sbom_tables(batch.select("repo", "commit", "json", "at")), batch.agg(F.max("at")).first()[0])

    return run


# polling and heartbeats


def _any_of(column: Column, patterns: Column) -> Column:
    """Whether any pattern of the array (globs whole, regexes anywhere) fits."""
    glob = lambda p: F.rlike(column, F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"([.+^$(){}|\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$")))
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.when(p.rlike(r"[*?\[]"), glob(p)).otherwise(F.rlike(column, p)))


def poll(builders: DataFrame, remote: DataFrame) -> DataFrame:
    """builders (id, base_repo, include_/exclude_ branches, tags, owner: arrays,
    default_branch, max_tags) x remote (url, kind, name, target): the refs each one
    follows: entry 'builder::<id>|<ref>', base_repo, origin_builder, ref, kind,
    default_branch.  Excluding wins, no include pattern includes all; of tags the
    newest max_tags."""
    refs = remote.filter("name IS NOT NULL").select("url", "kind", F.col("name").alias("ref"))
    b = builders.filter("base_repo <> ''").withColumn("owner", F.coalesce(owner_of(F.col("base_repo")), F.lit("")))
    rows = b.join(refs, b.base_repo == refs.url)

    def passes(column: str, kind: str) -> Column:
        inc, exc = F.col(f"include_{kind}"), F.col(f"exclude_{kind}")
        return ~_any_of(F.col(column), exc) & ((F.coalesce(F.size(inc), F.lit(0)) <= 0) | _any_of(F.col(column), inc))

    fit = F.when(F.col("kind") == "branch", passes("ref", "branches")).otherwise(passes("ref", "tags"))
    rows = rows.filter(passes("owner", "owner") & fit)
    most = F.coalesce("max_tags", F.lit(200))
    tags = top_tags(rows.filter("kind = 'tag'").select(F.col("id").alias("repo"), F.col("ref").alias("tag")), 1 << 30)
    count = Window.partitionBy("repo")
    kept = tags.withColumn("n", F.count("*").over(count)).join(builders.select(F.col("id").alias("repo"), most.alias("most")), "repo").filter(F.col("position") > F.col("n") - F.col("most"))
    rows = rows.filter("kind = 'branch'").unionByName(rows.filter("kind = 'tag'").join(kept.select(F.col("repo").alias("id"), F.col("tag").alias("ref")), ["id", "ref"], "left_semi").select(rows.columns))
    return rows.select(F.concat(F.lit("builder::"), "id", F.lit("|"), "ref").alias("entry"), "base_repo", F.col("id").alias("origin_builder"), "ref", "kind", F.coalesce("default_branch", F.lit("main")).alias("default_branch"))


def without_orphans(entries: DataFrame, builders: DataFrame) -> DataFrame:
    """Branch entries but those of builders that are gone."""
    of = F.regexp_extract("entry", r"^builder::([^|]*)\|", 1)
    known = builders.select(F.col("id").alias("__id"))
    return entries.withColumn("__id", of).join(known.withColumn("__known", F.lit(True)), "__id", "left").filter("__id = '' OR __known").drop("__id", "__known")


def heartbeat(node: str, indexed: DataFrame, registered: DataFrame, leases: DataFrame, now, most: int = 1) -> DataFrame:
    """What a node does at its beat: action (remove, renew, acquire), repo, branch.
    Indexes of repositories that are not registered go, own leases are renewed,
    and at most ``most`` registered branches without a lease are asked for."""
    live = leases.filter(F.col("until") > now)
    none = F.lit(None).cast("string").alias("branch")
    gone = indexed.select("repo").distinct().join(registered.select("repo"), "repo", "left_anti").select(F.lit("remove").alias("action"), "repo", none)
    own = live.filter(F.col("holder") == node).join(registered.select("repo", "branch"), ["repo", "branch"], "left_semi").select(F.lit("renew").alias("action"), "repo", "branch")
    free = registered.select("repo", "branch").distinct().join(live, ["repo", "branch"], "left_anti").orderBy("repo", "branch").limit(most).select(F.lit("acquire").alias("action"), "repo", "branch")
    return reduce(DataFrame.unionByName, [gone, own, free])


class Counters(StreamingQueryListener):
    """Counts what streams of a session did: add it by spark.streams.addListener."""

    def __init__(self) -> None:
        self.batches = self.rows = self.failures = 0
        self.observed: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        for name, row in (event.progress.observedMetrics or {}).items():
            self.observed[name] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None

    def lines(self) -> str:
        """As a metrics page says it."""
        return "".join(f"codeseam_{k} {getattr(self, k)}\n" for k in ("batches", "rows", "failures"))


__all__ = ["Counters", "cluster_job", "embedded", "embedding_job", "heartbeat", "poll", "publish", "sbom_job", "similarity_job", "with_retries", "without_orphans", "writer"]
