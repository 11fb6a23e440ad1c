"""Event streams: ingestion, deduplication, windows, leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Routes each micro-batch by event_type; progress is kept only after its
    handlers return, so a failed batch is done again (handlers must be idempotent)."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for kind, handle in handlers.items():
            rows = batch.filter(F.col("event_type") == kind)
            if not rows.isEmpty():
                handle(rows, epoch)
        batch.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, window, n: runs of events of a key without a pause of ``gap`` (an
    extension: the queues this follows have no notion of it)."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n"))


def last_state(events: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Last-write-wins rows by (ts, event_id)."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("s")).select(*key, "s.*")


def changed_commits(events: DataFrame) -> DataFrame:
    """Events whose commit differs from the one before of the same repo and branch."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo_name", "branch").orderBy("ts", "event_id")
    old = events.withColumn("__old", F.lag("last_commit_sha").over(w))
    return old.filter(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.col("last_commit_sha"))).drop("__old")


def lease_steps(state: tuple[str, float] | None, rows: list[tuple[float, str, str, float]]) -> tuple[tuple[str, float] | None, list[tuple]]:
    """(time, action, holder, ttl) in order of time -> new state (holder, until),
    and (time, action, holder, granted) of each: acquire is granted to the holder
    itself or when no lease runs; renew and release to the holder only."""
    out = []
    for t, action, holder, ttl in sorted(rows):
        if state and state[1] <= t:
            state = None
        if action == "acquire":
            ok = state is None or state[0] == holder
        else:
            ok = state is not None and state[0] == holder
        if ok:
            state = None if action == "release" else (holder, t + ttl)
        out.append((t, action, holder, ok))
    return state, out


LEASE_OUT = "repo string, time double, action string, holder string, granted boolean"


def leases(requests: DataFrame) -> DataFrame:
    """(repo, time, action, holder, ttl) as a batch, all requests of a repo in order.
    A task goes through its rows in the order of (repo, time) and keeps the lease
    that runs, so a repository of any length needs no more memory than a batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, state = None, None
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                if r.repo != repo:
                    repo, state = r.repo, None
                state, one = lease_steps(state, [(r.time, r.action, r.holder, r.ttl)])
                out.append((repo, *one[0]))
            yield pd.DataFrame(out, columns=["repo", "time", "action", "holder", "granted"])

    order = ["repo", "time", "action", "holder", "ttl"]
    return requests.select(*order).repartition("repo").sortWithinPartitions(*order).mapInPandas(run, LEASE_OUT)


def lease_stream(requests: DataFrame) -> DataFrame:
    """The same over a stream, the lease of each repo kept as state that expires."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = [r for p in parts for r in zip(p["time"], p["action"], p["holder"], p["ttl"])]
        now, out = lease_steps(now, rows)
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update(now)
            state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["repo", "time", "action", "holder", "granted"])

    return requests.groupBy("repo").applyInPandasWithState(run, LEASE_OUT, "holder string, until double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def healthy(beats: DataFrame, now, max_age_seconds: int) -> DataFrame:
    """(node_id, ts) -> node_id, healthy: whether its last beat is young enough."""
    last = beats.groupBy("node_id").agg(F.max("ts").alias("last"))
    return last.select("node_id", (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") <= max_age_seconds).alias("healthy"))
