"""Sinks: entity lines, result lines, registry export, keyed tables, dead letters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeseam.operators.refs import upsert


def entity_lines(entities: DataFrame) -> DataFrame:
    """One JSON object a line (value): every entity, and every method of a class as a
    function of it.  Lines count from 1; a file has lines only if it imports; a
    method without an end is closed by the next method's start."""
    lines = (F.col("kind") != "file") | (F.size("imports") > 0)
    own = entities.select(
        "repo", "path", "lang", "kind", "name", "parent", "signature", F.when(lines, F.col("start_line") + 1).alias("start_line"), F.when(lines, F.col("end_line") + 1).alias("end_line"),
        "doc", "calls", F.expr("transform(imports, i -> struct(i.module AS module, i.line + 1 AS line))").alias("imports"),
    )
    each = entities.select("id", "repo", "path", "lang", F.col("name").alias("parent"), F.posexplode("methods").alias("nth", "m"))
    after = Window.partitionBy("id").orderBy("m.start_line", "nth")
    end = F.coalesce("m.end_line", F.lead("m.start_line").over(after) - 1)
    none = lambda t: F.array().cast(t)
    methods = each.select(
        "repo", "path", "lang", F.lit("function").alias("kind"), "m.name", "parent", "m.signature", (F.col("m.start_line") + 1).alias("start_line"), (end + 1).alias("end_line"),
        F.lit(None).cast("string").alias("doc"), none("array<string>").alias("calls"), none("array<struct<module:string,line:int>>").alias("imports"),
    ).join(entities.filter("kind = 'function' AND parent IS NOT NULL").select("repo", "path", "name", "parent", (F.col("start_line") + 1).alias("start_line")), ["repo", "path", "name", "parent", "start_line"], "left_anti").select(own.columns)
    return own.unionByName(methods).select(F.to_json(F.struct("*")).alias("value"))


def result_lines(results: DataFrame, as_json: bool = False) -> DataFrame:
    """Search results or hits as lines (value): JSON objects, or repo/path[:line][: text]."""
    if as_json:
        return results.select(F.to_json(F.struct("*")).alias("value"))
    has = lambda c: c in results.columns
    line = F.coalesce(F.concat(F.lit(":"), F.col("line" if has("line") else "symbol_line").cast("string")), F.lit("")) if has("line") or has("symbol_line") else F.lit("")
    said = F.col("line_text") if has("line_text") else F.col("symbol") if has("symbol") else F.lit(None).cast("string")
    return results.select(F.concat(F.concat_ws("/", "repo", "path"), line, F.coalesce(F.concat(F.lit(": "), said), F.lit(""))).alias("value"))


def export_registry(registry: DataFrame, branches: DataFrame, path: str) -> None:
    """A quoted CSV of the registry; branch_details: 'branch commit' joined by '; '."""
    b = branches.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "branch", "last_commit_sha"))), "; ").alias("branch_details"))
    registry.join(b, "name", "left").write.mode("overwrite").csv(path, header=True, quoteAll=True)


# keyed tables


class Store:
    """A folder by its URI, through the cluster's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm, self.root = spark._jvm, root.rstrip("/")
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = jvm

    def latest(self) -> int:
        """Number of the last manifest, 0 for none."""
        if not self.fs.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self, n: int) -> dict:
        if not n:
            return {"parts": {}, "schema": None, "width": 0}
        stream = self.fs.open(self._path(f"{self.root}/manifest-{n}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, n: int, manifest: dict) -> bool:
        """Whether ours became manifest n: another writer's may be there already."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(self._path(f"{self.root}/manifest-{n}.json"), False)
        except Py4JJavaError:
            return False
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True


def merge_table(spark: SparkSession, path: str, rows: DataFrame, key: list[str], order: str, width: int = 16, attempts: int = 5) -> None:
    """Keyed upsert: of each key the row that is last by ``order``.  Rows lie in
    ``width`` parts by a hash of the key; only the parts that ``rows`` touch are
    read and written anew, then named in the next manifest.  That file is created
    by one writer only; another one, who comes too late, merges again.  The same
    rows once more change nothing."""
    import uuid

    store = Store(spark, path)
    for _ in range(attempts):
        n = store.latest()
        now = store.manifest(n)
        parts = now["width"] or width
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("__part")
        new = rows.withColumn("__part", part)
        touched = [r[0] for r in new.select("__part").distinct().collect()]  # at most ``width``
        if not touched and n:
            return
        files = [now["parts"][str(p)] for p in touched if str(p) in now["parts"]]
        old = spark.read.schema(now["schema"]).parquet(*files) if files else rows.limit(0)
        merged = upsert(old, rows, key, order)
        folder = f"{store.root}/data/{n + 1}-{uuid.uuid4().hex[:8]}"
        merged.withColumn("__part", part).repartition(max(1, len(touched)), "__part").write.partitionBy("__part").parquet(folder)
        made = {str(p): f"{folder}/__part={p}" for p in touched}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
        if store.commit(n + 1, {"parts": now["parts"] | made, "schema": schema, "width": parts}):
            return
    raise RuntimeError(f"{path}: other writers were faster {attempts} times")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    store = Store(spark, path)
    now = store.manifest(store.latest())
    if now["schema"] is None:
        raise ValueError(f"no table at {path}")
    return spark.read.schema(now["schema"]).parquet(*now["parts"].values()) if now["parts"] else spark.createDataFrame([], now["schema"])


def table_exists(spark: SparkSession, path: str) -> bool:
    return Store(spark, path).latest() > 0


def dead_letters(rows: DataFrame, reason: str, path: str) -> None:
    """Appends id, reason, length and head of what could not be processed."""
    rows.select("id", F.lit(reason).alias("reason"), F.length("body").alias("length"), F.left("body", F.lit(200)).alias("head")).write.mode("append").json(path)
