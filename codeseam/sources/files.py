"""Sources: working trees, registries, queues of events."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeseam.functions.text import language
from codeseam.sources.tree import TreeSource


@dataclass(frozen=True)
class WalkOptions:
    max_file_size: int = 1_000_000
    follow_symlinks: bool = False
    include_hidden: bool = False
    include_regex: str | None = None
    exclude_regex: str | None = None
    branches: tuple[str, ...] | None = None  # of a clone; None: the tree as it lies
    max_branches: int = 1
    symbols: bool = True


def working_tree(spark: SparkSession, root: str, repo: str | None = None, options: WalkOptions = WalkOptions()) -> DataFrame:
    """repo, doc_id, path, lang, branches, content, size, is_text of a tree's files.

    Ignore files of all folders hold; hidden files and links are left out unless
    asked for; size and path are tested before any content is read.  Content is
    decoded with replacement; empty files are binary, binary ones have none.
    With ``branches``, or more than one branch, the branches of a clone instead.
    """
    from codeseam.sources.git import branch_documents

    root = os.path.abspath(root)
    name = repo or os.path.basename(root).removesuffix(".git")
    if options.branches is not None or options.max_branches > 1:
        return branch_documents(spark, root, name, list(options.branches) if options.branches else None, options.max_branches, options.max_file_size)
    spark.dataSource.register(TreeSource)
    said = {"include_hidden": options.include_hidden, "follow_symlinks": options.follow_symlinks}
    reader = spark.read.format(TreeSource.name()).options(**{k: str(v).lower() for k, v in said.items()}).option("max_file_size", str(options.max_file_size))
    for k in ("include_regex", "exclude_regex"):
        if getattr(options, k):
            reader = reader.option(k, getattr(options, k))
    return reader.load(root).select(
        F.lit(name).alias("repo"), F.xxhash64(F.lit(name), "path").alias("doc_id"), "path", language(F.col("path")).alias("lang"),
        F.array(F.lit("HEAD")).alias("branches"), "content", "size", "is_text",
    )


def tree_and_symbols(spark: SparkSession, root: str, repo: str | None = None, options: WalkOptions = WalkOptions()) -> tuple[DataFrame, DataFrame]:
    """The documents of a tree and the symbols of its text files (none where the
    options say so), as ``index.write_index`` takes them."""
    from codeseam.operators.extract import symbols

    docs = working_tree(spark, root, repo, options)
    found = symbols(docs.filter("is_text"))
    return docs, found if options.symbols else found.limit(0)


def as_documents(table: DataFrame) -> DataFrame:
    """A corpus (doc_id, text, lang, source) as searchable documents."""
    return table.select(F.col("source").alias("repo"), "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "lang", F.array(F.lit("main")).alias("branches"), F.col("text").alias("content"))


REGISTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "url", "branches", "frequency", "_bad")])


def registry_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """name,url[,branches[,frequency]] lines; '#' comments.  (rows, errors)."""
    raw = spark.read.schema(REGISTRY).csv(path, comment="#", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).cache()
    raw = raw.filter(~((F.lower("name") == "name") & (F.lower("url") == "url")))
    freq = F.expr("try_cast(frequency AS int)")
    ok = F.col("name").isNotNull() & F.col("url").isNotNull() & (F.col("frequency").isNull() | freq.isNotNull())
    return raw.filter(ok).select("name", "url", F.coalesce("branches", F.lit("main")).alias("branches"), freq.alias("frequency")), raw.filter(~ok).select("name", "url", F.lit("a line needs name and url, and a whole number as its frequency").alias("error"))


EVENT = "event_type string, repo_name string, git_url string, branch string, node_id string, timestamp long, last_commit_sha string, last_indexed_at string"


def event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON events from a folder of lines; malformed ones drop out."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    e = raw.select(F.from_json("value", EVENT).alias("e")).select("e.*").filter("event_type IS NOT NULL AND repo_name IS NOT NULL")
    return e.withColumn("ts", F.timestamp_millis("timestamp"))


def embedding_response(df: DataFrame, column: str = "body") -> DataFrame:
    """The vectors of either response form: [[...]] or {data: [{embedding}], model}."""
    plain = F.from_json(column, "array<array<double>>")
    rich = F.from_json(column, "data array<struct<embedding: array<double>>>, model string")
    return df.withColumn("embeddings", F.coalesce(F.when(F.size(plain) > 0, plain), F.transform(rich["data"], lambda d: d["embedding"]))).withColumn("model", rich["model"])
