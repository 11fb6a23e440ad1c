"""The shared folder, input helpers and small utilities of the llm operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def shared_uri(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it in
    ``spark.checkpoint.dir``; where that is unset (tests, one machine) a folder
    of our own is made and set for the session."""
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="codeseam-")
        spark.conf.set("spark.checkpoint.dir", uri)
    return uri.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one as a POSIX path, for files that
    workers map into memory.  The shared folder must be mounted on executors."""
    uri = shared_uri(spark)
    if "://" in uri and not uri.startswith("file://"):
        raise RuntimeError(f"memory-mapped files need a mounted shared folder, not {uri}")
    path = os.path.join(uri.removeprefix("file://"), f"{name}-{uuid.uuid4().hex[:12]}")
    os.makedirs(path, exist_ok=True)
    _on_exit(spark, f"file://{path}")
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage with
    files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_uri(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _on_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def _on_exit(spark: SparkSession, uri: str) -> None:
    """Has the folder removed when the driver ends (an ended driver's results are
    elsewhere; one that is killed leaves it behind)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def write_atomic(path: str, data) -> None:
    """Write bytes or an array so that a retried task leaves one whole file."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(memoryview(data).cast("B") if not isinstance(data, bytes) else data)
    os.replace(tmp, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids: of the empty text)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def input_bytes(df: DataFrame) -> int:
    """What the optimiser takes ``df`` to read: for files their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_width(df: DataFrame, bytes_each: int = 8 << 20, most: int = 1 << 17) -> int:
    """Partitions by the size of what ``df`` scans, at least one a core; as many as
    the session asks for where the size isn't known (a table not read from files)."""
    spark, size = df.sparkSession, input_bytes(df)
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(size // bytes_each, most), 1)
