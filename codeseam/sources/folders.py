"""The folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_uri(spark: SparkSession) -> str:
    """As the cluster names it in ``spark.checkpoint.dir``; where that is unset, on
    one machine only, a folder of our own, set for the session."""
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="codeseam-")
        spark.conf.set("spark.checkpoint.dir", uri)
    return uri.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder below it that is in nobody's use; it goes when the driver ends."""
    uri = f"{shared_uri(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def mounted(spark: SparkSession, name: str) -> str:
    """Such a folder as a path that workers open files in."""
    uri = fresh(spark, name)
    if "://" in uri and not uri.startswith("file://"):
        raise RuntimeError(f"files that workers map need a mounted shared folder, not {uri}")
    path = uri.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written there and read back: its lineage is cut, with files that
    outlive executors."""
    uri = fresh(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
