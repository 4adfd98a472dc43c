"""Intermediate tables in the work folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only where that is unset and everything runs in this one process, as in
    tests, it is a machine-local one; on a cluster that would lose rows, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
        base = _local[0]
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut there, and no executor's loss can undo it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables once everything that was made of them is staged itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)
