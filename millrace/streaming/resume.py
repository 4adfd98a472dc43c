"""Sinks that can be run again: what a micro-batch has written once it doesn't write a second time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import resume
from ..sources.files import exists


def keyed_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose key the output doesn't hold yet, one row a key. The output is the state:
    a batch that is replayed after a failure, or a job that starts anew without its checkpoint, adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        if exists(batch.sparkSession, path):
            rows = resume(rows, batch.sparkSession.read.schema(batch.schema).parquet(path), key)
        rows.write.mode("append").parquet(path)

    return write


def lines_sink(path: str, prefix: str, log: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends JSON lines and logs how many there were. The file is best effort, as the log has the
    count whether or not it could be written."""

    def write(batch: DataFrame, number: int) -> None:
        n = batch.agg(F.count(F.lit(1))).first()[0]
        try:
            batch.write.mode("append").option("ignoreNullFields", False).json(path)
            log(f"{prefix} batch {number}: {n} rows")
        except Exception as e:  # whatever the file system raises
            log(f"{prefix} batch {number}: {n} rows not written: {type(e).__name__}")

    return write
