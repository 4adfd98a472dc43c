"""What the operators of this folder share: the shared work folder, staged tables, bounded pre-filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import cell as _cell
from ..functions.filters import key_filter, passing  # noqa: F401
from ..functions.staging import discard, staged, work_dir  # noqa: F401

#: ASCII white space as the contracts define it, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Bounds the Arrow batches that reach Python, as one text can be very long; the session's settings come back. Holds
    for what is written inside, not for what is lazily returned."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged_small(df: DataFrame, name: str = "stage", rows: int = 256) -> DataFrame:
    """staged, with small Arrow batches on the way."""
    with small_batches(df.sparkSession, rows):
        return staged(df, name)


def give_back() -> None:
    """Executors count the memory that malloc keeps in their Python workers; only glibc has this call."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """run, for mapInArrow; when a task ends and what it held is free, the worker, which lives on, gives that back."""

    def through(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return through


def released_group(run: Callable) -> Callable:
    """run, for applyInArrow, in the same way."""

    def through(table):
        out = run(table)
        give_back()
        return out

    return through


def shrink_heaps(spark: SparkSession) -> None:
    """Collects garbage in every executor: a heap keeps the size that the last stage's garbage gave it, beside which the
    Python workers of the next one have no room. After a full collection the JVM gives back what it doesn't hold."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def boxed(df: DataFrame, **extra: Column) -> DataFrame:
    """df's columns in the struct `_row`, and extra columns beside it: names can't clash with those of the input."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(row, *[c.alias(k) for k, c in extra.items()])


def unboxed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def without(df: DataFrame, keys: DataFrame, **on: Column) -> DataFrame:
    """df without the rows whose key is in keys. on: names of keys' columns and what they are held against in df. Only
    rows that may have such a key are shuffled. Rows with a null in the key stay."""
    names = list(on)
    keys = keys.select(*names).na.drop()
    row, bit = _cell([F.col(f"_k_{n}") for n in names])
    marked = boxed(df, **{f"_k_{n}": c for n, c in on.items()}).withColumn("_cell", row).withColumn("_bit", bit).join(key_filter(keys, *names), "_cell", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    gone = keys.distinct().select(*[F.col(n).alias(f"_k_{n}") for n in names])
    rest = marked.filter(maybe).join(gone, [f"_k_{n}" for n in names], "left_anti")
    return unboxed(marked.filter(~maybe).select("_row").unionByName(rest.select("_row")), df.columns)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
