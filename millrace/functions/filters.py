"""Pre-filters for joins whose size doesn't grow with the number of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key filter has this many rows of 64 bits at most, however many keys there are.
FILTER_ROWS = 1 << 18


def cell(keys: list[Column]) -> tuple[Column, Column]:
    """Row of a filter that a key belongs to, and the key's bit there."""
    h = F.xxhash64(*keys)
    return F.shiftrightunsigned(h, 64 - (FILTER_ROWS.bit_length() - 1)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def key_filter(keys: DataFrame, *names: str) -> DataFrame:
    """The hashed keys as FILTER_ROWS * 64 bits, for broadcast: its size doesn't grow with the number of keys."""
    row, bit = cell([F.col(n) for n in names])
    return F.broadcast(keys.select(row.alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits")))


def passing(df: DataFrame, held: DataFrame, *keys: Column) -> DataFrame:
    """Rows of df whose key may be in the filter; all that are in it, and some that aren't."""
    row, bit = cell(list(keys))
    return df.withColumn("_cell", row).withColumn("_bit", bit).join(held, "_cell").filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_cell", "_bit", "_bits")
