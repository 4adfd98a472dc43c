"""Reading and changing tables: filters, pages, and DML as queries over snapshots.

Plain Parquet has neither MERGE nor DELETE, so a change is a query that gives the next snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(df: DataFrame, equal: Mapping[str, object] | None = None, since: tuple[str, object] | None = None, until: tuple[str, object] | None = None, search: tuple[list[str], str] | None = None) -> DataFrame:
    """AND of the conditions that are given; falsy values are no condition. `%` and `_` in a search are wildcards."""
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == F.lit(v)) if v else df
    if since and since[1]:
        df = df.filter(F.col(since[0]) >= F.lit(since[1]))
    if until and until[1]:
        df = df.filter(F.col(until[0]) <= F.lit(until[1]))
    if search and search[1]:
        any_of = F.lit(False)
        for c in search[0]:
            any_of = any_of | F.coalesce(F.col(c).ilike(f"%{search[1]}%"), F.lit(False))
        df = df.filter(any_of)
    return df


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """The order must be total: offset and limit over ties would differ from run to run."""
    return df.orderBy(*order).offset(skip).limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both by the latest version of each key; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def merge_fields(df: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Fields of the patch where it has a value; null leaves a field as it is. One patch row a key."""
    fields = [c for c in patch.columns if c != key]
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    out = df.join(new, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def set_fields(df: DataFrame, patch: DataFrame, key: str, present: str = "has_") -> DataFrame:
    """Fields that the patch marks as present, null included: null clears a field."""
    fields = [c for c in patch.columns if c != key and not c.startswith(present)]
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields], *[F.col(f"{present}{c}") for c in fields])
    out = df.join(new, key, "left")
    return out.select(*[F.when(F.coalesce(f"{present}{c}", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def insert_absent(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df and the new rows whose key it hasn't; of new rows with one key, one."""
    return df.unionByName(new.dropDuplicates([key]).join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def with_defaults(keys: DataFrame, df: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """A row for every key: df's, with defaults where it has none."""
    out = keys.select(key).join(df, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def session_rollup(messages: DataFrame, session: str, order: str, text: str, preview: int = 200, title: int = 60) -> DataFrame:
    """Per session: messages, preview of the last, title from the first."""
    return messages.groupBy(session).agg(
        F.count(F.lit(1)).alias("message_count"), F.substring(F.max_by(text, order), 1, preview).alias("last_message_preview"), F.substring(F.min_by(text, order), 1, title).alias("title")
    )


def count_access(df: DataFrame, retrieved: DataFrame, key: str, ids: str) -> DataFrame:
    """Adds to access_count how often each key was retrieved."""
    n = retrieved.select(F.explode(ids).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, key, "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")
