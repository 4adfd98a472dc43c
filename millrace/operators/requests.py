"""What single requests ask of the tables, over all users at once: new and changed memories, sessions, lists, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import top
from .tables import merge_fields, where

#: Fields of an answer that stay inside, and the word that marks a value as internal.
INTERNAL_FIELDS = ("provider", "complexity", "sentiment", "degraded", "llm_backend", "latency_ms", "message_id")
INTERNAL_WORD = "heuristic"


def embed_text(title: Column, content: Column) -> Column:
    """What a memory's vector is made of: the whole title, as it says most about the topic, and the content."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), F.coalesce(content, F.lit("")))).otherwise(content)


def new_memories(rows: DataFrame, title: int = 255, importance: tuple[int, int] = (1, 10)) -> DataFrame:
    """rows (title, content, importance, tags, ...) as they are stored: title cut, importance clamped, no tags instead
    of null ones, `embed_text` of the uncut title, and not embedded yet."""
    low, high = importance
    return rows.select(
        *[c for c in rows.columns if c not in ("title", "importance", "tags")], F.substring("title", 1, title).alias("title"), F.greatest(F.lit(low), F.least(F.lit(high), F.col("importance").cast("int"))).alias("importance"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), embed_text(F.col("title"), F.col("content")).alias("embed_text"), F.lit(False).alias("embedded"),
    )


def payload(memories: DataFrame, now: Column) -> DataFrame:
    """The fields that go with a vector, with defaults for what is missing; the date as ISO text."""
    created = F.coalesce(F.col("created_date"), now)
    return memories.select(
        "user_id", F.col("id").alias("memory_id"), "title", "content", "source", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "importance", "user_priority",
        F.coalesce("access_count", F.lit(0).cast("long")).alias("access_count"), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"),
    )


def search_results(hits: DataFrame) -> DataFrame:
    """Eight fields of hits (id, score, payload struct); a hit without a payload has nulls, without a score 0."""
    fields = [F.col(f"payload.{c}").alias(c) for c in ("title", "content", "topic", "importance", "user_priority", "source")]
    return hits.select(*[c for c in hits.columns if c not in ("id", "score", "payload")], "id", F.coalesce("score", F.lit(0.0)).alias("score"), *fields)


def visible(asked: DataFrame, rows: DataFrame, key: str, owner: str = "user_id") -> DataFrame:
    """rows that requests (key, owner) may see: another owner's row is as if it weren't there; a null owner sees all."""
    by = asked.select(key, F.col(owner).alias("_asker"))
    return rows.join(by, key).filter(F.col("_asker").isNull() | (F.col("_asker") == F.col(owner))).drop("_asker")


def update_memories(df: DataFrame, patch: DataFrame, key: str, embedded: Sequence[str] = ("title", "content")) -> DataFrame:
    """df with the patch's values (null leaves a field as it is) and `needs_embed`: a field that the vector is made of
    has another value now."""
    changed = [c for c in embedded if c in patch.columns]
    before = merge_fields(df.select("*", *[F.col(c).alias(f"_old_{c}") for c in changed]), patch, key)
    needs = F.lit(False)
    for c in changed:
        needs = needs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return before.withColumn("needs_embed", needs).drop(*[f"_old_{c}" for c in changed])


def orphans(memories: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Memories without a vector, with the text to embed."""
    return memories.join(vectors.select(key).distinct(), key, "left_anti").select(key, embed_text(F.col("title"), F.col("content")).alias("embed_text"))


def open_sessions(asked: DataFrame, sessions: DataFrame, fresh: Column) -> DataFrame:
    """asked (session, ...) with the session that it goes on in: the given one where it exists, whoever owns it, else
    `fresh`, and whether it is `created`."""
    known = sessions.select(F.col("session").alias("_known")).distinct()
    out = asked.join(known, F.col("session") == F.col("_known"), "left")
    return out.withColumn("created", F.col("_known").isNull()).withColumn("session", F.coalesce("_known", fresh)).drop("_known")


def archive(sessions: DataFrame, keys: DataFrame, key: str = "session") -> DataFrame:
    """Soft deletion: the sessions stay, archived and no longer active."""
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    out = sessions.join(gone, key, "left")
    hit = F.coalesce("_gone", F.lit(False))
    return out.withColumn("archived", F.col("archived") | hit).withColumn("is_active", F.col("is_active") & ~hit).drop("_gone")


def session_list(sessions: DataFrame, limit: int = 50, archived: bool = False) -> DataFrame:
    """Each user's last sessions, newest first (`rank`); archived ones only if asked for."""
    return top(sessions if archived else sessions.filter(~F.col("archived")), ["user_id"], [F.desc("updated_date"), F.asc("session")], limit)


def session_messages(messages: DataFrame, limit: int = 200) -> DataFrame:
    """Each session's first messages, oldest first (`rank`)."""
    return top(messages, ["session"], [F.asc("seq")], limit)


def goals(rows: DataFrame, active: bool, limit: int = 50) -> DataFrame:
    """Each user's goals (user_id, id, status, created_date): active ones oldest first, all of them newest first."""
    order = [F.asc("created_date"), F.asc("id")] if active else [F.desc("created_date"), F.asc("id")]
    return top(rows.filter("status = 'active'") if active else rows, ["user_id"], order, limit)


def envelope(rows: DataFrame, item: Column, order: list[Column], skip: int, limit: int, most: int = 100) -> DataFrame:
    """One row: items of the page (at most `most`), total, skip, limit. The page is read before it is collected."""
    limit = max(1, min(most, limit))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = rows.orderBy(*order).offset(skip).limit(limit).select(item.alias("item"), F.monotonically_increasing_id().alias("pos"))
    items = cut.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
    return items.join(F.broadcast(total)).select("items", "total", F.lit(skip).alias("skip"), F.lit(limit).alias("limit"))


def counted(rows: DataFrame, by: str, **conditions) -> DataFrame:
    """Rows of each key under the conditions of a page."""
    return where(rows, **conditions).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def point_count(spark: SparkSession, table: str) -> DataFrame:
    """n, exact: of the catalog's table; -1 if it isn't there."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([(-1,)], "n long")
    return spark.table(table).agg(F.count(F.lit(1)).alias("n"))


def of_day(rows: DataFrame, day: Column, by: str = "user_id", ts: str = "ts", key: str = "id") -> DataFrame:
    """Each user's last row of the day, which ends before the next midnight."""
    inside = rows.filter((F.col(ts) >= day) & (F.col(ts) < day + F.expr("interval 1 day")))
    return top(inside, [by], [F.desc(ts), F.asc(key)], 1).drop("rank")


def recent(rows: DataFrame, by: str, order: list[Column], keep: int = 7) -> DataFrame:
    """The last rows of each key, numbered from the oldest of them (`pos`, from 1). order: newest first, total."""
    last = top(rows, [by], order, keep)
    size = last.groupBy(by).agg(F.max("rank").alias("_n"))
    return last.join(size, by).withColumn("pos", F.col("_n") - F.col("rank") + 1).drop("_n", "rank")


def public(rows: DataFrame, fields: Sequence[str] = INTERNAL_FIELDS, word: str = INTERNAL_WORD) -> DataFrame:
    """rows without internal fields; a text value that names an internal tier is null."""
    kept = [f for f in rows.schema if f.name not in fields]
    return rows.select(*[F.when(~F.col(f.name).contains(word), F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in kept])


def drift(stored: DataFrame, made: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose stored value differs from the one made now; a key that either side lacks differs."""
    both = stored.select(key, F.col(value).alias("_a")).join(made.select(key, F.col(value).alias("_b")), key, "full_outer")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)

