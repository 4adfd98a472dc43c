"""Vector retrieval inside a user's memories, reranking, and the prompt that is built from the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import features as X

#: Queries are broadcast only below this many rows (about 0.5 KB each with a 64-d vector).
BROADCAST_QUERIES = 20_000


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def candidates(queries: DataFrame, memories: DataFrame, excluded: tuple[str, ...] = ("excluded",)) -> DataFrame:
    """queries (query_id, user_id, query_vector, topic?) joined to the same user's memories (id, user_id, embedding,
    user_priority, ...) with the cosine as `score`. Memories of an excluded priority drop out before any vector is
    read; a null priority stays. Few queries are broadcast; many are joined by user, where skewed users are split."""
    kept = memories.filter(~F.coalesce(F.col("user_priority").isin(*excluded), F.lit(False))).filter(F.size("embedding") > 0)
    kept = kept.withColumn("_norm", X.norm(F.col("embedding")))
    asked = queries.withColumn("_qnorm", X.norm(F.col("query_vector")))
    if bounded(queries, BROADCAST_QUERIES):
        asked = F.broadcast(asked)
    both = kept.join(asked, "user_id")
    return both.withColumn("score", X.cosine(F.col("embedding"), F.col("query_vector"), F.col("_norm"), F.col("_qnorm"))).drop("_norm", "_qnorm", "embedding", "query_vector")


def top(df: DataFrame, by: list[str], order: list[Column], keep: Column | int, name: str = "rank") -> DataFrame:
    """The first rows of each group; Spark keeps only that many rows a group on each side of the exchange."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= keep)


def knn(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    return top(candidates(queries, memories), ["query_id"], [F.desc("score"), F.asc("id")], k)


def rerank(pool: DataFrame, now: Column, keep: Column | int) -> DataFrame:
    """Features, blended score and the best `keep` of each query's pool; ties by cosine, then id. The pool has each
    memory's content or its content_length."""
    length = F.col("content_length") if "content_length" in pool.columns else F.length(F.coalesce("content", F.lit("")))
    cols = X.features(*(F.col(c) for c in ("score", "importance", "user_priority", "created_date", "access_count", "topic", "source")), length, F.col("query_topic"), now)
    scored = pool.drop("rank").select("query_id", "id", F.col("score").alias("vector_score"), *[c for c in pool.columns if c in ("title", "topic")], *[c.alias(f"f_{n}") if n in ("source",) else c for c, n in zip(cols, X.FEATURES)])
    row = {n: F.col("f_source") if n == "source" else F.col(n) for n in X.FEATURES}
    scored = scored.withColumn("rank_score", X.blend(row))
    return top(scored, ["query_id"], [F.desc("rank_score"), F.desc("vector_score"), F.asc("id")], keep)


def pool(queries: DataFrame, memories: DataFrame, label: str = "complexity") -> DataFrame:
    """The candidates that a query's complexity lets into its pool, by cosine; with content_length in place of content."""
    limit = F.lit(0)
    for k, (*_, size) in C.BUDGET.items():
        limit = F.when(F.col(label) == k, size).otherwise(limit)
    # the largest pool as a number lets each task keep that many rows a query; the content is only needed by length
    most = max(size for *_, size in C.BUDGET.values())
    small = memories.withColumn("content_length", F.length(F.coalesce("content", F.lit("")))).drop("content")
    return top(candidates(queries, small), ["query_id"], [F.desc("score"), F.asc("id")], most).filter(F.col("rank") <= limit)


def retrieve(queries: DataFrame, memories: DataFrame, now: Column, label: str = "complexity") -> DataFrame:
    """Two limits from the query's complexity: a pool by cosine, then the best of it after reranking."""
    keep = F.lit(0)
    for k, (n, *_) in C.BUDGET.items():
        keep = F.when(F.col(label) == k, n).otherwise(keep)
    kept = rerank(pool(queries, memories, label), now, 10**9)
    limits = queries.select("query_id", keep.alias("_keep"))
    limits = F.broadcast(limits) if bounded(queries, BROADCAST_QUERIES) else limits
    return kept.join(limits, "query_id").filter(F.col("rank") <= F.col("_keep")).drop("_keep")


def cut_words(c: Column, width: int) -> Column:
    """Cut to a width at the last space before it, with dots after."""
    short = F.substring(c, 1, width)
    at = F.length(short) - F.length(F.substring_index(short, " ", -1)) - 1
    return F.when(F.length(c) > width, F.concat(F.when(at > 0, F.substring(short, F.lit(1), at)).otherwise(short), F.lit("..."))).otherwise(c)


def _section(df: DataFrame, line: Column, order: str, head: str, between: str, limit: int | None = None) -> DataFrame:
    rows = df.select("query_id", F.struct(F.col(order).alias("pos"), line.alias("line")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    lines = F.transform(F.slice("x", 1, limit) if limit else F.col("x"), lambda x: x["line"])
    return rows.select("query_id", F.concat(F.lit(head), F.array_join(lines, between)).alias("section"))


def prompts(queries: DataFrame, memories: DataFrame, history: DataFrame, goals: DataFrame) -> DataFrame:
    """query_id, prompt: sections of context, conversation and goals that a query has, then its message.

    memories: query_id, rank, title, content; history: query_id, pos, user_message, reply; goals: query_id, pos, goal_name,
    current_value, target_value, unit. Each is a few rows a query, as earlier limits have cut them."""
    flat = lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    title = F.trim(F.coalesce("title", F.lit("")))
    memory = F.concat(F.col("rank").cast("string"), F.lit(". "), F.when(title != "", F.concat(title, F.lit(": "))).otherwise(""), cut_words(flat(F.col("content")), 400))
    said = lambda c: F.when(F.length(flat(c)) > 300, F.concat(F.substring(flat(c), 1, 300), F.lit("..."))).otherwise(flat(c))
    turn = F.concat(F.lit("User: "), said(F.col("user_message")), F.lit("\nYou: "), said(F.col("reply")))
    pct = F.least(F.lit(100.0), F.try_divide("current_value", "target_value") * 100)
    goal = F.concat(F.lit("- "), F.col("goal_name"), F.when(F.coalesce("target_value", F.lit(0.0)) != 0, F.concat(F.lit(" ("), F.bround(pct).cast("int").cast("string"), F.lit("% of "), F.regexp_replace(F.col("target_value").cast("string"), r"\.0$", ""), F.lit(" "), F.col("unit"), F.lit(")"))).otherwise(""))
    parts = [
        _section(memories, memory, "rank", "RELEVANT CONTEXT — things you already know about this person:\n", "\n").withColumnRenamed("section", "s1"),
        _section(history, turn, "pos", "RECENT CONVERSATION:\n", "\n\n").withColumnRenamed("section", "s2"),
        _section(goals, goal, "pos", "CURRENT GOALS:\n", "\n", 5).withColumnRenamed("section", "s3"),
    ]
    out = queries
    for p in parts:
        out = out.join(p, "query_id", "left")
    return out.select("query_id", F.concat_ws("\n\n", "s1", "s2", "s3", F.concat(F.lit("User: "), F.col("message"))).alias("prompt"))
