"""Daily and weekly rollups of messages: mood, topics, alignment with goals.

Messages: user_id, ts, seq (total order inside a user), text, sentiment. A day is a UTC day [00:00, +1 d), a week seven
days from a Monday."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import lead_summary


def mood(labels: str = "sentiment") -> Column:
    """Aggregate: more than half negative, else more than half positive, else mixed; nulls and blanks don't count."""
    c = F.col(labels)
    n = F.count_if(c.isNotNull() & (c != ""))
    return F.when(n == 0, "mixed").when(F.count_if(c.isin(C.NEGATIVE)) * 2 > n, "challenging").when(F.count_if(c.isin(C.POSITIVE)) * 2 > n, "strong").otherwise("mixed")


def key_topics(messages: DataFrame, by: list[str], limit: int = 5, stop: Sequence[str] = tuple(C.TAG_STOPWORDS), pattern: str = "[a-zA-Z]{4,}") -> DataFrame:
    """by, topics: the most frequent words of each group; of equal ones the first seen."""
    words = messages.select(*by, "seq", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0))).alias("pos", "word"))
    counts = words.filter(~F.col("word").isin(*stop)).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("seen"))
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen", "word"))).filter(F.col("rank") <= limit)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("topics"))


def tags(texts: DataFrame, key: str, text: str, limit: int = C.MAX_TAGS, stop: Sequence[str] = tuple(C.TAG_STOPWORDS)) -> DataFrame:
    """key, tags: the most frequent words; of equal ones the one whose last raw occurrence comes first. Apostrophes and
    dashes at a word's ends go; a word that never occurs without them ranks last."""
    raw = texts.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zA-Z][a-zA-Z'\-]{3,}"), F.lit(0))).alias("pos", "raw"))
    cut = raw.withColumn("word", F.regexp_replace("raw", r"^['\-]+|['\-]+$", "")).filter((F.length("word") >= 4) & ~F.col("word").isin(*stop))
    counts = cut.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("raw") == F.col("word"), F.col("pos"))), F.lit(1 << 30)).alias("last"), F.min("pos").alias("first"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "last", "first"))).filter(F.col("rank") <= limit)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("tags"))


def snippets(messages: DataFrame, by: list[str], labels: Sequence[str], limit: int = 5, width: int = 80) -> DataFrame:
    """by, snippets: the first messages, in order, with one of the sentiments."""
    named = messages.filter(F.col("sentiment").isin(*labels) & (F.coalesce("text", F.lit("")) != ""))
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).filter(F.col("rank") <= limit)
    cut = F.concat(F.substring(F.replace(F.trim("text"), F.lit("\n"), F.lit(" ")), 1, width), F.when(F.length("text") > width, "...").otherwise(""))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cut.alias("s")))), lambda x: x["s"]).alias("snippets"))


def alignment(days: DataFrame, goals: DataFrame, stop: Sequence[str] = tuple(C.TAG_STOPWORDS)) -> DataFrame:
    """days (user_id, day, corpus, n) with alignment: the share of the user's goals (user_id, goal_name, category) of
    which a word of four letters or the category is in the day's text, and a bonus above five messages; without goals
    the score rests on the number of messages. Unrounded."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("goal_name", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*stop))
    category = F.when(F.coalesce("category", F.lit("")) != "", F.array(F.lower("category"))).otherwise(F.array().cast("array<string>"))
    wanted = goals.select("user_id", F.concat(words, category).alias("keywords")).groupBy("user_id").agg(F.collect_list("keywords").alias("goals"))
    both = days.join(wanted, "user_id", "left")
    low = F.lower("corpus")
    matched = F.size(F.filter("goals", lambda k: F.exists(k, lambda w: low.contains(w))))
    bonus = F.when(F.col("n") > 5, 10.0).otherwise(0.0)
    free = F.least(F.lit(100.0), 40.0 + bonus + F.least(F.lit(30.0), F.col("n") * 3.0))
    return both.withColumn("alignment", F.when(F.col("goals").isNull(), free).otherwise(F.least(F.lit(100.0), matched / F.size("goals") * 100.0 + bonus))).drop("goals")


def daily(messages: DataFrame, least: int = C.MIN_MESSAGES) -> DataFrame:
    """user_id, day, message_count, mood_trend, key_topics of days with enough messages."""
    dated = messages.withColumn("day", F.to_date("ts"))
    days = dated.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("message_count"), mood().alias("mood_trend")).filter(F.col("message_count") >= least)
    return days.join(key_topics(dated, ["user_id", "day"]), ["user_id", "day"], "left").withColumnRenamed("topics", "key_topics")


def full_daily(messages: DataFrame, goals: DataFrame, least: int = C.MIN_MESSAGES, width: int = 1000) -> DataFrame:
    """user_id, day, message_count, mood_trend, key_topics, summary, alignment, achievements, challenges: everything that
    is said of a day. messages: user_id, ts, seq, text, sentiment; the summary is the lead of the first `width`
    characters, the alignment is held against all the day's texts."""
    by = ["user_id", "day"]
    dated = messages.withColumn("day", F.to_date("ts"))
    said = dated.filter(F.coalesce("text", F.lit("")) != "").groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("corpus"))
    days = daily(messages, least).join(said, by, "left").withColumn("corpus", F.coalesce("corpus", F.lit("")))
    out = alignment(days.withColumn("n", F.col("message_count")), goals).withColumn("summary", lead_summary(F.substring("corpus", 1, width))).drop("corpus", "n")
    for labels, name in ((C.POSITIVE, "achievements"), (C.NEGATIVE, "challenges")):
        out = out.join(snippets(dated, by, labels).withColumnRenamed("snippets", name), by, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def weekly(days: DataFrame, limit: int = 8) -> DataFrame:
    """Per user and week: days with data, messages, commonest mood (of equal ones the earliest day's), top topics.
    days: user_id, day, message_count, mood_trend, key_topics, and alignment if there is one."""
    week = days.withColumn("week_start", F.date_trunc("week", "day").cast("date"))
    by = ["user_id", "week_start"]
    sums = [F.count(F.lit(1)).alias("days_with_data"), F.sum("message_count").alias("total_messages")]
    if "alignment" in days.columns:
        sums.append(F.avg("alignment").alias("avg_alignment"))
    moods = week.groupBy(*by, "mood_trend").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"))
    moods = moods.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).filter("rank = 1").select(*by, "mood_trend")
    words = week.select(*by, "day", F.posexplode("key_topics").alias("pos", "word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "pos")).alias("seen"))
    best = words.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen"))).filter(F.col("rank") <= limit)
    topics = best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("key_topics"))
    return week.groupBy(*by).agg(*sums).join(moods, by, "left").join(topics, by, "left")
