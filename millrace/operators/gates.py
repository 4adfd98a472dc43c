"""Quality gates of a text dataset: declarative rules, reasons a row, one report a persona."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parsing import find_verse_udf


@dataclass(frozen=True)
class PersonaSpec:
    """Rules of a persona. They are compiled to Columns, so all gates of all rows are one projection."""

    mode: str
    user_words: tuple[int, int]
    reply_words: tuple[int, int]
    markers: Sequence[str] = ()
    question_counts_as_marker: bool = False
    require_verse: bool = False
    require_ends_with_question: bool = False
    forbidden_phrases: Sequence[str] = ()
    forbid_advice: bool = False
    similarity: tuple[int, int] = (3, 4)
    min_marker_pass_rate: float = 0.90
    max_near_duplicates: int = 0
    min_avg_reply_words: float = 0.0
    quotas: dict[str, int] = field(default_factory=dict)


def _length(n: Column, band: tuple[int, int], what: str) -> Column:
    low, high = band
    text = lambda side, limit: F.concat(F.lit(f"the {what} is "), n.cast("string"), F.lit(f" words, {side} the {limit}-word {'minimum' if side == 'below' else 'maximum'}"))
    return F.when(n < low, text("below", low)).when(n > high, text("above", high))


def reasons(spec: PersonaSpec, user: str = "user", reply: str = "reply", duplicate: str | None = None) -> Column:
    """Ordered array of what is wrong with a pair; empty if nothing. A pair without text has that one reason only.
    duplicate: column with the similarity of the nearest earlier pair if it is above the threshold, else null."""
    u, r = F.col(user), F.col(reply)
    checks = [_length(T.word_count(u), spec.user_words, "user message"), _length(T.word_count(r), spec.reply_words, "response")]
    if spec.markers or spec.question_counts_as_marker:
        shown = ", ".join(list(spec.markers)[:8])
        checks.append(F.when(T.first_marker(r, spec.markers, spec.question_counts_as_marker).isNull(), f"the response contains none of the required {spec.mode} markers ({shown})"))
    if spec.require_verse:
        checks.append(F.when(find_verse_udf(r).isNull(), "the response has no chapter-and-verse reference"))
    if spec.require_ends_with_question:
        checks.append(F.when(~T.ends_with_question(r), "the response does not end with a question"))
    if spec.forbidden_phrases or spec.forbid_advice:
        found = T.advice(r, spec.forbidden_phrases, spec.forbid_advice)
        checks.append(F.when(found.isNotNull(), F.concat(F.lit("the response gives direct advice ('"), found, F.lit("')"))))
    trailing = T.trailing_questions(r)
    checks.append(F.when(trailing > 1, F.concat(F.lit("the response ends with "), trailing.cast("string"), F.lit(" stacked questions"))))
    if duplicate:
        checks.append(F.when(F.col(duplicate).isNotNull(), "the user message is Jaccard-similar to an earlier pair"))
    blank = lambda c: F.trim(T.text_of(c)) == ""
    return F.when(blank(u), F.array(F.lit("'user' is missing or empty"))).when(blank(r), F.array(F.lit("'reply' is missing or empty"))).otherwise(F.array_compact(F.array(*checks)))


def reason_kind(reason: Column) -> Column:
    low = F.lower(reason)
    return (
        F.when(low.contains("below the") & low.contains("minimum"), "too_short").when(low.contains("above the") & low.contains("maximum"), "too_long").when(low.contains("markers"), "no_marker")
        .when(low.contains("verse"), "no_verse").when(low.contains("does not end with a question"), "no_question").when(low.contains("stacked questions"), "stacked_questions")
        .when(low.contains("advice"), "advice").when(low.contains("similar"), "duplicate").otherwise("other")
    )


def reason_key(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, reason_kind))), "|")


def histogram(rows: DataFrame, found: str = "reasons", keep: int = 6) -> DataFrame:
    """The commonest reasons, numbers as N and without what is in brackets; ties by text."""
    one = rows.select(F.explode(found).alias("r"))
    key = F.regexp_replace(F.trim(F.substring_index("r", "(", 1)), r"\b\d+(\.\d+)?\b", "N")
    return one.groupBy(key.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(keep)


def regroup(rows: DataFrame, size: int = 5) -> DataFrame:
    """Batches to generate again: (topic, kind, batch, n, sample) of rejected rows (id, topic, reasons)."""
    groups = rows.filter(F.size("reasons") > 0).groupBy("topic", reason_key(F.col("reasons")).alias("kind")).agg(F.count(F.lit(1)).alias("total"), F.min_by("reasons", "id").alias("sample"))
    split = groups.withColumn("batch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / size).cast("int") - 1)))
    return split.select("topic", "kind", "batch", F.least(F.lit(size), F.col("total") - F.col("batch") * size).alias("n"), "sample")


def quality_report(rows: DataFrame, spec: PersonaSpec, near: DataFrame, generated: int = 0, rejected: int = 0, regenerated: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row: counts, rates and verdict of rows (id, user, reply, topic). near: ids with an earlier similar row."""
    r, u = F.col("reply"), F.col("user")
    marker = F.lit(1) if not (spec.markers or spec.question_counts_as_marker) else T.first_marker(r, spec.markers, spec.question_counts_as_marker).isNotNull().cast("int")
    verse = find_verse_udf(r).isNotNull().cast("int") if spec.require_verse else F.lit(0)
    advice = T.advice(r, spec.forbidden_phrases, spec.forbid_advice).isNotNull().cast("int") if spec.forbidden_phrases or spec.forbid_advice else F.lit(0)
    flat = rows.join(near.select("id").distinct().withColumn("_near", F.lit(1)), "id", "left").select(
        T.word_count(u).alias("uw"), T.word_count(r).alias("rw"), marker.alias("m"), verse.alias("v"), T.ends_with_question(r).cast("int").alias("q"), advice.alias("a"), F.coalesce("_near", F.lit(0)).alias("d")
    )
    total = flat.agg(
        F.count(F.lit(1)).alias("total_pairs"), F.avg("uw").alias("avg_user_length"), F.avg("rw").alias("avg_reply_length"), F.min("uw").alias("min_user_length"), F.min("rw").alias("min_reply_length"),
        F.avg("m").alias("marker_pass_rate"), F.sum("d").alias("near_duplicate_count"), F.avg("q").alias("question_rate"), F.avg("a").alias("advice_rate"), F.avg("v").alias("verse_rate"),
    )
    spark = rows.sparkSession
    quota = spark.createDataFrame(list(spec.quotas.items()) or [("", 0)], "topic string, quota int").filter("topic <> ''")
    have = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("have"))
    topics = quota.join(have, "topic", "left").agg(F.count_if(F.coalesce("have", F.lit(0)) > F.col("quota") * 1.10).alias("topics_over"), F.count_if(F.col("have").isNull()).alias("topics_missing"), F.coalesce(F.sum("quota"), F.lit(0)).alias("target_pairs"))
    attempted, (tried, got) = generated + rejected, regenerated
    out = total.join(F.broadcast(topics)).withColumn("rejection_rate", F.lit(rejected / attempted if attempted else 0.0)).withColumn("regeneration_rate", F.lit(got / tried if tried else 0.0))
    issues = [
        F.when(F.col("marker_pass_rate") < spec.min_marker_pass_rate, "marker_pass_rate"),
        F.when(F.col("near_duplicate_count") > spec.max_near_duplicates, "near_duplicate_count"),
        F.when(F.lit(spec.min_avg_reply_words > 0) & (F.col("avg_reply_length") < spec.min_avg_reply_words), "avg_reply_length"),
        F.when(F.lit(spec.require_verse) & (F.col("verse_rate") < 1), "verse_rate"),
        F.when(F.lit(spec.require_ends_with_question) & (F.col("question_rate") < 1), "question_rate"),
        F.when(F.lit(bool(spec.forbid_advice or spec.forbidden_phrases)) & (F.col("advice_rate") > 0), "advice_rate"),
        F.when(F.col("topics_over") > 0, "topics_over"),
        F.when(F.col("total_pairs") < F.col("target_pairs"), "short_of_target"),
    ]
    blocking = F.when(F.col("total_pairs") == 0, F.array(F.lit("no pairs"))).otherwise(F.array_compact(F.array(*issues)))
    verdict = F.when(F.col("total_pairs") == 0, "empty").when(F.size("blocking_issues") == 0, "ok_to_train").otherwise("needs_review")
    return out.withColumn("blocking_issues", blocking).withColumn("verdict", verdict)
