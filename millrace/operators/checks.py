"""Checks of files for training before they are used, and the acceptance of generated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import staged
from .similarity import first_duplicate, greedy_duplicates

#: What every chat text must hold, and the length of a token and of a sequence.
MARKERS = ("<|im_start|>system", "<|im_start|>user", "<|im_start|>assistant", "<|im_end|>")
CHARS_PER_TOKEN, MAX_TOKENS = 4, 2048


def first_tag(tags: Column) -> Column:
    """Null without tags."""
    return F.get(tags, F.lit(0))


def topic_of(tags: Column, topic: Column) -> Column:
    """The first tag, else the topic, else nothing."""
    return F.coalesce(first_tag(tags), topic, F.lit(""))


def tag_counts(rows: DataFrame, tags: str = "tags", untagged: str = "?") -> DataFrame:
    """topic, n by first tag, largest first; rows without one count as `untagged`."""
    return rows.groupBy(F.coalesce(first_tag(F.col(tags)), F.lit(untagged)).alias("topic")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic")


def usable_triplets(rows: DataFrame, parts: Sequence[str] = ("anchor", "positive", "negative")) -> DataFrame:
    """Triplets with text in all parts whose anchor isn't its own positive."""
    good = F.col(parts[0]) != F.col(parts[1])
    for p in parts:
        good = good & (F.trim(F.coalesce(F.col(p), F.lit(""))) != "")
    return rows.filter(F.coalesce(good, F.lit(False)))


def lengths(rows: DataFrame, text: str = "text", per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """avg_tokens, max_tokens: characters by whole tokens."""
    tokens = F.floor(F.length(F.coalesce(text, F.lit(""))) / per_token)
    return rows.agg(F.avg(tokens).alias("avg_tokens"), F.max(tokens).alias("max_tokens"))


def class_lengths(rows: DataFrame, label: str, text: str) -> DataFrame:
    """label, n, avg_words, avg_chars."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(F.col(text), F.lit(r"\S+"))).alias("avg_words"), F.avg(F.length(text)).alias("avg_chars"))


def split_problems(rows: DataFrame, splits: Sequence[str] = ("train", "val"), markers: Sequence[str] = MARKERS, most: int = MAX_TOKENS) -> DataFrame:
    """mode, problems (sorted; empty means ready) of rows (mode, split, text): one aggregation for all rules.

    A split that is empty is a problem; so are texts that are blank, lack a marker or are longer than `most` tokens."""
    text = F.coalesce("text", F.lit(""))
    rules = {"no usable text": F.trim(text) == "", **{f"missing {m}": ~F.contains(text, F.lit(m)) for m in markers}, f"over {most} tokens": F.floor(F.length(text) / CHARS_PER_TOKEN) > most}
    found = []
    for s in splits:
        inside = F.col("split") == s
        found.append(F.when(F.count_if(inside) == 0, f"{s}: empty"))
        found += [F.when(F.count_if(inside & c) > 0, F.concat(F.lit(f"{s}: "), F.count_if(inside & c).cast("string"), F.lit(f" {name}"))) for name, c in rules.items()]
    return rows.groupBy("mode").agg(F.array_sort(F.array_compact(F.array(*found))).alias("problems"))


def publishable(reports: DataFrame, by: str, expected: int, verdict: str = "verdict", ok: str = "ok_to_train") -> DataFrame:
    """by, ready, publish: all `expected` reports are there, and none needs review."""
    seen = reports.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.coalesce(F.col(verdict) == ok, F.lit(False))), F.lit(False)).alias("good"))
    return seen.select(by, (F.col("n") >= expected).alias("ready"), ((F.col("n") >= expected) & F.col("good")).alias("publish"))


def accept(batch: DataFrame, have: DataFrame, quotas: DataFrame, known: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """id, topic, state of a batch (id, topic, tokens, reasons, advises) in the order of ids: `over_quota`, `rejected` by
    the cheap gates, `advice` by a judge whose verdict is null where it gave none (that passes), `duplicate` of a known row
    (id, tokens) or of one accepted before it in the batch, else `accepted`.

    have: topic, n accepted before; quotas: topic, quota (a topic without one has no limit). The quota counts accepted
    rows only, so it is applied last, to rows that passed everything else."""
    old = staged(first_duplicate(batch.select("id", "tokens"), known.select("id", "tokens"), num, den), "old").select("id", F.lit(True).alias("_old"))
    rows = batch.join(old, "id", "left")
    cheap = F.when(F.size("reasons") > 0, "rejected").when(F.coalesce("_old", F.lit(False)), "duplicate").when(F.coalesce("advises", F.lit(False)), "advice")
    rows = rows.withColumn("_state", cheap)
    gone = staged(greedy_duplicates(rows.filter(F.col("_state").isNull()).select("topic", "id", "tokens"), num, den), "gone")
    rows = rows.join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("_state", F.coalesce("_state", F.when(F.coalesce("_gone", F.lit(False)), "duplicate")))
    room = rows.filter(F.col("_state").isNull()).withColumn("_rank", F.row_number().over(Window.partitionBy("topic").orderBy("id"))).select("id", "_rank")
    limits = quotas.select("topic", "quota").join(have.select("topic", "n"), "topic", "left").select("topic", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("_room"))
    out = rows.join(room, "id", "left").join(limits, "topic", "left")
    return out.select("id", "topic", F.coalesce("_state", F.when(F.col("_rank") > F.col("_room"), "over_quota"), F.lit("accepted")).alias("state"))


#: A section starts at such a line; its banner lies between two rules.
SECTION, RULE = r"^# SECTION (\d+) [—-] (.+)$", r"^# ?={4,}\s*$"


def sections(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, number, title, prose, body of each section of a text: gaps and islands over its lines. Prose is what the
    banner says after its title; the rules, and what stands before the first section, belong to no section."""
    line = rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    marked = line.withColumn("_start", F.col("line").rlike(SECTION)).withColumn("_rule", F.col("line").rlike(RULE))
    opening = F.col("_rule") & F.coalesce(F.lead("_start").over(order), F.lit(False))
    marked = marked.withColumn("_open", opening).withColumn("_section", F.sum(F.col("_start").cast("int")).over(order)).filter("_section > 0 and not _open")
    inside = Window.partitionBy(key, "_section").orderBy("pos")
    closed = marked.withColumn("_rules", F.sum(F.col("_rule").cast("int")).over(inside))
    lines = lambda c, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", value.alias("x"))))), lambda x: x["x"]), "\n")
    head = F.max(F.when(F.col("_start"), F.col("line")))
    prose = lines((F.col("_rules") == 0) & ~F.col("_start"), F.regexp_replace("line", "^# ?", ""))
    body = lines((F.col("_rules") > 0) & ~(F.col("_rule") & (F.col("_rules") == 1)), F.col("line"))
    found = closed.groupBy(key, "_section").agg(head.alias("_head"), prose.alias("prose"), body.alias("body"))
    return found.select(key, F.regexp_extract("_head", SECTION, 1).cast("int").alias("number"), F.regexp_extract("_head", SECTION, 2).alias("title"), "prose", "body")
