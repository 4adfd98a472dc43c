"""Splits, queues and sampled pairs. Randomness is an order by md5 of id and seed: the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICE_DIGITS = 4


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def numbered(rows: DataFrame, by: Column, key: str, seed: int) -> DataFrame:
    """rows with `_i`, their place from 0 in the shuffled order of their group, and `_n`, the group's size. A group is cut
    into slices by the hash's first digits; a row's place is its slice's base and its place there. So a group of any
    size is many tasks, and the bases are at most 16 ^ SLICE_DIGITS rows a group."""
    order = shuffled(F.col(key), seed)
    dealt = rows.withColumn("_g", by).withColumn("_h", order).withColumn("_s", F.substring("_h", 1, SLICE_DIGITS))
    group = Window.partitionBy("_g")
    sizes = dealt.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_c"))
    bases = sizes.select(F.col("_g").alias("_bg"), F.col("_s").alias("_bs"), (F.sum("_c").over(group.orderBy("_s")) - F.col("_c")).alias("_base"), F.sum("_c").over(group).alias("_n"))
    both = dealt.join(bases, F.col("_g").eqNullSafe(F.col("_bg")) & (F.col("_s") == F.col("_bs")))
    place = F.row_number().over(Window.partitionBy("_g", "_s").orderBy("_h", key)) - 1 + F.col("_base")
    return both.withColumn("_i", place).drop("_g", "_h", "_s", "_bg", "_bs", "_base")


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float = 0.1, least: int = 10, seed: int = 42) -> DataFrame:
    """rows with `split`: of strata with `least` rows, max(1, half-even rounded share) are val, in shuffled order."""
    held = F.when(F.col("_n") >= least, F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("long"))).otherwise(0)
    return numbered(rows, F.col(stratum), key, seed).withColumn("split", F.when(F.col("_i") < held, "val").otherwise("train")).drop("_i", "_n")


def shuffled_split(rows: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """rows with `split`: the first `share` of all rows in shuffled order is train."""
    return numbered(rows, F.lit(0), key, seed).withColumn("split", F.when(F.col("_i") < F.floor(F.col("_n") * share + 1e-9), "train").otherwise("val")).drop("_i", "_n")


def hash_split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """rows with `split` by a hash of the key: no shuffle, and stable when rows come or go."""
    u = F.conv(F.substring(shuffled(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(u < share, "train").otherwise("val"))


def topic_queue(quotas: DataFrame, done: DataFrame) -> DataFrame:
    """round, topic: what topics (topic, quota, pos) still need beyond done (topic, n), one each in turn."""
    need = quotas.join(done, "topic", "left").withColumn("need", F.col("quota") - F.coalesce("n", F.lit(0))).filter("need > 0")
    return need.select(F.explode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("round"), "topic", "pos")


def batch_queue(quotas: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """round, topic, n: the same in batches of one topic and at most `size`."""
    need = quotas.join(done, "topic", "left").withColumn("need", F.col("quota") - F.coalesce("n", F.lit(0))).filter("need > 0")
    rounds = F.explode(F.sequence(F.lit(0), F.ceil(F.col("need") / size).cast("int") - 1)).alias("round")
    return need.select(rounds, "topic", "pos", "need").select("round", "topic", "pos", F.least(F.lit(size), F.col("need") - F.col("round") * size).alias("n"))


def quota_cap(rows: DataFrame, quotas: DataFrame, topic: str, arrival: str, slack: tuple[int, int] = (11, 10)) -> DataFrame:
    """The first int(quota * 1.1) rows of each topic; topics without a quota have none."""
    num, den = slack
    limits = quotas.select(topic, F.floor(F.col("quota") * num / den).alias("_limit"))
    most = limits.agg(F.max("_limit")).first()[0] or 0
    # the largest limit as a number lets each task keep that many rows a topic; each topic's own limit follows
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(arrival))
    first = rows.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    return first.join(limits, topic).filter(F.col("_rank") <= F.col("_limit")).drop("_rank", "_limit")


def quota_check(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """topic, have, quota, state: over by more than a tenth, missing, or fine; topics without a quota are `unplanned`."""
    have = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("have"))
    both = have.join(quotas.select("topic", "quota"), "topic", "full_outer").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    state = F.when(F.col("quota").isNull(), "unplanned").when(F.col("have") == 0, "missing").when(F.col("have") * 10 > F.col("quota") * 11, "over").otherwise("fine")
    return both.select("topic", "have", "quota", state.alias("state"))


def _pick(key: Column, seed: int, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(shuffled(key, seed), 1, 8), 16, 10).cast("long"), n)


def negatives(rows: DataFrame, group: str, key: str, text: str, seed: int = 42) -> DataFrame:
    """key, group, other, negative: for each row a row of another group, group and row chosen by hash. Groups are
    numbered by name, a row picks a number and skips its own; the join is on (group, number), so there is one match a
    row. With one group only the rows are their own pool; a null group is nobody's pool."""
    target = numbered(rows, F.col(group), key, seed)
    sizes = target.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("other")).agg(F.first("_n").alias("_n"))
    groups = sizes.withColumn("_at", F.row_number().over(Window.orderBy("other")) - 1)  # a row a group
    total = groups.agg(F.count(F.lit(1)).alias("_groups"))
    own = rows.select(key, group).join(groups.select(F.col("other").alias(group), F.col("_at").alias("_own")), group, "left").join(F.broadcast(total))
    pool = F.when(F.col("_own").isNotNull() & (F.col("_groups") > 1), F.col("_groups") - 1).otherwise(F.col("_groups"))
    pick = _pick(F.col(key), seed + 1, pool)
    skip = F.when(F.col("_own").isNotNull() & (F.col("_groups") > 1) & (pick >= F.col("_own")), 1).otherwise(0)
    chosen = own.filter("_groups > 0").withColumn("_at", (pick + skip).cast("int")).join(groups, "_at").withColumn("_i", _pick(F.col(key), seed + 2, F.col("_n")))
    return chosen.select(key, group, "other", "_i").join(target.select(F.col(group).alias("other"), "_i", F.col(text).alias("negative")), ["other", "_i"]).select(key, group, "other", "negative")


def positives(rows: DataFrame, group: str, key: str, text: str, seed: int = 42) -> DataFrame:
    """key, group, positive: for each row the next of its group in shuffled order, around the end; groups of one have
    none. Never the row itself."""
    placed = numbered(rows, F.col(group), key, seed)
    wanted = placed.filter("_n > 1").withColumn("_i", F.pmod(F.col("_i") + 1, F.col("_n"))).select(key, group, "_i")
    return wanted.join(placed.select(group, "_i", F.col(text).alias("positive")), [group, "_i"]).select(key, group, "positive")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
