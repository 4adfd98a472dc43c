"""Classification, ranking and run metrics as aggregations. Ratios are unrounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(rows: DataFrame, labels: list) -> DataFrame:
    """label, support, predicted, hit, precision, recall, f1 of rows (truth, pred), classes without rows included."""
    counts = rows.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    dim = rows.sparkSession.createDataFrame([(x,) for x in labels], rows.select(F.col("truth").alias("label")).schema)
    t = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    p = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    out = F.broadcast(dim).join(t, "label", "left").join(p, "label", "left").na.fill(0, ["support", "hit", "predicted"])
    out = out.withColumn("precision", _ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", _ratio(F.col("hit"), F.col("support")))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(classes: DataFrame) -> DataFrame:
    """accuracy, macro_f1, weighted_f1 of per_class rows."""
    total = F.sum("support")
    return classes.agg(_ratio(F.sum("hit"), total).alias("accuracy"), F.avg("f1").alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"))


def confusion(rows: DataFrame, labels: list) -> DataFrame:
    return rows.groupBy("truth").pivot("pred", labels).agg(F.count(F.lit(1))).na.fill(0)


def label_counts(rows: DataFrame, column: str, labels: list) -> DataFrame:
    dim = rows.sparkSession.createDataFrame([(x,) for x in labels], rows.select(column).schema)
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(n, column, "left").na.fill(0, ["n"])


def ndcg(rows: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg of rows (query_id, id, score, grade): gain 2^grade - 1, discount log2(rank + 1); 1 if no gain."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    got = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ranked = rows.withColumn("_r", F.row_number().over(got)).withColumn("_b", F.row_number().over(best))
    dcg = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1)).otherwise(0.0))
    return ranked.groupBy("query_id").agg(dcg("_r").alias("dcg"), dcg("_b").alias("ideal")).select("query_id", F.coalesce(F.try_divide("dcg", "ideal"), F.lit(1.0)).alias("ndcg"))


def run_summary(rows: DataFrame, checks: list[str], by: str = "config") -> DataFrame:
    """Means of checks, median latency and failures of rows (config, ok, latency, ...)."""
    ok = F.col("ok")
    return rows.groupBy(by).agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("failures"), *[F.avg(F.when(ok, F.col(c))).alias(f"{c}_rate") for c in checks], F.percentile(F.when(ok, F.col("latency")), F.lit(0.5)).alias("median_latency"))


def accept_rate(rows: DataFrame, by: str = "provider") -> DataFrame:
    """accepted / (accepted + rejected) of each provider, null if it did nothing."""
    return rows.groupBy(by).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).withColumn("rate", F.try_divide("accepted", F.col("accepted") + F.col("rejected")))


def coverage(judged: Column, unavailable: Column) -> Column:
    return F.coalesce(F.try_divide(judged, judged + unavailable), F.lit(1.0))


def collapsed(scores: DataFrame, table: DataFrame) -> DataFrame:
    """id, label, confidence of scores (id, raw, score): sums by mapped label, the greatest, 1 at most; ties by label."""
    sums = scores.join(F.broadcast(table), "raw", "left").groupBy("id", F.coalesce("label", F.lit("neutral")).alias("label")).agg(F.sum("score").alias("s"))
    best = sums.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "label"))).filter("_r = 1")
    return best.select("id", "label", F.least(F.lit(1.0), "s").alias("confidence"))


def progress_table(wanted: DataFrame, have: DataFrame, key: str, share: float = 1.0) -> DataFrame:
    """key, have, want, state: ready at int(want * share), empty, or partial."""
    both = wanted.join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    return both.select(key, "have", "want", F.when(F.col("have") >= F.floor(F.col("want") * share), "ready").when(F.col("have") == 0, "empty").otherwise("partial").alias("state"))


def latest_checkpoint(rows: DataFrame, by: str, compatible: Column | None = None) -> DataFrame:
    """The path with the highest step of each run; with a condition, of compatible checkpoints only."""
    kept = rows.filter(compatible) if compatible is not None else rows
    return kept.groupBy(by).agg(F.max("step").alias("step"), F.max_by("path", "step").alias("path"))


def mean_vector(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Element-wise mean of each group's vectors: sums by position, so partial sums are all that is shuffled."""
    flat = rows.select(by, F.posexplode(vector).alias("pos", "x"))
    means = flat.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
