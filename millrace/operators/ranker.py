"""A learned ranker: boosted trees on the grades of single rows, as Spark ML has no listwise ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import FEATURES


def split_queries(rows: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """rows with `split`: whole queries go to train or val, by hash."""
    u = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("split", F.when(u < share, "train").otherwise("val"))


def train_ranker(rows: DataFrame, trees: int = 30, depth: int = 5, rate: float = 0.1, seed: int = 42):
    """A pipeline model of train rows (eight features, grade)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trees_of = GBTRegressor(featuresCol="_features", labelCol="grade", predictionCol="score_learned", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), trees_of]).fit(rows.withColumn("grade", F.col("grade").cast("double")))


def ranked(model, rows: DataFrame) -> DataFrame:
    """rows with `score_learned`."""
    return model.transform(rows).drop("_features")


def importance(model) -> dict[str, float]:
    """Share of each feature in the model's gain, largest first; read from the model, which is small."""
    shares = zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist())
    return dict(sorted(shares, key=lambda x: (-x[1], x[0])))
