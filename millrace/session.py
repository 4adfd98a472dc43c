"""Session defaults for the operators of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; any setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
