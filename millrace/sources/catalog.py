"""Catalog tables: idempotent DDL, and a table of vectors that is dealt by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the eight tables.
TABLES = {
    "users": "id string, email string, created_date timestamp",
    "memories": "id string, user_id string, title string, content string, source string, topic string, tags array<string>, importance int, user_priority string, access_count bigint, embedded boolean, created_date timestamp",
    "chat_sessions": "id string, user_id string, mode string, title string, archived boolean, is_active boolean, created_date timestamp, updated_date timestamp",
    "chat_messages": "id string, session_id string, user_id string, role string, content string, sentiment string, created_date timestamp",
    "daily_insights": "user_id string, day date, summary string, mood_trend string, key_topics array<string>, message_count bigint, alignment_score double",
    "reflections": "id string, user_id string, content string, mood string, created_date timestamp",
    "goals": "id string, user_id string, name string, current_value double, target_value double, unit string, status string, deadline string, created_date timestamp",
    "preferences": "user_id string, mode string, voice string, speed double",
}
VECTORS = "id string, user_id string, user_priority string, topic string, embedding array<float>"
WIDTH, BUCKETS = 768, 64


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Creates the tables that aren't there; returns the names of all."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return [f"{database}.{name}" for name in TABLES]


def create_vectors(spark: SparkSession, table: str, buckets: int = BUCKETS) -> None:
    """A table of vectors, in buckets by user: a join by user reads it without an exchange. Parquet's statistics and
    dictionaries stand in for indexes on user, priority and topic."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({VECTORS}) USING parquet CLUSTERED BY (user_id) SORTED BY (user_id, id) INTO {buckets} BUCKETS")


def put_vectors(rows: DataFrame, table: str, width: int = WIDTH, buckets: int = BUCKETS) -> None:
    """Appends rows; a vector of another width than the table's fails the write."""
    checked = rows.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector isn't {width} wide")).cast("array<float>")))
    checked.select("id", "user_id", "user_priority", "topic", "embedding").write.mode("append").format("parquet").bucketBy(buckets, "user_id").sortBy("user_id", "id").saveAsTable(table)


def get_point(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The row with an id; the filter reaches the files' statistics."""
    return spark.table(table).filter(F.col("id") == F.lit(key))
