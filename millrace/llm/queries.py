"""The registered queries of this folder, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_duplicates
from .gru_lm import score
from .language_id import identify
from .license_scan import scan, scan_sql
from .line_dedup import dedup_report
from .media_columns import text_media
from .mixing import mix_report
from .ngram_jaccard import jaccard_join
from .packing import pack
from .quality import quality_scores

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir, "doc_id", "text"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir, "doc_id", "text")).drop("copies")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_documents(spark, sf_dir, "doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir, "doc_id", "text", "lang"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(_documents(spark, sf_dir, "doc_id", "text"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_documents(spark, sf_dir, "doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_documents(spark, sf_dir, "doc_id", "text", "source"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_documents(spark, sf_dir, "doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_media_columns": op6_media_columns,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
}

ORACLE: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op10_license_scan": scan_sql(),
}
