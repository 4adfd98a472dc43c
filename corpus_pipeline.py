"""Corpus pipeline: quality filter, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns the pieces of the packed sequences. Executors' heaps shrink before each stage.

Defined cases, all stages: an empty table gives an empty one; columns besides doc_id, text and source pass through
unread, whatever their names, as do nulls in them. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import shrink_heaps, work_dir
from millrace.llm.exact_dedup import drop_duplicates
from millrace.llm.mixing import mix_documents
from millrace.llm.ngram_jaccard import one_of_each
from millrace.llm.packing import pack
from millrace.llm.quality import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Equal texts fare alike; empty ones are scored like any other; without
    usable labels, or with one class only, the score is constant and all stay or all go."""
    shrink_heaps(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays (a null id only if no row has one); of repeated rows one stays."""
    shrink_heaps(spark)
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more. Documents without
    words and rows with a null id stay."""
    shrink_heaps(spark)
    return one_of_each(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, which may be not at all. A null source is a source of its
    own; rows with one id fare alike; documents without words weigh nothing and go with the cut that their id hashes to."""
    shrink_heaps(spark)
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; each row is packed whole, repeated ones one by one, empty ones as their end id."""
    import public_tokenizers

    shrink_heaps(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing", mixture),
    ("packing", packing),
]

#: The classifier is a network: SQL can't express its stage, nor then the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/stage{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
