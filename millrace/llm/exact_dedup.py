"""Exact deduplication by a Golomb-coded exchange of fingerprints.

Blocks of rows send the sorted fingerprints of their texts, Rice-coded, to the owner of each fingerprint range. An
owner answers every block with a bitmap of those that it has also got from elsewhere. Only texts of such suspects
are shuffled, pre-aggregated by fingerprint and whole text, so that equal bytes decide and a huge group of copies is
one row per task.

Texts are equal if they are the same after each run of ASCII white space became one space; null counts as empty. Of
equal texts the row with the smallest doc_id stays (null ids last; among repeated ids, one row). Columns that the
input has besides doc_id and text don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, discard, key_filter, passing, released, staged, unboxed, without
from .exchange import owners_of, repeated, with_replies

BLOCK_ROWS = 8192
BLOCKS = "block string, n int, doc_ids binary, no_id binary, prints binary, shas binary"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def fingerprint(text, bits: int):
    """The upper `bits` bits of a 64-bit hash of the normalised text."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at, held, n = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        rows = [], [], [], []
        ids = t["doc_id"]
        rows = (ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), t["fp"].to_numpy().astype("<i8").tobytes(), b"".join(t["sha"].to_pylist()))
        return pa.RecordBatch.from_pydict({"block": [f"{part}-{at}"], "n": pa.array([t.num_rows], pa.int32()), "doc_ids": [rows[0]], "no_id": [rows[1]], "prints": [rows[2]], "shas": [rows[3]]})

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            at, held, n = at + 1, [], 0
    if n:
        yield block()


def _mark(bits: int, owners: int):
    """Rows of each block, suspect where an owner or the block itself has the fingerprint twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                prints, n = np.frombuffer(r["prints"], "<u8"), r["n"]
                ids = pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(r["no_id"], np.uint8).astype(bool))
                sha = [r["shas"][i : i + 32].hex() for i in range(0, 32 * n, 32)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "row": [f"{r['block']}-{i}" for i in range(n)], "fp": pa.array(prints.astype(np.int64)), "text_sha256": sha, "suspect": pa.array(repeated(prints, r["replies"], owners, bits))})

    return run


def exact_duplicates(docs: DataFrame, bits: int = 48) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, copies (rows with this id in its group).

    bits: of the fingerprint; fewer make more suspects, never another result.
    """
    if not 1 <= bits <= 48:
        raise ValueError("bits must be 1 to 48")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    prints = text.select("doc_id", fingerprint(F.col("text"), bits).alias("fp"), F.unhex(F.sha2(F.col("text"), 256)).alias("sha"))
    blocks = staged(prints.mapInArrow(released(_pack), BLOCKS), "blocks")
    owners = owners_of(blocks)
    marked = staged(with_replies(blocks, owners, bits).mapInArrow(released(_mark(bits, owners)), "doc_id long, row string, fp long, text_sha256 string, suspect boolean"), "rows")
    discard(blocks)
    suspects = marked.filter("suspect")
    # the scan passes what may be a suspect; equal fingerprints, digests and bytes make a class
    wanted = passing(text.withColumn("fp", fingerprint(F.col("text"), bits)), key_filter(suspects, "fp"), F.col("fp"))
    classes = (
        wanted.groupBy("fp", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    grouped = suspects.join(classes, ["fp", "text_sha256"])
    # of rows that share the smallest id (or have none), the first by row name stays
    same = (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("first_id")
    firsts = grouped.filter(same).groupBy("fp", "text_sha256").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("copies"))
    told = grouped.join(firsts, ["fp", "text_sha256"]).select("row", "keep_id", "group_size", F.col("first_row"), "copies")
    out = marked.join(told, "row", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
        "text_sha256",
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def drop_duplicates(docs: DataFrame, bits: int = 48) -> DataFrame:
    """docs without the rows that exact_duplicates drops; all columns as they were."""
    found = staged(exact_duplicates(docs, bits), "exact")
    dropped = found.filter("not kept").select("doc_id").distinct()
    # an id of a dropped row may also be that of a row that stays: such ids are settled by id and text
    shared = dropped.join(found.filter("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    stay = without(docs, dropped, doc_id=F.col("doc_id").cast("long")).filter(F.col("doc_id").isNotNull())
    key, sha = F.col("doc_id").cast("long"), F.sha2(normalised(F.col("text")), 256)
    mixed = boxed(docs, _key=key, _sha=sha)
    ids = shared.select(F.col("doc_id").alias("_key"))
    mixed = mixed.filter("_key is null").unionByName(mixed.join(ids, "_key", "left_semi").select("_row", "_key", "_sha")).dropDuplicates(["_key", "_sha"])
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept")).distinct()
    again = mixed.join(kept, mixed["_key"].eqNullSafe(kept["_id"]) & (mixed["_sha"] == kept["_kept"]), "left_semi")
    return stay.unionByName(unboxed(again, docs.columns))
