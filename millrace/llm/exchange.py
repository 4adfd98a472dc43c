"""Golomb-coded exchange: which 48-bit fingerprints of a block of rows occur in other blocks too.

Blocks send their sorted fingerprints, Rice-coded, to the owner of each range; owners answer with bitmaps. Equal
fingerprints inside a block are sent once, so a huge group of copies costs a message what one text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, released_group

BITS = 48
REPLIES = "array<struct<owner: int, bitmap: binary>>"


def rice(values: np.ndarray) -> bytes:
    """Sorted distinct integers as Golomb-Rice codes of their gaps: count, shift, unary quotients, remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, 0.69 * float(values[-1]) / n)))) if n else 0
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = np.zeros((n, k), np.uint8)
    for b in range(k):
        low[:, k - 1 - b] = (gaps >> np.uint64(b)) & np.uint64(1)
    return np.array([n, k, len(unary)], "<u4").tobytes() + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def unrice(blob: bytes) -> np.ndarray:
    n, k, m = (int(x) for x in np.frombuffer(blob[:12], "<u4"))
    cut = 12 + (m + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob[12:cut], np.uint8), count=m))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    low = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * k).reshape(n, k)
    for b in range(k):
        gaps += low[:, k - 1 - b].astype(np.uint64) << np.uint64(b)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner(v: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Ranges of equal width: sorted fingerprints go to owners in order."""
    return ((v * np.uint64(owners)) >> np.uint64(bits)).astype(np.int64)


def _send(owners: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, prints in zip(b["block"].to_pylist(), b["prints"].to_pylist()):
                v = np.unique(np.frombuffer(prints, "<u8"))
                who, first = np.unique(_owner(v, owners, bits), return_index=True)
                yield pa.RecordBatch.from_pydict({"owner": pa.array(who.astype(np.int32)), "block": pa.array([block] * len(who), pa.string()), "codes": pa.array([rice(x) for x in np.split(v, first[1:])] if len(v) else [], pa.binary())})

    return run


def _own(t: pa.Table) -> pa.Table:
    lists = [unrice(x) for x in t["codes"].to_pylist()]
    _, back, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    flags = np.split((count > 1)[back], np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"owner": t["owner"], "block": t["block"], "bitmap": [np.packbits(x).tobytes() for x in flags]})


def owners_of(blocks: DataFrame) -> int:
    return min(4096, max(2, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_replies(blocks: DataFrame, owners: int, bits: int = BITS) -> DataFrame:
    """blocks (block, prints: little-endian 64-bit fingerprints below 2^bits, ...) with the owners' replies."""
    sent = blocks.select("block", "prints").mapInArrow(released(_send(owners, bits)), "owner int, block string, codes binary")
    replies = sent.groupBy("owner").applyInArrow(released_group(_own), "owner int, block string, bitmap binary")
    return blocks.join(replies.groupBy("block").agg(F.collect_list(F.struct("owner", "bitmap")).alias("replies")), "block")


def repeated(prints: np.ndarray, replies: list[dict], owners: int, bits: int = BITS) -> np.ndarray:
    """Whether each of a block's fingerprints occurs again, in the block or elsewhere."""
    v, back, count = np.unique(prints, return_inverse=True, return_counts=True)
    owner, twice = _owner(v, owners, bits), count > 1
    maps = {x["owner"]: x["bitmap"] for x in replies}
    who, first = np.unique(owner, return_index=True)
    for k, at in zip(who.tolist(), np.split(np.arange(len(v)), first[1:])):
        twice[at] |= np.unpackbits(np.frombuffer(maps[k], np.uint8), count=len(at)).astype(bool)
    return twice[back]
