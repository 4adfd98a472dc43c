"""Packing token sequences by minimum bin slack.

Documents become ids of a public tokenizer and an end id. Whole windows of a document are sequences of their own; what
remains is an item of 1 to window - 1 tokens. The histogram of item lengths (never more rows than the window) goes to
the driver. There, again and again, the longest item is joined by the multiset of lengths that fills its window
closest to capacity, found by a subset-sum dynamic program over bitsets and traced back to counts; the pattern is
repeated as often as the counts allow. Where no multiset fills the window exactly, an item is cut to fill it and its
rest goes back to the histogram. Items then look up their place by their rank among items of equal length, which is
a partition's base plus a running count, so a very common length is no burden.

Defined cases: null text is empty and has the end id alone; repeated rows are packed as rows of their own; an empty
table gives an empty result; other columns don't matter; a row with a null id is packed like any other.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, key_filter, passing, released, staged, staged_small
from .wordhash import LOWER, joined, per_text, words

WINDOW, END = 4096, 2
CHUNK = 1 << 20
AT_ONCE = 16  # groups of words that the tokenizer gets at a time, which bounds what it holds


#: Letters (1) and punctuation (2) of ASCII between which the tokenizer's pattern always splits; the apostrophe isn't
#: among them as it starts contractions, nor are the characters of special tokens.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = 1
KINDS[[b for b in b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2
SENTINEL = "\x01"


class _Coder:
    """Ids of words by their hash, with a bounded memory of those already seen by this task. It goes with the task: workers are kept by executors."""

    REMEMBER = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.sentinel = self.tokenizer.encode(SENTINEL, add_special_tokens=False).ids
        self.hashes, self.begins, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and their numbers. Words go through the tokenizer by the hundred, a sentinel between."""
        one = self.tokenizer.encode_batch_fast
        groups = [distinct[i : i + 500] for i in range(0, len(distinct), 500)]
        flat, sizes = [], []
        coded = (np.array(e.ids, np.uint32) for i in range(0, len(groups), AT_ONCE) for e in one([f" {SENTINEL} ".join(g) for g in groups[i : i + AT_ONCE]], add_special_tokens=False))
        for g, ids in zip(groups, coded):
            cuts = np.flatnonzero(ids == self.sentinel[0]) if len(self.sentinel) == 1 else np.zeros(0, np.int64)
            if len(cuts) != len(g) - 1:  # a word holds the sentinel itself
                alone = [x.ids for x in one(g, add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in alone], np.int64))
                flat.append(np.array([i for x in alone for i in x], np.uint32))
                continue
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            flat.append(np.delete(ids, cuts))
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def look_up(self, hashes: np.ndarray, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the third array each of the distinct words has its ids, and how many. text: the words at positions."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        known = np.zeros(len(hashes), bool)
        known[order] = (at < len(self.hashes)) & (self.hashes[np.minimum(at, max(0, len(self.hashes) - 1))] == hashes[order]) if len(self.hashes) else False
        begins, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        slot = np.empty(len(hashes), np.int64)
        slot[order] = at
        begins[known], sizes[known] = self.begins[slot[known]], self.sizes[slot[known]]
        new = np.flatnonzero(~known)
        flat, n = self.encode(text(new))
        sizes[new], begins[new] = n, len(self.flat) + np.cumsum(n) - n
        every = np.concatenate([self.flat, flat])
        if len(self.hashes) < self.REMEMBER and len(new):
            merged = np.concatenate([self.hashes, hashes[new]])
            by = np.argsort(merged, kind="stable")
            self.hashes, self.begins, self.sizes = merged[by], np.concatenate([self.begins, begins[new]])[by], np.concatenate([self.sizes, n])[by]
            self.flat = every
        return begins, sizes, every


def token_ids(texts: list[bytes], coder: _Coder) -> Iterator[np.ndarray]:
    """The ids of each text and END. White space separates tokens, and case doesn't matter to this kind of tokenizer,
    so each distinct word is encoded once."""
    buf, offsets = joined(texts)
    starts, ends, hashes = words(buf, LOWER, KINDS)
    bounds = per_text(starts, offsets)
    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    begins, sizes, flat = coder.look_up(distinct, lambda at: [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[at]].tolist(), ends[first[at]].tolist())])
    per_word = sizes[back]
    upto = np.concatenate([[0], np.cumsum(per_word)])
    ids = flat[np.repeat(begins[back] - upto[:-1], per_word) + np.arange(upto[-1])] if len(flat) else flat
    cuts = upto[bounds]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield np.append(ids[a:b], np.uint32(END)).astype("<u4")


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.Table]:
    """Batches joined, or cut by rows, until their texts reach a size; what a chunk has freed goes back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    held, n = [], 0
    for b in _cut(batches, column, size):
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            t, held, n = pa.Table.from_batches(held), [], 0
            yield t
            del t
            give_back()
    if held:
        yield pa.Table.from_batches(held)
        give_back()


def _cut(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, int(b.num_rows * size / max(1, b.column(column).nbytes)))
        yield from (b.slice(i, step) for i in range(0, b.num_rows, step))


def raw_texts(t: pa.Table, column: str = "text") -> list[bytes]:
    return [x or b"" for x in t[column].cast(pa.binary()).to_pylist()]


def _items(tokenizer: str, window: int):
    schema = "doc_id long, h1 long, h2 long, part int, tokens long, full_before long, item int, rank long, crcs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, full, seen, coder = TaskContext.get().partitionId(), 0, np.zeros(window, np.int64), None
        for t in chunks(batches):
            coder = coder or _Coder(tokenizer)
            tokens, before, item, rank, crcs = [], [], [], [], []
            for ids in token_ids(raw_texts(t), coder):
                n, rest = len(ids), len(ids) % window
                raw = ids.tobytes()
                tokens.append(n)
                before.append(full)
                item.append(rest)
                rank.append(int(seen[rest]))
                crcs.append(np.array([zlib.crc32(raw[i : i + 4 * window]) for i in range(0, len(raw), 4 * window)], "<u4").tobytes())
                full += n // window
                seen[rest] += 1
            yield pa.RecordBatch.from_pydict({
                "doc_id": t["doc_id"].combine_chunks(), "h1": t["h1"].combine_chunks(), "h2": t["h2"].combine_chunks(), "part": pa.array([part] * len(tokens), pa.int32()), "tokens": pa.array(tokens, pa.int64()),
                "full_before": pa.array(before, pa.int64()), "item": pa.array(item, pa.int32()), "rank": pa.array(rank, pa.int64()), "crcs": pa.array(crcs, pa.binary()),
            })

    return run, schema


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths whose sum is the largest up to capacity: bitset subset sums, traced back to counts."""
    mask, bits, steps = (1 << (capacity + 1)) - 1, 1, []
    for length, n in sorted(counts.items(), key=lambda x: (-x[1], -x[0])):
        n = min(n, capacity // length)
        k = 1
        while n > 0:
            take = min(k, n)
            new = (bits | (bits << (length * take))) & mask
            if new != bits:
                steps.append((length, take, bits))
                bits = new
            n -= take
            k *= 2
        if bits >> capacity & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def pack_plan(histogram: dict[int, int], window: int) -> list[tuple]:
    """Rows (item, rank_from, rank_to, start, length, index_from, per_bin, sequence, offset): items of the given
    whole length with these ranks put [start, start + length) at offset + length * (i % per_bin) of the sequence
    sequence + i // per_bin, with i = index_from + rank - rank_from."""
    supply: dict[int, list[list[int]]] = {n: [[n, 0, 0, c]] for n, c in histogram.items() if c}  # length: [item, start, from, to]
    left = {n: c for n, c in histogram.items() if c}
    rows, sequence = [], 0

    def draw(length: int, n: int) -> list[tuple[int, int, int, int]]:
        out, queue = [], supply[length]
        left[length] -= n
        if not left[length]:
            del left[length]
        while n:
            item, start, a, b = queue[-1]
            m = min(n, b - a)
            out.append((item, start, a, a + m))
            queue[-1][2] += m
            if a + m == b:
                queue.pop()
            n -= m
        return out

    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        used = closest_fill(rest, window - longest)
        used[longest] = used.get(longest, 0) + 1
        gap = window - sum(n * k for n, k in used.items())
        spare = [n for n in left if left[n] > used.get(n, 0)] if gap else []
        cut = max(spare, default=0)
        bins = min(left[n] // (k + (n == cut)) for n, k in used.items())
        if cut and cut not in used:
            bins = min(bins, left[cut])
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            index = 0
            for item, start, a, b in draw(n, k * bins):
                rows.append((item, a, b, start, n, index, k, sequence, offset))
                index += b - a
            offset += n * k
        if cut:
            index = 0
            for item, start, a, b in draw(cut, bins):
                rows.append((item, a, b, start, gap, index, 1, sequence, offset))
                supply.setdefault(cut - gap, []).append([item, start + gap, a, b])
                left[cut - gap] = left.get(cut - gap, 0) + b - a
                index += b - a
        sequence += bins
    return rows


PLAN = "item int, rank_from long, rank_to long, start long, length long, index_from long, per_bin long, sequence long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))
    run, schema = _items(tokenizer, window)
    items = staged_small(source.mapInArrow(released(run), schema), "items")
    counts = items.groupBy("part", "item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("tokens") / window)).alias("full"))
    counts = staged(counts, "counts")
    histogram = {r["item"]: r["n"] for r in counts.filter("item > 0").groupBy("item").agg(F.sum("n").alias("n")).collect()}
    plan = pack_plan(histogram, window)
    packed = max((r[7] + -(-(r[5] + r[2] - r[1]) // r[6]) for r in plan), default=0)
    # whole windows come after the packed sequences
    parts = counts.groupBy("part").agg(F.sum("full").alias("full"))
    base = parts.select("part", (F.sum("full").over(Window.orderBy("part")) - F.col("full") + packed).alias("window_base"))
    ranks = counts.select("part", "item", (F.sum("n").over(Window.partitionBy("item").orderBy("part")) - F.col("n")).alias("rank_base"))
    full = (
        items.filter(F.col("tokens") >= window)
        .join(F.broadcast(base), "part")
        .withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("tokens") / window).cast("int") - 1)))
        .select("doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), _crc(F.col("i")), F.col("tokens").alias("doc_tokens"), (F.col("window_base") + F.col("full_before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    ranked = items.filter("item > 0").join(ranks, ["part", "item"]).withColumn("rank", F.col("rank") + F.col("rank_base"))
    at = F.col("index_from") + F.col("rank") - F.col("rank_from")
    placed = (
        ranked.mapInArrow(released(_locate(plan)), f"{_RANKED}, {PLAN.replace('item int, ', '')}")
        .withColumn("i", at)
        .select("doc_id", "h1", "h2", "item", "crcs", "tokens", "start", "length", (F.col("sequence") + F.floor(F.col("i") / F.col("per_bin"))).alias("sequence_id"), (F.col("offset") + F.col("length") * F.pmod("i", "per_bin")).alias("offset"))
        .withColumn("first", F.col("tokens") - F.col("item"))
    )
    placed = staged(placed, "placed")
    out = ["doc_id", (F.col("first") + F.col("start")).alias("start"), "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset"]
    whole = placed.filter("length = item").withColumn("ids_crc32", _crc(F.floor(F.col("tokens") / window))).select(*out)
    cut = placed.filter("length < item")
    spans = cut.select("h1", "h2", F.struct((F.col("first") + F.col("start")).alias("a"), "length").alias("span")).distinct().groupBy("h1", "h2").agg(F.collect_list("span").alias("spans"))
    again = passing(source, key_filter(spans, "h1"), F.col("h1"))
    crcs = again.select("h1", "h2", "text").join(spans, ["h1", "h2"]).mapInArrow(released(_cut_crcs(tokenizer)), "h1 long, h2 long, a long, length long, ids_crc32 long")
    crcs = staged_small(crcs.groupBy("h1", "h2", "a", "length").agg(F.max("ids_crc32").alias("ids_crc32")), "crcs")
    pieces = cut.withColumn("a", F.col("first") + F.col("start")).join(crcs, ["h1", "h2", "a", "length"]).select(*out)
    return full.unionByName(whole).unionByName(pieces)


_RANKED = "doc_id long, h1 long, h2 long, item int, crcs binary, tokens long, rank long"


def _crc(i):
    """The i-th little-endian 32-bit number of crcs."""
    h = F.hex("crcs")
    byte = lambda k: F.substring(h, i.cast("int") * 8 + 2 * k + 1, F.lit(2))
    return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long").alias("ids_crc32")


def _locate(plan: list[tuple]):
    """Joins items to the plan's rows by length and rank; the plan has a few rows per length of the window."""
    by_item: dict[int, list] = {}
    for r in plan:
        by_item.setdefault(r[0], []).append(r[1:])
    tables = {k: np.array(sorted(v), np.int64) for k, v in by_item.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rank_from", "rank_to", "start", "length", "index_from", "per_bin", "sequence", "offset"]
        for b in batches:
            item, rank = b["item"].to_numpy(), b["rank"].to_numpy()
            rows, hits = [], []
            for length in np.unique(item):
                t = tables[int(length)]
                own = np.flatnonzero(item == length)
                # ranges of a length that was cut overlap: each piece of the item is one range
                for start in np.unique(t[:, 2]):
                    s = t[t[:, 2] == start]
                    k = np.searchsorted(s[:, 0], rank[own], "right") - 1
                    ok = (k >= 0) & (rank[own] < s[np.maximum(k, 0), 1])
                    rows.append(own[ok])
                    hits.append(s[k[ok]])
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            found = np.concatenate(hits) if hits else np.zeros((0, 8), np.int64)
            left = b.select(["doc_id", "h1", "h2", "item", "crcs", "tokens", "rank"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*left.columns, *(pa.array(found[:, i]) for i in range(8))], names=[*left.schema.names, *names])

    return run


def _cut_crcs(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for t in chunks(batches):
            coder, rows = coder or _Coder(tokenizer), []
            for h1, h2, spans, ids in zip(t["h1"].to_pylist(), t["h2"].to_pylist(), t["spans"].to_pylist(), token_ids(raw_texts(t), coder)):
                rows += [(h1, h2, s["a"], s["length"], zlib.crc32(ids[s["a"] : s["a"] + s["length"]].tobytes())) for s in spans]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h1", "h2", "a", "length", "ids_crc32"])

    return run
