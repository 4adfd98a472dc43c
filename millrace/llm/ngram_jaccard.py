"""N-gram Jaccard join with count-vector R-trees.

A document is its set of word shingles, hashed to 64 bits. The exact join runs in four steps:

1. Equal sets are one class, so copies are never paired.
2. Distribution. Let q(n) = n - ceil(t n) be the shingles that a set may have and a linked one not. In any common
   order, the first q + l shingles of two linked sets share l at least. The order puts shingles that many sets hold
   last, by a sketch of counts of fixed size. Which fingerprints of these prefixes occur again is told by a
   Golomb-coded exchange; a set with fewer such than l has no link and drops out, so a passage that many documents
   share doesn't bring them together. What is left is counted exactly, and of c fingerprints the c - l + 1 rarest
   still hold a common one; sets that share one of these are in one candidate component.
3. Inside a component (large ones are cut by bands of sizes, of which only neighbours can link, and bands into blocks;
   pairs of blocks are tasks) an R-tree holds each set's counts
   by hash group as a point. The summed minima of two boxes' upper corners, and then of two points, bound the overlap;
   pairs that survive are verified on the sets. Tasks return spanning edges and link counts, never all pairs.
4. Components of the verified links.

Defined cases: null and empty texts have no shingles and no links; fewer words than the width make one shingle; rows
that repeat are copies of each other; a row with a null id takes part, its component_id is the smallest id that it
reaches, null if there is none; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, key_filter, passing, released, released_group, shrink_heaps, small_batches, staged, without
from .components import components
from .exchange import BITS, owners_of, repeated, with_replies
from .packing import chunks, raw_texts
from .wordhash import joined, mix, per_text, shingle_sets, words

DIMENSIONS, LEAF = 64, 32
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 3_000_000
SKETCH_BITS, SLICES = 21, 64


def slack(n: int, percent: int) -> int:
    """How many shingles of a set of n a linked set may lack."""
    return n - -(-n * percent // 100)


def shared_least(n: int, percent: int) -> int:
    """How many shingles beyond the slack are in a prefix."""
    return max(1, slack(n, percent))


def prefix(s: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first by level of their count, then by hash."""
    keep = slack(len(s), percent) + shared_least(len(s), percent)
    key = (levels[s >> np.uint64(64 - SKETCH_BITS)] << np.uint64(58)) | (s >> np.uint64(6))
    return s if keep >= len(s) else s[np.argpartition(key, keep - 1)[:keep]]


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    buf, offsets = joined(texts)
    starts, _, hashes = words(buf)
    return shingle_sets(hashes, per_text(starts, offsets), width)


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _distinct(sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[int]]:
    """Digests of the sets, and the positions of the first of each kind: one of a chunk's copies speaks for all."""
    digests = [_digest(s) if len(s) else (0, 0) for s in sets]
    first = {d: i for i, d in reversed(list(enumerate(digests))) if len(sets[i])}
    return digests, sorted(first.values())


def _describe(width: int):
    """A row for each document, and after them slices of the partition's sketch of shingle counts."""
    schema = "doc_id long, th long, uid long, n long, d1 long, d2 long, slice int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, sketch = TaskContext.get().partitionId() << 33, np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "th", "uid", "n", "d1", "d2", "slice", "counts"]
        for t in chunks(batches):
            sets = _sets(raw_texts(t), width)
            digests, first = _distinct(sets)
            if first:
                cells = np.concatenate([sets[k] for k in first]) >> np.uint64(64 - SKETCH_BITS)
                sketch += np.bincount(cells.astype(np.int64), minlength=len(sketch))
            n = len(sets)
            rows = [t["doc_id"].combine_chunks(), t["th"].combine_chunks(), pa.array(uid + np.arange(n)), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            uid += n
        if sketch.any():
            parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(sketch, SLICES)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, pa.int64())] * 6, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run, schema


def _add_slices(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<u4").astype(np.float64) for x in t["counts"])
    return pa.table({"slice": t["slice"][:1], "levels": [np.floor(np.log2(total + 1)).astype(np.uint8).tobytes()]})


def _prefixes(width: int, percent: int, levels):
    """Blocks of the prefixes of a chunk's distinct sets: fingerprints, and of which set each run is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, level = TaskContext.get().partitionId(), 0, levels.value
        for t in chunks(batches):
            sets = _sets(raw_texts(t), width)
            digests, first = _distinct(sets)
            found = [prefix(sets[i], percent, level) for i in first]
            if found:
                prints = np.concatenate(found) >> np.uint64(64 - BITS)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([f"{part}-{at}"]), "prints": pa.array([prints.astype("<u8").tobytes()]),
                    "sets": pa.array([np.array([digests[i][0] for i in first], "<i8").tobytes()]), "sizes": pa.array([np.array([len(x) for x in found], "<i8").tobytes()]),
                    # a linked set may be smaller, and share as many as that one's prefix promises
                    "least": pa.array([np.array([shared_least(-(-len(sets[i]) * percent // 100), percent) for i in first], "<i8").tobytes()]),
                })
                at += 1

    return run, "block string, prints binary, sets binary, sizes binary, least binary"


def _shared(owners: int):
    """Fingerprints that occur again, with their sets, if a set has enough of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                prints = np.frombuffer(r["prints"], "<u8")
                hit = repeated(prints, r["replies"], owners)
                ids, sizes, least = (np.frombuffer(r[c], "<i8") for c in ("sets", "sizes", "least"))
                of = np.repeat(np.arange(len(ids)), sizes)
                hit &= (np.bincount(of, hit, len(ids)) >= least)[of]
                yield pa.RecordBatch.from_pydict({"g": pa.array(prints[hit].astype(np.int64)), "d1": pa.array(ids[of[hit]]), "least": pa.array(least[of[hit]])})

    return run


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            sets = [s.tobytes() for s in _sets(raw_texts(t), width)]
            rest = t.drop_columns(["text"])
            for b in rest.append_column("shingles", pa.array(sets, pa.binary())).to_batches():
                yield b

    return run


class CountTree:
    """R-tree, bulk-loaded, over the counts of each set's shingles by hash group."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        points = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=DIMENSIONS) for s in sets]).astype(np.int32)
        # tiles: by size, then inside runs of equal rank by the coordinate that varies most
        widest = int(points.var(axis=0).argmax())
        run = max(LEAF, int(np.sqrt(len(sets) / LEAF)) * LEAF)
        by_size = np.lexsort((points[:, widest], self.sizes))
        rank = np.empty(len(sets), np.int64)
        rank[by_size] = np.arange(len(sets)) // run
        self.order = np.lexsort((points[:, widest], rank))
        self.points = points[self.order]
        self.sizes = self.sizes[self.order]
        cuts = np.arange(0, len(sets), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts))]
        while len(self.levels[-1][0]) > 1:
            upper, low, high = self.levels[-1]
            cuts = np.arange(0, len(upper), 8)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def leaves(self, i: int) -> slice:
        return slice(i * LEAF, min((i + 1) * LEAF, len(self.sizes)))


def candidates(a: CountTree, b: CountTree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in the trees' orders) of pairs that the count bound lets through; each pair once if same."""

    def fits(x, y) -> np.ndarray:
        """For boxes or points x and y: (upper corner, least size, greatest size) of each."""
        overlap = np.minimum(x[0][:, None, :], y[0][None, :, :]).sum(axis=2)
        need = (x[1][:, None] + y[1][None, :]) * percent
        ok = (100 + percent) * overlap >= need
        # sizes: the smaller set holds at least percent of the larger
        ok &= x[2][:, None] * 100 >= y[1][None, :] * percent
        ok &= y[2][None, :] * 100 >= x[1][:, None] * percent
        return ok

    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    stack = [(top_a, 0, top_b, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            if same and i > j:
                continue
            sa, sb = a.leaves(i), b.leaves(j)
            ok = fits((a.points[sa], a.sizes[sa], a.sizes[sa]), (b.points[sb], b.sizes[sb], b.sizes[sb]))
            x, y = np.nonzero(ok)
            x, y = x + sa.start, y + sb.start
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
            continue
        # open the higher node
        if la >= lb:
            xs = range(8 * i, min(8 * i + 8, len(a.levels[la - 1][0])))
            la, ys = la - 1, [j]
        else:
            ys = range(8 * j, min(8 * j + 8, len(b.levels[lb - 1][0])))
            lb, xs = lb - 1, [i]
        x, y = np.array(list(xs)), np.array(list(ys))
        ok = fits(tuple(v[x] for v in a.levels[la]), tuple(v[y] for v in b.levels[lb]))
        stack += [(la, int(x[p]), lb, int(y[q])) for p, q in zip(*np.nonzero(ok))]


def overlaps(a: list[np.ndarray], b: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections a[x] and b[y]: one by one, or by products of token columns when pairs are many."""
    if len(x) <= 4 * (len(a) + len(b)):
        return np.array([len(a[i]) + len(b[j]) - len(np.unique(np.concatenate([a[i], b[j]]))) for i, j in zip(x.tolist(), y.tolist())], np.int64)
    na = len(a)
    every, sizes = np.concatenate([*a, *b]), np.array([len(s) for s in [*a, *b]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, token, count = np.unique(every, return_inverse=True, return_counts=True)
    often = (count > 1)[token]
    _, token = np.unique(token[often], return_inverse=True)
    owner, order = owner[often], np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    total = np.zeros((na, len(b)), np.float32)
    width = 2048
    for c in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        lo, hi = np.searchsorted(token, [c, c + width])
        m = np.zeros((len(sizes), width), np.float32)
        m[owner[lo:hi], token[lo:hi] - c] = 1
        total += m[:na] @ m[na:].T
    return total[x, y].astype(np.int64)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in a and b (or within a) whose sets have a Jaccard similarity of percent / 100 or more."""
    ta = CountTree(a)
    tb = CountTree(b) if b is not None else ta
    found = [(ta.order[x], tb.order[y]) for x, y in candidates(ta, tb, percent, b is None)]
    if not found:
        return
    x, y = (np.concatenate(v) for v in zip(*found))
    other = a if b is None else b
    both = overlaps(a, other, x, y)
    union = np.array([len(s) for s in a])[x] + np.array([len(s) for s in other])[y] - both
    ok = 100 * both >= percent * union
    yield x[ok], y[ok]


def _join(percent: int):
    schema = "node long, other long, links long"

    def run(t: pa.Table) -> pa.Table:
        node, comp, side = (t[c].to_numpy() for c in ("node", "comp", "side"))
        copies, raw = t["copies"].to_numpy(), t["shingles"]
        out: list[list[np.ndarray]] = [[], [], []]
        _, first = np.unique(np.stack([comp, node]), axis=1, return_index=True)  # rows that repeat an id and text
        order = first[np.lexsort((node[first], comp[first]))]
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in rows]
            sides = side[rows]
            if sides[0] == 2:  # all pairs of the rows; else of those of side 0 with those of side 1
                pairs = linked(sets, None, percent)
                left = right = np.arange(len(rows))
            else:
                left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
                if not len(left) or not len(right):
                    continue
                pairs = linked([sets[i] for i in left], [sets[i] for i in right], percent)
            forest, links = Forest(len(rows)), np.zeros(len(rows), np.int64)
            for x, y in pairs:
                x, y = left[x], right[y]
                np.add.at(links, x, copies[rows[y]])
                np.add.at(links, y, copies[rows[x]])
                for i, j in zip(x.tolist(), y.tolist()):
                    forest.join(i, j)
            root = np.array([forest.find(i) for i in range(len(rows))])
            hit = np.flatnonzero(links)
            out[0].append(node[rows[hit]])
            out[1].append(node[rows[root[hit]]])
            out[2].append(links[hit])
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(cols, names=["node", "other", "links"])

    return run, schema


def many_of(block_rows: int):
    return F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _tasks(tasks: int):
    """Where a set goes: one bucket of small components, or for a large component the pairs of its block with the
    blocks of its band, of the band above (it is the lower side) and of the band below (it is the upper side)."""
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")

    def to(group, side):
        return F.struct(group.alias("key"), group.alias("group"), side.cast("int").alias("side"))

    upto = lambda c: F.slice(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(0))), 1, F.coalesce(F.col(c), F.lit(0)))
    inside = F.transform(upto("blocks"), lambda j: to(F.xxhash64("comp", "band", F.lit(0), F.least(own, j), F.greatest(own, j)), F.when(own == j, 2).otherwise((own > j).cast("int"))))
    above = F.transform(upto("up"), lambda j: to(F.xxhash64("comp", "band", F.lit(1), own, j), F.lit(0)))
    below = F.transform(upto("down"), lambda j: to(F.xxhash64("comp", F.col("band") - 1, F.lit(1), j, own), F.lit(1)))
    small = F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("key"), F.col("comp").alias("group"), F.lit(2).alias("side")))
    return F.when(F.col("large"), F.concat(inside, above, below)).otherwise(small)


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, n_links (documents at percent / 100 similarity or more),
    text_hash."""
    with small_batches(docs.sparkSession):
        return _join_documents(docs, width, percent, block_rows)


def _join_documents(docs: DataFrame, width: int, percent: int, block_rows: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    run, schema = _describe(width)
    both = staged(source.mapInArrow(released(run), schema), "sets")
    table = both.filter("slice is null").drop("slice", "counts")
    slices = both.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(released_group(_add_slices), "slice int, levels binary").collect()
    levels = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in slices:  # 2 ^ SKETCH_BITS bytes in all, however large the input
        levels[r["slice"] << (SKETCH_BITS - SLICES.bit_length() + 1) : (r["slice"] + 1) << (SKETCH_BITS - SLICES.bit_length() + 1)] = np.frombuffer(r["levels"], np.uint8)
    classes = staged(
        table.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("uid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th")).alias("first")),
        "classes",
    )
    shrink_heaps(spark)
    # classes that share a shingle of their prefixes, by way of the shingle's smallest class
    run, schema = _prefixes(width, percent, spark.sparkContext.broadcast(levels))
    blocks = staged(source.select("text").mapInArrow(released(run), schema), "prefixes")
    owners = owners_of(blocks)
    found = staged(with_replies(blocks, owners).mapInArrow(released(_shared(owners)), "g long, d1 long, least long").distinct(), "shared")
    discard(blocks)
    # of the c fingerprints that a set has left, the c - least + 1 rarest hold one of each linked set's
    rarity = found.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    left = found.join(rarity, "g").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("d1"))).withColumn("rank", F.row_number().over(Window.partitionBy("d1").orderBy("df", "g")))
    grouped = staged(left.filter(F.col("rank") <= F.col("c") - F.col("least") + 1).select("g", "d1"), "indexed")
    discard(found)
    shared = grouped.groupBy("g").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low <> high")
    near = components(grouped.join(shared.select("g", "low"), "g").filter("d1 <> low").select(F.col("d1").alias("a"), F.col("low").alias("b")))
    found = staged(classes.join(near.select(F.col("node").alias("d1"), F.col("root").alias("comp")), "d1"), "candidates")
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight")).filter("rows > 1")
    total = found.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, total // BLOCK_SHINGLES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    many = lambda r, w: F.ceil(F.greatest(F.col(r) / block_rows, F.col(w) / BLOCK_SHINGLES)).cast("int")
    found = found.join(sizes.select("comp", (many("rows", "weight") > 1).alias("large")), "comp")
    # sets of linked sizes are in the same band or in neighbours: a band is as wide as the threshold allows
    band = F.floor(F.log("n") / (F.log(F.lit(100.0 / percent)) * 1.000001)).cast("int")
    found = found.select("node", "comp", "copies", "large", "n", band.alias("band"), F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"))
    bands = found.filter("large").groupBy("comp", "band").agg(many_of(block_rows).alias("blocks"))
    near_by = bands.select("comp", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up")).alias("u")
    below = bands.select("comp", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down")).alias("l")
    bands = bands.join(near_by, ["comp", "band"], "left").join(below, ["comp", "band"], "left").na.fill(0, ["up", "down"])
    found = found.join(bands, ["comp", "band"], "left").drop("n")
    found = staged(found, "wanted")
    shrink_heaps(spark)
    # texts of candidates only, by a pre-filter of bounded size and then exactly
    scan = passing(source, key_filter(found, "th"), F.col("th"))
    wanted = scan.withColumnRenamed("doc_id", "_id").join(found, "th").filter(F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "comp", "copies", "large", "band", "blocks", "up", "down", "text")
    sets = wanted.mapInArrow(released(_with_sets(width)), "node long, comp long, copies long, large boolean, band int, blocks int, up int, down int, shingles binary")
    dealt = sets.withColumn("task", F.explode(_tasks(tasks))).select(F.col("task.key").alias("key"), "node", F.col("task.group").alias("comp"), "copies", F.col("task.side").alias("side"), "shingles")
    run, schema = _join(percent)
    links = staged(dealt.groupBy("key").applyInArrow(released_group(run), schema), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    member = classes.join(roots, "node").join(counted, "node")
    lowest = member.groupBy("root").agg(F.min("low").alias("lowest"))
    member = member.join(lowest, "root").select("node", "lowest", "links")
    told = classes.join(member, "node", "left").select("d1", "d2", "n", F.coalesce("lowest", "low").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = table.select("doc_id", "th", "n", "d1", "d2").join(told, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("th").alias("text_hash"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of linked ones: the one that the group is named after.

    Documents without words stay, as do rows with a null id; rows that repeat an id are told apart by their texts, and
    of rows that repeat both, all stay or go."""
    found = staged(jaccard_join(docs, width, percent), "near")
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return without(docs, found.filter("doc_id <> component_id"), doc_id=F.col("doc_id").cast("long"), text_hash=text)
