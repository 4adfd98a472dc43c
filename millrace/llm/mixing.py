"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. The flow sends words from patterns through their
sources to the sources' targets; the n-th repetition of a pattern costs 2 n - 1 a word, so repetition is spread evenly
and only where targets need it. A pattern whose flow is b + f times its size (0 <= f < 1) takes all its documents b
times and a seeded part of them, with a share f of its words, once more. That part is found by two levels of
histograms over a hash of the id and a fit among the hash values around the cut, so that no task ever holds a
pattern's documents and no order is needed.

Defined cases: null text has size 0; a null source is a source of its own, last in the order; repeated rows (and rows
with a null id) share their hash, so they are taken together; an empty table gives an empty result; other columns
don't matter. More than max_patterns patterns raise an error, as the flow runs on the driver.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, staged, unboxed

LEVEL = 12  # bits of each histogram level
SPARE = 64  # documents looked at around a cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def membership(members: Column) -> Column:
    """Pattern of an array of sources: JSON of its sorted distinct values, nulls last."""
    return F.to_json(F.array_sort(F.array_distinct(members)))


def targets(sizes: dict, weights: list[float], share: float, most: float) -> dict:
    """Words wanted of each source: `share` of all by weight; what is above `most` times a source is reshared."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in order if s in free)
        over = [s for s in order if s in free and left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in order if s in free}
        for s in over:
            out[s] = most * float(sizes[s])
            free.remove(s)
        left -= sum(out[s] for s in over)
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, float, float]], s: int, t: int) -> list[float]:
    """Flow on each (from, to, capacity, cost) arc of a maximum flow of least cost: shortest augmenting paths."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, c2, w2 in ((a, b, c, w), (b, a, 0.0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(c2)
            cost.append(w2)
    tiny = 1e-9 * max([1.0, *(c for *_, c, _ in arcs if c < float("inf"))])
    while True:
        far, via, queued, queue = [float("inf")] * n, [-1] * n, [False] * n, deque([s])
        far[s] = 0.0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in head[x]:
                if cap[e] > tiny and far[x] + cost[e] < far[to[e]] - 1e-12:
                    far[to[e]], via[to[e]] = far[x] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if via[t] < 0:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        path, x = [], t
        while x != s:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: dict[str, float], wanted: dict, most: int) -> dict[str, float]:
    """Words taken of each pattern."""
    names, sources = sorted(patterns), list(wanted)
    where = {x: 1 + len(names) + i for i, x in enumerate(sources)}
    end = 1 + len(names) + len(sources)
    arcs = [(0, 1 + i, float(patterns[p]), 2.0 * r + 1) for i, p in enumerate(names) for r in range(most)]
    first = len(arcs)
    arcs += [(1 + i, where[x], float("inf"), 0.0) for i, p in enumerate(names) for x in json.loads(p)]
    arcs += [(where[x], end, float(wanted[x]), 0.0) for x in sources]
    flow = min_cost_flow(end + 1, arcs, 0, end)
    return {p: sum(flow[i * most : (i + 1) * most]) for i, p in enumerate(names) if first}


def seeded(doc_id: Column, seed: int) -> Column:
    """A non-negative hash of 24 bits."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 64 - 2 * LEVEL)


def _fit(near: pa.Table) -> pa.Table:
    """Hash values go in by order; where one is too large for what is still wanted, later ones that fit go in. A task
    gets sums by hash value of a few buckets: some thousands of rows however many documents there are."""
    near = near.sort_by("_u")
    rest, cut, more = near["rest"][0].as_py(), near["low"][0].as_py() << LEVEL, []
    whole, smallest_miss = True, None
    for u, s in zip(near["_u"].to_pylist(), near["s"].to_pylist()):
        if s <= rest:
            rest -= s
            if whole:
                cut = u + 1
            else:
                more.append(u)
        else:
            whole = False
            smallest_miss = min(smallest_miss or (s, u), (s, u))
    if smallest_miss and smallest_miss[0] < 2 * rest:  # then to overshoot is nearer
        more.append(smallest_miss[1])
    return pa.table({"pattern": pa.array([near["pattern"][0].as_py()], pa.string()), "cut": pa.array([cut], pa.int64()), "more": pa.array([more], pa.list_(pa.int64()))})


class Mixture:
    """What a mix decides: by pattern, whole repetitions and the cut below which a document gets one more."""

    def __init__(self, sized: DataFrame, weights: list[float], share: float, most: int, seed: int, max_patterns: int = 100_000):
        """sized: doc_id, size, pattern."""
        spark = sized.sparkSession
        self.seed = seed
        found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
        if len(found) > max_patterns:
            raise ValueError(f"more than {max_patterns} membership patterns")
        patterns = {r["pattern"]: r["size"] for r in found}
        self.source_sizes: dict = {}
        for p, size in patterns.items():
            for x in json.loads(p):
                self.source_sizes[x] = self.source_sizes.get(x, 0) + size
        self.targets = targets(self.source_sizes, weights, share, float(most)) if self.source_sizes else {}
        taken = route(patterns, self.targets, most)
        rows = []
        for p, size in patterns.items():
            words = min(taken.get(p, 0.0), float(most * size))
            base = min(most, int(words / size + 1e-9)) if size else 0
            rows.append((p, base, max(0, round(words - base * size))))
        self.plan = self._cuts(spark, sized, rows)

    def _cuts(self, spark: SparkSession, sized: DataFrame, rows: list) -> DataFrame:
        plan = spark.createDataFrame(rows, "pattern string, base int, want long")
        hashed = sized.withColumn("_u", seeded(F.col("doc_id"), self.seed)).withColumn("_b", F.shiftright("_u", LEVEL))
        partly = F.broadcast(plan.filter("want > 0"))
        coarse = hashed.join(partly, "pattern").groupBy("pattern", "want", "_b").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("pattern").orderBy("_b")
        coarse = coarse.withColumn("before", F.sum("s").over(order) - F.col("s")).withColumn("n_upto", F.sum("n").over(order))
        # from the bucket where the wanted words end on, as many buckets as hold SPARE documents
        edge = coarse.withColumn("inside", F.col("before") < F.col("want")).groupBy("pattern", "want").agg(
            F.max(F.when(F.col("inside"), F.struct("_b", "before", "n_upto"))).alias("e"),
            F.sort_array(F.collect_list(F.when(~F.col("inside"), F.struct("_b", "n_upto")))).alias("later"),
        )
        last = F.get(F.filter("later", lambda x: x["n_upto"] >= F.col("e.n_upto") + SPARE), 0)["_b"]
        edge = edge.select("pattern", F.col("e._b").alias("low"), F.coalesce(last, F.lit(1 << LEVEL)).alias("high"), (F.col("want") - F.col("e.before")).alias("rest"))
        near = hashed.join(F.broadcast(edge), "pattern").filter("_b between low and high").groupBy("pattern", "low", "rest", "_u").agg(F.sum("size").alias("s"))
        cuts = near.groupBy("pattern").applyInArrow(_fit, "pattern string, cut long, more array<long>")
        return staged(plan.join(cuts, "pattern", "left").select("pattern", "base", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), F.coalesce("more", F.array().cast("array<long>")).alias("more")), "mix")

    def repeats(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, pattern, ...) with the column `repeats`; no shuffle."""
        u = seeded(F.col("doc_id"), self.seed)
        extra = (u < F.col("cut")) | F.array_contains("more", u)
        return docs.join(F.broadcast(self.plan), "pattern", "left").withColumn("repeats", F.coalesce(F.col("base") + extra.cast("int"), F.lit(0))).drop("base", "cut", "more")


WEIGHTS, SHARE, MOST, SEED = [3.0, 1.0, 2.0], 1.5, 2, 7


def by_source(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs with size and the pattern of its single source."""
    return docs.select(*(keep or ["doc_id"]), word_count(F.col("text")).alias("size"), membership(F.array("source")).alias("pattern"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sized = staged(by_source(docs.select("doc_id", "text", "source")), "sizes")
    mix = Mixture(sized, WEIGHTS, SHARE, MOST, SEED)
    rows = [(json.dumps([s], ensure_ascii=False, separators=(",", ":")), int(n), float(mix.targets[s])) for s, n in mix.source_sizes.items()]
    spark = docs.sparkSession
    told = spark.createDataFrame(rows, "pattern string, source_size long, target double")
    # the key is made by Spark's own JSON writer on both sides
    told = told.select(membership(F.from_json("pattern", "array<string>")).alias("pattern"), "source_size", "target")
    return mix.repeats(sized).join(F.broadcast(told), "pattern").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    sized = staged(by_source(docs.select("doc_id", "text", "source")), "sizes")
    mix = Mixture(sized, WEIGHTS, SHARE, MOST, SEED)
    marked = mix.repeats(boxed(docs, doc_id=F.col("doc_id"), pattern=membership(F.array("source"))))
    return unboxed(marked.filter("repeats > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("repeats")))), docs.columns)
