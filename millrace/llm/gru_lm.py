"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Counts of all training words make the vocabulary. Its HEAD most frequent words are in classes of MEMBERS and have input
vectors and a softmax inside their class; every other word, known or not, is in one of TAILS classes by its last two
bytes, with its share of the corpus counts inside the class. A word's probability is its class's, by the recurrent
state, times its share of the class. All words have some probability: an unknown word gets a count of 0 + 1.

Training is data-parallel: training documents are dealt by hash to shards, whose number follows from the number of
training tokens alone, and to rounds. In each round every shard continues from the shared weights on its documents, in
the order of a hash, by truncated backpropagation; the weights are averaged by tokens, SHARDS_AT_ONCE shards at a time.
So each training document is learnt from once, and neither partitions nor the number of executors change the result.
While training, texts are cut into segments of SEGMENT tokens that start without a state, so that long ones don't run
alone. Scoring runs the documents of a chunk side by side, longest
first, window by window; the state goes on from window to window to the end of each text. Counts of words beyond the
TABLE most frequent are joined by hash, so that no table that grows with the input is broadcast.

Defined cases: null and empty texts are the end token alone; with no training documents there are no counts, and the
model is uniform over its classes; rows that repeat are scored each; an empty table gives an empty result; other
columns don't matter; a row with a null id trains and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, released, released_group, staged, staged_small
from .packing import chunks, raw_texts
from .wordhash import LOWER, joined, per_text, words

HIDDEN, EMBED, HEAD, MEMBERS, TAILS = 16, 16, 2048, 32, 64
CLASSES = HEAD // MEMBERS + TAILS
FIRST = HEAD + TAILS  # input before the first word
TABLE = 1 << 20
END_HASH = np.uint64(1)
ROUNDS = 3
LANES, WINDOW, RATE = 128, 16, 0.01
SHARD_TOKENS, SHARDS_AT_ONCE = 1 << 20, 16
PIECE = 16  # rows of a class that are multiplied at once
STATES = 1 << 16  # states that wait for their outputs in scoring
SEGMENT, UNIT = 2048, 1 << 20  # tokens of a lane; bytes of text learnt from at a time


def _last_two(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tail class of words by their last two bytes, lower-cased."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] = low[97:123]
    a = low[buf[ends - 1]].astype(np.int64)
    b = np.where(ends - starts > 1, low[buf[np.maximum(ends - 2, 0)]], 0).astype(np.int64)
    return (a * 31 + b * 7) % TAILS


class Tokens:
    """Tokens of texts: index into distinct words (the last one is the end), and each text's bounds."""

    def __init__(self, texts: list[bytes]):
        import pandas as pd  # here, so that workers which never count words don't hold it

        buf, offsets = joined(texts)
        starts, ends, hashes = words(buf, LOWER)
        bounds = per_text(starts, offsets)
        back, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[back[::-1]] = np.arange(len(back))[::-1]
        self.hashes = np.append(distinct.astype(np.uint64), END_HASH)
        self.tails = np.append(_last_two(buf, starts[first], ends[first]), 0)
        sizes = np.diff(bounds)
        self.bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.index = np.full(int(self.bounds[-1]), len(distinct), np.int64)
        self.index[np.arange(len(back)) + np.repeat(np.arange(len(sizes)), sizes)] = back


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, size=8 << 20):  # a word comes once a chunk
        k = Tokens(raw_texts(t))
        n = np.bincount(k.index, minlength=len(k.hashes))
        yield pa.RecordBatch.from_pydict({"h": pa.array(k.hashes.view(np.int64)), "tail": pa.array(k.tails.astype(np.int32)), "n": pa.array(n.astype(np.int64))})


class Vocabulary:
    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tails: np.ndarray, total: int, distinct: int, tail_sums: np.ndarray):
        """hashes, counts, tails: of the most frequent words; tail_sums: of count + 1 over all words by tail class."""
        self.total, self.distinct = total, distinct
        order = np.lexsort((hashes, -counts))
        head = order[: HEAD]
        self.head_counts = np.zeros(HEAD)
        self.head_counts[: len(head)] = counts[head]
        self.sums = tail_sums - np.bincount(tails[head], counts[head] + 1, TAILS) + 1
        by = np.argsort(hashes)
        self.hashes, self.counts = hashes[by], counts[by]
        rank = np.full(len(hashes), -1, np.int64)
        rank[head] = np.arange(len(head))
        self.rank = rank[by]

    def look_up(self, k: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words: count (-1: not in the table), rank in the head (-1: not there), class."""
        at = np.minimum(np.searchsorted(self.hashes, k.hashes), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == k.hashes if len(self.hashes) else np.zeros(len(k.hashes), bool)
        count = np.where(hit, self.counts[at] if len(self.hashes) else 0, -1 if self.distinct > len(self.hashes) else 0)
        rank = np.where(hit, self.rank[at], -1) if len(self.hashes) else np.full(len(k.hashes), -1)
        return count, rank, np.where(rank >= 0, rank // MEMBERS, HEAD // MEMBERS + k.tails)


class Head:
    """What training needs of a vocabulary: the ranks of the most frequent words."""

    def __init__(self, v: Vocabulary):
        own = np.flatnonzero(v.rank >= 0)
        self.hashes, self.rank = v.hashes[own], v.rank[own]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], -1)


def start_weights(v: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    """Random, but for biases that make the first model that of the word counts."""
    rng = np.random.default_rng(seed)
    head = v.head_counts + 1e-3
    mass = np.concatenate([head.reshape(-1, MEMBERS).sum(axis=1), np.maximum(v.sums, 1.0)])
    normal = lambda *s, by=1.0: rng.normal(0, by, s).astype(np.float32)
    return {
        "vectors": normal(FIRST + 1, EMBED, by=0.3), "in": normal(EMBED, 3 * HIDDEN, by=EMBED**-0.5), "in_bias": np.zeros(3 * HIDDEN, np.float32),
        "state": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "out": normal(HIDDEN, CLASSES, by=0.05), "out_bias": np.log(mass / mass.sum()).astype(np.float32),
        "member": normal(HEAD // MEMBERS, MEMBERS, HIDDEN, by=0.05), "member_bias": np.log(head / head.reshape(-1, MEMBERS).sum(axis=1).repeat(MEMBERS)).reshape(-1, MEMBERS).astype(np.float32),
    }


def _step(g: np.ndarray, h: np.ndarray, w: dict) -> tuple:
    """One step in its plain form, which tests hold _gated against: g is the input's part of the gates; returns the new
    state and what the way back needs."""
    u = h @ w["state"]
    zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])) + 0.5
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    return n + z * (h - n), z, r, n, u[:, 2 * HIDDEN :]


def _by_gate(x: np.ndarray) -> np.ndarray:
    """Weights (.., 3 * HIDDEN) as (gate, .., HIDDEN), so that what a step computes of a gate lies together. Those of the
    first two gates change their sign, as their sigmoids are 1 / (1 + exp(-x))."""
    out = np.moveaxis(x.reshape(*x.shape[:-1], 3, HIDDEN), -2, 0).copy()
    np.negative(out[:2], out=out[:2])
    return out


def _gated(g: np.ndarray, h: np.ndarray, state: np.ndarray, u: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """A step by gates: g and state as of _by_gate; u, zr, n and the new state go to the given arrays."""
    np.matmul(h, state, out=u)
    np.add(u[:2], g[:2], out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[1], u[2], out=n)
    n += g[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[0]
    out += n


def _softmax(x: np.ndarray, scale: float | np.ndarray) -> np.ndarray:
    """scale (of all rows or of each) times the softmax of the rows of x, in its place."""
    if not (x.max(initial=0) < 80 and x.min(initial=0) > -80):  # only where exp might leave its range
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= scale / (x @ np.ones((x.shape[1], 1), x.dtype))
    return x


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_keys)) + 1])


def _train_window(inputs: np.ndarray, cls: np.ndarray, rank: np.ndarray, live: np.ndarray, h: np.ndarray, w: dict) -> tuple[dict, np.ndarray]:
    """Gradients of a window (time, lane) from state h, and the state after it."""
    steps, lanes = inputs.shape
    kind, like = w["state"].dtype, (steps, lanes, HIDDEN)
    state, given = _by_gate(w["state"]), inputs.reshape(-1).astype(np.int16)
    by_word = np.argsort(given, kind="stable")
    new = np.diff(given[by_word], prepend=-1) != 0
    own_word = given[by_word[new]]
    which = np.empty(len(given), np.intp)
    which[by_word] = np.cumsum(new) - 1
    vec = w["vectors"][own_word]
    gates = np.take(np.matmul(vec, _by_gate(w["in"])) + _by_gate(w["in_bias"])[:, None], which, axis=1).reshape(3, *like)
    s, zr, n, un = np.empty((steps + 1, lanes, HIDDEN), kind), np.empty((2, *like), kind), np.empty(like, kind), np.empty((3, *like), kind)
    s[0] = h
    for t in range(steps):
        _gated(gates[:, t], s[t], state, un[:, t], zr[:, t], n[t], s[t + 1])
    prev, (z, r), un = s[:-1], zr, un[2]
    x, c, m = s[1:][live], cls[live], rank[live]
    one = 1 / max(1, len(x))
    p = x @ w["out"]
    p += w["out_bias"]
    p = _softmax(p, one)
    p[np.arange(len(x)), c] -= one
    g = {"out": (p.T @ x).T, "out_bias": np.ones(len(p), kind) @ p, "member": np.zeros_like(w["member"]), "member_bias": np.zeros_like(w["member_bias"])}
    dx = p @ w["out"].T
    inside = np.flatnonzero(m >= 0)
    if len(inside):
        order = inside[np.argsort(c[inside].astype(np.int16), kind="stable")]
        k = c[order]
        # rows of a class in pieces of PIECE, the last one padded, so that all are multiplied at once
        heads = _runs(k)
        sizes = np.diff(heads, append=len(k))
        pieces = -(-sizes // PIECE)
        first = np.cumsum(pieces) - pieces
        slot = np.arange(len(k)) + np.repeat(first * PIECE - heads, sizes)
        own = np.zeros((int(pieces.sum()), PIECE, HIDDEN), kind)
        own.reshape(-1, HIDDEN)[slot] = x[order]
        of = np.repeat(k[heads], pieces)
        table = w["member"][of]
        q = np.matmul(own, table.transpose(0, 2, 1))
        q += w["member_bias"][of][:, None]
        flat, scale = q.reshape(-1, MEMBERS), np.zeros((len(own) * PIECE, 1), kind)
        scale[slot] = one
        _softmax(flat, scale)
        flat[slot, m[order] % MEMBERS] -= one
        g["member_bias"][k[heads]] = np.add.reduceat(q.sum(axis=1), first, axis=0)
        by_piece = np.matmul(q.transpose(0, 2, 1), own)
        for i in np.flatnonzero(pieces > 1).tolist():
            by_piece[first[i]] = by_piece[first[i] : first[i] + pieces[i]].sum(axis=0)
        g["member"][k[heads]] = by_piece[first]
        dx[order] += np.matmul(q, table).reshape(-1, HIDDEN)[slot]
    ds = np.zeros(like, kind)
    ds[live] = dx
    # what a state's gradient is multiplied by on its way to the gates, for all steps at once
    to_n, to_z, to_r = (1 - z) * (1 - n * n), (prev - n) * z * (1 - z), un * r * (1 - r)
    back = np.ascontiguousarray(w["state"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
    du, dn, dh, part = np.empty((3, *like), kind), np.empty(like, kind), np.zeros((lanes, HIDDEN), kind), np.empty((3, lanes, HIDDEN), kind)
    for t in range(steps - 1, -1, -1):
        dh += ds[t]
        np.multiply(dh, to_n[t], out=dn[t])
        np.multiply(dh, to_z[t], out=du[0, t])
        np.multiply(dn[t], to_r[t], out=du[1, t])
        np.multiply(dn[t], r[t], out=du[2, t])
        np.matmul(du[:, t], back, out=part)
        dh *= z[t]
        dh += part[0]
        dh += part[1]
        dh += part[2]
    du = du.reshape(3, -1, HIDDEN)
    g["state"] = np.concatenate(np.matmul(prev.reshape(-1, HIDDEN).T, du), axis=1)
    du[2] = dn.reshape(-1, HIDDEN)  # of the input's part of the gates, from here on
    at = (which[:, None] * (3 * HIDDEN) + np.arange(3 * HIDDEN)).reshape(-1)
    of_words = np.bincount(at, np.concatenate(du, axis=1).reshape(-1), len(own_word) * 3 * HIDDEN).reshape(-1, 3 * HIDDEN).astype(kind)
    g["in"], g["in_bias"] = vec.T @ of_words, of_words.sum(axis=0)
    g["vectors"] = np.zeros_like(w["vectors"])
    g["vectors"][own_word] = of_words @ w["in"].T
    return g, s[-1]


def _views(flat: np.ndarray, like: dict) -> dict:
    """Parts of flat, by name and in the shapes of like."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class Trainer:
    """Adam on truncated windows; state carries over from window to window of a segment."""

    def __init__(self, w: dict, head: Head):
        self.flat, self.head, self.tokens, self.n = np.concatenate([w[k].reshape(-1) for k in sorted(w)]), head, 0, 0
        self.w, self.first, self.second = _views(self.flat, w), np.zeros_like(self.flat), np.zeros_like(self.flat)

    def learn(self, texts: list[bytes]) -> None:
        k = Tokens(texts)
        rank = self.head.ranks(k.hashes)
        cls = np.where(rank >= 0, rank // MEMBERS, HEAD // MEMBERS + k.tails)
        given = np.where(rank >= 0, rank, HEAD + k.tails)[k.index]
        before = np.concatenate([[FIRST], given[:-1]])
        before[k.bounds[:-1]] = FIRST
        cuts = [np.arange(a, b, SEGMENT) for a, b in zip(k.bounds[:-1].tolist(), k.bounds[1:].tolist())]
        starts = np.concatenate(cuts)
        sizes = np.minimum(np.repeat(k.bounds[1:], [len(c) for c in cuts]) - starts, SEGMENT)
        order = np.argsort(-sizes, kind="stable")
        for lanes in np.array_split(order, max(1, -(-len(order) // LANES))):
            h = np.zeros((len(lanes), HIDDEN), np.float32)
            for t in range(0, int(sizes[lanes[0]]), WINDOW):
                alive = int(np.searchsorted(-sizes[lanes], -t, "left"))  # longest first
                lanes, h = lanes[:alive], h[:alive]
                time = np.arange(t, t + WINDOW)[:, None]
                live = time < sizes[lanes]
                at = np.where(live, starts[lanes] + time, starts[lanes])
                now = k.index[at]
                g, h = _train_window(before[at], cls[now], rank[now], live, h, self.w)
                self.tokens += int(live.sum())
                self._update(g)

    def _update(self, g: dict) -> None:
        self.n += 1
        x = np.concatenate([g[k].reshape(-1) for k in sorted(g)])
        x *= 1 / max(1.0, float(x @ x) ** 0.5)  # plain floats: numpy's own would make all of this double
        # the moments are kept 10 and 100 times as large, which saves passes
        self.first *= 0.9
        self.first += x
        self.second *= 0.99
        x *= x
        self.second += x
        scale = (0.01 / (1 - 0.99**self.n)) ** 0.5
        by = np.sqrt(self.second, out=x)
        by += 1e-7 / scale
        np.divide(self.first, by, out=by)
        by *= RATE * 0.1 / (1 - 0.9**self.n) / scale
        self.flat -= by


def log_probabilities(k: Tokens, v: Vocabulary, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of each text's tokens' classes and shares, summed, but without the counts of tail words
    that the table doesn't hold; and their counts by distinct word."""
    count, rank, cls = v.look_up(k)
    given = np.where(rank >= 0, rank, HEAD + k.tails)
    share = np.where(rank >= 0, 0.0, np.where(count > 0, np.log(np.maximum(count, 0) + 1.0), 0.0) - np.log(v.sums)[k.tails])
    sizes = np.diff(k.bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    out = np.bincount(text, share[k.index], len(sizes))
    before = np.concatenate([[FIRST], given[k.index[:-1]]])
    before[k.bounds[:-1]] = FIRST
    table = np.matmul(w["vectors"], _by_gate(w["in"])) + _by_gate(w["in_bias"])[:, None]
    state, kind = _by_gate(w["state"]), w["state"].dtype
    lanes = np.argsort(-sizes, kind="stable")
    at, length = k.bounds[lanes], sizes[lanes]
    live = np.searchsorted(-length, -np.arange(length.max(initial=0)), "left")  # by step: lanes with more than t tokens
    upto, t = np.cumsum(live), 0
    h = np.zeros((len(lanes), HIDDEN), kind)
    u, zr, n = np.empty((3, len(lanes), HIDDEN), kind), np.empty((2, len(lanes), HIDDEN), kind), np.empty((len(lanes), HIDDEN), kind)
    while t < len(live):
        # so many steps that their states have about STATES rows
        stop = max(t + 1, int(np.searchsorted(upto, (upto[t - 1] if t else 0) + STATES, "right")))
        rows = live[t:stop]
        first = np.cumsum(rows) - rows
        place = at[np.arange(int(rows.sum())) - np.repeat(first, rows)] + np.repeat(np.arange(t, stop), rows)
        gates, s = np.take(table, before[place], axis=1), np.empty((len(place), HIDDEN), kind)
        for i, m in zip(first.tolist(), rows.tolist()):
            _gated(gates[:, i : i + m], h[:m], state, u[:, :m], zr[:, :m], n[:m], s[i : i + m])
            h = s[i : i + m]
        now = k.index[place]
        out += np.bincount(text[place], _outputs(s, cls[now], rank[now], w), len(sizes))
        t = stop
    return out, count


def _outputs(x: np.ndarray, c: np.ndarray, m: np.ndarray, w: dict) -> np.ndarray:
    """log P(class) plus, for words of the head, log P(word | class)."""
    got = np.empty(len(x))
    ones = np.ones(CLASSES, x.dtype)
    for a in range(0, len(x), 1024):
        s = slice(a, a + 1024)
        z = x[s] @ w["out"]
        z += w["out_bias"]
        got[s] = z[np.arange(len(z)), c[s]]
        got[s] -= np.log(np.exp(z, out=z) @ ones)
    inside = np.flatnonzero(m >= 0)
    order = inside[np.argsort(c[inside].astype(np.int16), kind="stable")]
    for rows in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
        if len(rows):
            k = c[rows[0]]
            z = x[rows] @ w["member"][k].T
            z += w["member_bias"][k]
            own = z[np.arange(len(z)), m[rows] % MEMBERS]
            got[rows] += own - np.log(np.exp(z, out=z) @ ones[:MEMBERS])
    return got


def _blob(w: dict) -> bytes:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)]).astype("<f4").tobytes()


def _unblob(blob: bytes, like: dict) -> dict:
    return _views(np.frombuffer(blob, "<f4").copy(), like)


def _mean(t: pa.Table) -> pa.Table:
    t = t.sort_by("shard")
    total, n = 0.0, 0
    for blob, tokens in zip(t["blob"], t["tokens"].to_pylist()):
        total, n = total + np.frombuffer(blob.as_py(), "<f4").astype(float) * tokens, n + tokens
    return pa.table({"shard": pa.array([t["shard"][0].as_py() // SHARDS_AT_ONCE], pa.int64()), "blob": [(total / max(1, n)).astype("<f4").tobytes()], "tokens": pa.array([n], pa.int64())})


def vocabulary(train: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of train (text), and its counts (h, n) of every word."""
    counts = staged_small(train.mapInArrow(released(_count), "h long, tail int, n long").groupBy("h").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")), "words")
    # as many of the most frequent words as TABLE holds, by a histogram of a few hundred steps
    step = F.floor(F.log2("n") * 8)
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    total, distinct, room, least = sum(r["n"] for r in histogram), sum(r["words"] for r in histogram), TABLE, 0
    for r in histogram:
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]
    kept = counts.filter(step >= least).toArrow() if room < 0 else counts.toArrow()
    sums = np.zeros(TAILS)
    for r in counts.groupBy("tail").agg(F.sum(F.col("n") + 1).alias("s")).collect():
        sums[r["tail"]] = r["s"]
    return Vocabulary(kept["h"].to_numpy().view(np.uint64), kept["n"].to_numpy(), kept["tail"].to_numpy(), total, distinct, sums), counts


WEIGHTS = "shard long, blob binary, tokens long"


def _train_shards(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard: each shard starts from the shared weights. Texts are learnt from UNIT bytes at a time,
    wherever batches end."""
    w, head = shared.value
    shard, trainer, held, size = None, None, [], 0

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "blob": [_blob(trainer.w)], "tokens": pa.array([trainer.tokens], pa.int64())})

    for t in chunks(batches):
        for own, text in zip(t["shard"].to_pylist(), raw_texts(t)):
            if held and (own != shard or size >= UNIT):
                trainer.learn(held)
                held, size = [], 0
            if own != shard:
                if trainer:
                    yield result()
                shard, trainer = own, Trainer(w, head)
            held.append(text)
            size += len(text) + 1
    if trainer:
        trainer.learn(held)
        yield result()


def train_model(train: DataFrame, v: Vocabulary) -> dict:
    """Weights after ROUNDS of training by shards and averaging, each on its part of train (doc_id, text)."""
    spark = train.sparkSession
    w, head = start_weights(v), Head(v)
    shards = max(1, -(-v.total // SHARD_TOKENS))
    key = F.xxhash64("doc_id", "text", F.lit(29))
    dealt = train.select("text", F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(shards)).alias("shard"), F.pmod(key, F.lit(ROUNDS)).alias("turn"), key.alias("key"))
    for i in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, head))
        part = dealt.filter(F.col("turn") == i).repartition("shard").sortWithinPartitions("shard", "key").select("shard", "text")
        local = staged_small(part.mapInArrow(released(lambda batches, shared=shared: _train_shards(shared, batches)), WEIGHTS), "weights")
        left = shards
        while left > SHARDS_AT_ONCE:
            means = staged(local.groupBy(F.floor(F.col("shard") / SHARDS_AT_ONCE)).applyInArrow(released_group(_mean), WEIGHTS), "weights")
            discard(local)
            local, left = means, -(-left // SHARDS_AT_ONCE)
        last = local.toArrow()
        discard(local)
        shared.unpersist()
        if last.num_rows:
            w = _unblob(_mean(last)["blob"][0].as_py(), w)
    return w


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = source.filter(~held_out)
    v, counts = vocabulary(train.select("text"))
    w = train_model(train, v)
    model = spark.sparkContext.broadcast((v, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, w = model.value
        row = TaskContext.get().partitionId() << 33
        for t in chunks(batches, size=8 << 20):  # the longest texts run side by side
            k = Tokens(raw_texts(t))
            sums, count = log_probabilities(k, v, w)
            sizes = np.diff(k.bounds)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x: np.bincount(doc, x[k.index], len(sizes))
            base = add(np.log10(np.maximum(count, 0) + 1.0)) - sizes * np.log10(v.total + v.distinct + 1.0)
            known = add((count > 0).astype(float)).astype(np.int64)
            missing = np.flatnonzero(count[k.index] < 0)
            pair, times = np.unique(doc[missing] * np.int64(len(count)) + k.index[missing], return_counts=True)
            own = pair // len(count)
            cuts = np.searchsorted(own, np.arange(len(sizes) + 1)).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(k.hashes.view(np.int64)[pair % len(count)]), pa.array(times.astype(np.int64))], names=["h", "times"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": t["doc_id"].combine_chunks(), "row": pa.array(row + np.arange(len(sizes))), "n_tokens": pa.array(sizes.astype(np.int64)), "known": pa.array(known),
                "base": pa.array(base), "sum": pa.array(sums / np.log(10)), "rest": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest),
            })
            row += len(sizes)

    scored = staged_small(source.mapInArrow(released(run), "doc_id long, row long, n_tokens long, known long, base double, sum double, rest array<struct<h: long, times: long>>"), "scores")
    # words beyond the table: their counts by a join on the hash
    rare = scored.select("row", F.explode("rest").alias("x")).select("row", "x.h", "x.times").join(counts.select("h", "n"), "h")
    found = rare.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    out = scored.drop("rest").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("sum") + more).alias("score"),
    )
