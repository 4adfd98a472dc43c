"""Quality classifier: a byte-level convolutional network in numpy.

Learned byte vectors (bytes of a word that repeats the word before it have vectors of their own) and filters slide over
the whole text. Overlapping chunks of positions are max-pooled, the mean
and the maximum over all chunks of a document go through a small dense layer to one probability. The network is fitted
on whole texts of a bounded sample of labelled rows, by the order of a hash of the id: `sample` rows and `sample_bytes`
bytes at most (a text that doesn't fit in what is left of the bytes isn't learnt from). Training and scoring read every
byte of a text.

Defined cases: null and empty texts are one chunk of padding, and get a score like any other; labels that are null, or
of ids without a text, teach nothing; with no usable labels, or one class only, every score is that of a constant
(0.5, or the class's share); repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, give_back, released, staged, staged_small
from .packing import chunks, raw_texts
from .wordhash import EXACT, joined, per_text, words

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 4, 16, 8
POOL = 16  # positions of a block
CHUNK_BLOCKS, CHUNK_STEP = 8, 7  # a chunk is 8 blocks (512 bytes); chunks overlap by one
BLOCK = POOL * STRIDE
PAD = 256
AGAIN = 257  # added to the bytes of a word that equals the word before it
SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
STEPS, BATCH, PART = 500, 64, 1 << 20


def _windows(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rows of WIDTH byte vectors at every STRIDE bytes; codes end with WIDTH - STRIDE more than the positions need."""
    flat = np.ascontiguousarray(vectors[codes].reshape(-1))
    n = (len(codes) - WIDTH) // STRIDE + 1
    step = flat.strides[0]
    return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBED), (STRIDE * EMBED * step, step), writeable=False)


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each padded to whole blocks with a block of padding after it, and each text's block bounds."""
    blocks = np.array([max(1, -(-len(x) // BLOCK)) for x in texts], np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum(blocks)])
    codes = np.full(int(bounds[-1]) * BLOCK + WIDTH, PAD, np.int16)
    buf, offsets = joined(texts)
    flat = buf + np.int16(AGAIN) * _repeated(buf, offsets)
    for a, b, to in zip(offsets[:-1], offsets[1:] - 1, bounds[:-1] * BLOCK):
        codes[to : to + b - a] = flat[a:b]
    return codes, bounds


def _repeated(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 at the bytes of words that equal the word before them in their text."""
    starts, ends, hashes = words(buf, EXACT)
    if len(starts) < 2:
        return np.zeros(len(buf), np.int16)
    same = hashes[1:] == hashes[:-1]
    bounds = per_text(starts, offsets)
    heads = bounds[(bounds > 0) & (bounds < len(starts))]
    same[heads - 1] = False
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts[1:][same]] += 1
    edge[ends[1:][same]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int16)


def chunk_maxima(texts: list[bytes], w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled filters of every chunk of every text, and each text's first chunk."""
    codes, bounds = _layout(texts)
    n = int(bounds[-1])
    blocks = np.empty((n, FILTERS), np.float32)
    for a in range(0, n, 4096):  # bounds memory
        b = min(n, a + 4096)
        h = _windows(codes[a * BLOCK : b * BLOCK + WIDTH - STRIDE], w["vectors"]) @ w["filters"]
        blocks[a:b] = h.reshape(b - a, POOL, FILTERS).max(axis=1)
    blocks = np.maximum(blocks + w["bias"], 0)
    starts, ends, firsts = [], [], [0]
    for a, b in zip(bounds[:-1].tolist(), (bounds[1:] - 1).tolist()):  # without the padding block
        s = np.arange(a, max(a + 1, b - (CHUNK_BLOCKS - CHUNK_STEP)), CHUNK_STEP)
        starts.append(s)
        ends.append(np.minimum(s + CHUNK_BLOCKS, b))
        firsts.append(firsts[-1] + len(s))
    pairs = np.stack([np.concatenate(starts), np.concatenate(ends)], axis=1).reshape(-1)
    return np.maximum.reduceat(blocks, pairs, axis=0)[::2], np.array(firsts)


def scores(texts: list[bytes], w: dict) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    if "constant" in w:
        return np.full(len(texts), float(w["constant"]))
    pooled, first = chunk_maxima(texts, w)
    mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
    most = np.maximum.reduceat(pooled, first[:-1], axis=0)
    h = np.maximum(np.concatenate([mean, most], axis=1) @ w["w1"] + w["b1"], 0)
    z = (h @ w["w2"] + w["b2"])[:, 0].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> dict:
    """Trains by Adam on the logistic loss; gradients by hand."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    w = {
        "vectors": rng.normal(0, 0.5, (2 * AGAIN, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.full(HIDDEN, 0.1, np.float32),
        "w2": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)).astype(np.float32),
        "b2": np.array([np.log(y.mean() / (1 - y.mean()))], np.float32),
    }
    w["vectors"][PAD] = 0
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    sizes = np.array([len(x) for x in texts], np.int64)
    while step < STEPS:
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            g: dict = {}
            for part in _parts(rows, sizes):
                for k, v in _gradients([texts[i] for i in part], y[part], w, len(rows)).items():
                    g[k] = g[k] + v if k in g else v
            step += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                w[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def _block_maxima(codes: np.ndarray, n: int, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the filters' maxima, before the bias, and the positions where they are."""
    top, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
    for a in range(0, n, 4096):  # bounds memory
        b = min(n, a + 4096)
        h = (_windows(codes[a * BLOCK : b * BLOCK + WIDTH - STRIDE], w["vectors"]) @ w["filters"]).reshape(b - a, POOL, FILTERS)
        at = h.argmax(axis=1)
        top[a:b] = np.take_along_axis(h, at[:, None], axis=1)[:, 0]
        where[a:b] = np.arange(a, b)[:, None] * POOL + at
    return top, where


def _gradients(texts: list[bytes], y: np.ndarray, w: dict, total: int | None = None) -> dict:
    """Of the loss of these texts, as a part of a batch of `total`."""
    codes, bounds = _layout(texts)
    tops, places = _block_maxima(codes, int(bounds[-1]), w)
    starts, owner, ends = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), (bounds[1:] - 1).tolist())):
        s = np.arange(a, max(a + 1, b - (CHUNK_BLOCKS - CHUNK_STEP)), CHUNK_STEP)
        starts.append(s)
        ends.append(np.minimum(s + CHUNK_BLOCKS, b))
        owner.append(np.full(len(s), i))
    starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
    index = np.minimum(starts[:, None] + np.arange(CHUNK_BLOCKS), ends[:, None] - 1)
    block = np.take_along_axis(index, tops[index].argmax(axis=1), axis=1)  # chunk, filter: block
    where, top = places[block, np.arange(FILTERS)], tops[block, np.arange(FILTERS)] + w["bias"]
    pooled = np.maximum(top, 0)
    first = np.searchsorted(owner, np.arange(len(texts)))
    size = np.diff(np.append(first, len(owner)))[:, None]
    mean = np.add.reduceat(pooled, first, axis=0) / size
    most = np.maximum.reduceat(pooled, first, axis=0)
    doc = np.concatenate([mean, most], axis=1)
    h = np.maximum(doc @ w["w1"] + w["b1"], 0)
    z = (h @ w["w2"] + w["b2"])[:, 0]
    d = ((1 / (1 + np.exp(-z)) - y) / (total or len(y)))[:, None].astype(np.float32)
    g = {"w2": h.T @ d, "b2": d.sum(axis=0)}
    dh = (d @ w["w2"].T) * (h > 0)
    g |= {"w1": doc.T @ dh, "b1": dh.sum(axis=0)}
    dd = dh @ w["w1"].T
    dp = (dd[:, :FILTERS] / size)[owner]
    is_most = (pooled == most[owner]) & (pooled > 0)
    dp = (dp + dd[:, FILTERS:][owner] * is_most) * (top > 0)
    g["bias"] = dp.sum(axis=0)
    used, back = np.unique(where, return_inverse=True)
    da = np.zeros((len(used), FILTERS), np.float32)
    np.add.at(da, (back.reshape(where.shape), np.broadcast_to(np.arange(FILTERS), where.shape)), dp)
    seen = codes[used[:, None] * STRIDE + np.arange(WIDTH)]
    g["filters"] = w["vectors"][seen].reshape(len(used), WIDTH * EMBED).T @ da
    g["vectors"] = np.zeros_like(w["vectors"])
    np.add.at(g["vectors"], seen, (da @ w["filters"].T).reshape(len(used), WIDTH, EMBED))
    g["vectors"][PAD] = 0
    return g


def _parts(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The rows of a batch, cut so that few parts have more than PART bytes; their gradients add up to the batch's."""
    return [x for x in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // PART)) + 1) if len(x)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Fits the network on whole texts of labelled rows whose crc32(doc_id) mod 3 is not 1, in the order of a hash of the
    id: `sample` of them at most, and as many as sample_bytes bytes of text hold."""
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter((crc_mod(F.col("doc_id"), 3) != 1) & F.col("quality").isin(0, 1))
        .orderBy(*order, "quality")
        .limit(sample)
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # repeated ids must not take the sample over its bound
    rows = staged(found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")), "labelled")
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(*order).collect()
    held, ids = 0, []
    for r in sizes:
        if held + r["n"] <= sample_bytes:
            held += r["n"]
            ids.append(r["doc_id"])
    picked = rows.filter(F.col("doc_id").isin(ids)).toArrow().sort_by("doc_id") if ids else None
    discard(rows)
    return fit([x.encode() for x in picked["text"].to_pylist()] if ids else [], np.array(picked["quality"].to_pylist() if ids else []))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = train(source, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": t["doc_id"].combine_chunks(), "score": pa.array(scores(raw_texts(t), weights), pa.float64())})

    out = staged_small(source.mapInArrow(released(run), "doc_id long, score double"), "quality")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject; their columns as they were. Only texts go to Python, and only
    scores come back."""
    weights = train(docs, labels)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = pa.RecordBatch.from_arrays([b], names=["text"])
            yield pa.array(np.concatenate([scores(raw_texts(t), weights) for t in chunks(iter([rows]))] or [np.zeros(0)]), pa.float64())
            del b, rows
        give_back()

    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) >= 0.5)
