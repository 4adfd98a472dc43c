"""Language identification by bit-sliced Bloom filters over n-grams.

N-grams (four bytes of the lower-cased text, each run of ASCII characters that are no letters being one space) are
counted by language over all training documents. A language holds an n-gram that makes up at least a share of its
n-grams and isn't much rarer there than in another language. One table of bitmasks, a bit for each language, is the
Bloom filter of all languages at once: the AND of an n-gram's cells gives every language that holds it. A document's
counts by language are corrected for each filter's false positives; the largest decides.

Defined cases: null text and text without a letter are `und` with score 0; text none of whose n-grams any language
holds gets the most common language and score 0; with no training documents every result is `und`; documents with
null lang teach nothing; equal texts get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, released, staged_small
from .packing import chunks, raw_texts
from .wordhash import mix

GRAM, CELLS = 4, 3
SHARE = 1e-5  # of a language's n-grams; so a language holds 1 / SHARE of them at most
RARER = 0.2  # of the n-gram's greatest share in any language

_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[65:91] = _LETTER[97:123] = True


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of lower-cased texts, and each text's bounds among them."""
    raw = b"".join(b" " + x + b"    " for x in texts)
    buf = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(x) + GRAM + 1 for x in texts])
    letter = _LETTER[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep[starts] = True
    # a text that ends in a letter keeps one space; one that starts with no letter keeps the first
    out = np.where(letter, buf, np.uint8(32))[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])
    bounds = kept[np.concatenate([starts, ends[-1:]])]
    out = np.append(out, np.full(GRAM, 32, np.uint8)).astype(np.uint32)
    g = out[:-4] | (out[1:-3] << np.uint32(8)) | (out[2:-2] << np.uint32(16)) | (out[3:-1] << np.uint32(24))
    return g, bounds


def _inner(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's n-grams that don't reach into the next text; short texts keep their first."""
    return bounds[:-1], np.maximum(bounds[1:] - (GRAM - 1), bounds[:-1] + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches):
        g, bounds = grams(raw_texts(t))
        a, b = _inner(bounds)
        langs = np.array(t["lang"].to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            own = np.flatnonzero(langs == lang)
            found, n = np.unique(np.concatenate([g[a[i] : b[i]] for i in own]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "gram": pa.array(found.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


class Filters:
    """Bit-sliced Bloom filters of up to 64 languages a word."""

    def __init__(self, held: dict[str, np.ndarray], common: str):
        self.langs, self.common = sorted(held), common
        total = sum(len(v) for v in held.values())
        self.bits = max(10, int(np.ceil(np.log2(8 * total + 1))))
        kind = next(d for d, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(held), 64) <= n)
        self.tables = [np.zeros(1 << self.bits, kind) for _ in range(-(-len(held) // 64))]
        for i, lang in enumerate(self.langs):
            for cell in self.cells(held[lang]):
                np.bitwise_or.at(self.tables[i // 64], cell, kind(1 << (i % 64)))
        self.false = np.array([float(np.mean((self.tables[i // 64] >> kind(i % 64)) & kind(1))) ** CELLS for i in range(len(self.langs))])

    def cells(self, g: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(g.astype(np.uint64) + np.uint64(0x9E3779B9))
        for k in range(CELLS):
            yield ((h >> np.uint64(k * 20)) & np.uint64((1 << self.bits) - 1)).astype(np.int64) if self.bits <= 20 else (mix(h + np.uint64(k)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def counts(self, g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each text (rows) how many n-grams each language holds."""
        out = np.zeros((len(a), len(self.langs)), np.int64)
        masks = [None] * len(self.tables)
        for at in range(0, len(g), 1 << 18):  # cells of a slice stay in cache
            cells = list(self.cells(g[at : at + (1 << 18)]))
            for w, table in enumerate(self.tables):
                m = table[cells[0]]
                for c in cells[1:]:
                    m &= table[c]
                masks[w] = masks[w] or []
                masks[w].append(m)
        for i in range(len(self.langs)):
            m = np.concatenate(masks[i // 64])
            upto = np.concatenate([[0], np.cumsum((m >> m.dtype.type(i % 64)) & m.dtype.type(1), dtype=np.int64)])
            out[:, i] = upto[b] - upto[a]
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        g, bounds = grams(texts)
        a, b = _inner(bounds)
        n = (b - a)[:, None]
        fixed = np.maximum(0, (self.counts(g, a, b) - n * self.false) / (1 - self.false))
        best, total = fixed.argmax(axis=1), fixed.sum(axis=1)
        score = np.where(total > 0, fixed[np.arange(len(best)), best] / np.where(total > 0, total, 1), 0.0)
        return [self.langs[i] if s > 0 else self.common for i, s in zip(best.tolist(), score.tolist())], score


def train(docs: DataFrame) -> Filters | None:
    """Filters of the languages of docs (text lower-cased, lang); counts cover all of docs."""
    counts = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(released(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = staged_small(counts, "grams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return None
    least = SHARE * max(1.0, len(sizes) / 8)  # bounds what comes to the driver to 8 / SHARE rows
    spark = docs.sparkSession
    total = spark.createDataFrame([(k, float(v)) for k, v in sizes.items()], "lang string, total double")
    shares = counts.join(F.broadcast(total), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("p"))
    most = shares.groupBy("gram").agg(F.max("p").alias("most"))
    held = shares.filter(F.col("p") >= least).join(most, "gram").filter(F.col("p") >= RARER * F.col("most")).select("lang", "gram").toArrow()
    langs, g = np.array(held["lang"].to_pylist(), object), held["gram"].to_numpy()
    return Filters({k: np.sort(g[langs == k]).astype(np.uint32) for k in sizes}, max(sizes, key=lambda k: (sizes[k], k)))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; training rows are those whose crc32(doc_id) mod 3 isn't 1."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(source.filter(~held_out))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            pred, score = shared.value.predict(raw_texts(t)) if shared.value else (["und"] * t.num_rows, np.zeros(t.num_rows))
            letter = t["letter"].to_numpy()
            yield pa.RecordBatch.from_pydict({"doc_id": t["doc_id"].combine_chunks(), "lang_pred": [p if x else "und" for p, x in zip(pred, letter.tolist())], "score": pa.array(np.where(letter, score, 0.0))})

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    out = staged_small(source.select("doc_id", "text", letter).mapInArrow(released(run), "doc_id long, lang_pred string, score double"), "languages")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
