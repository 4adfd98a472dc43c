from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, exchange, gru_lm, language_id, license_scan, line_dedup, media_columns, mixing, ngram_jaccard, packing, quality, wordhash
from millrace.llm.components import components
from millrace.llm.exact_dedup import drop_duplicates, exact_duplicates
from millrace.llm.queries import ORACLE, QUERIES

from ..oracle import connect, same

TOKENIZERS = pytest.importorskip("public_tokenizers")
TOKENIZER = TOKENIZERS.path("word_bpe_49k.json")
LONG = "alpha beta gamma delta " * 6000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, size string, pattern string, _bucket string, row string, th int, _row int"
#: nulls in any column, empty and blank texts, a very long one, ties, repeated rows, and columns that clash
AWKWARD = [
    (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, "one  two three four five six\nseven", None, "b"), (3, None, None, None),
    (4, "", "en", "a"), (None, "one two three four five six seven", "en", None), (5, " \t\n", "fr", "c"), (6, LONG, "en", "a"), (7, LONG, "en", "b"), (8, "Éa ßü 東京 ½", "fr", "c"), (9, "12 34 ..", "de", "c"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 5, 1, "s", "p", "b", "r", 2, 3) for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 0), (99, 1, 1), (6, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_every_operator_takes_awkward_and_empty_tables(spark, awkward, empty, labels):
    ops = {
        "jaccard": lambda d: ngram_jaccard.jaccard_join(d), "exact": exact_duplicates, "lm": gru_lm.score, "lang": language_id.identify, "lines": line_dedup.dedup_report, "media": media_columns.text_media,
        "mix": mixing.mix_report, "quality": lambda d: quality.quality_scores(d, labels), "licence": license_scan.scan,
    }
    for name, op in ops.items():
        assert op(awkward).count() == len(AWKWARD), name
        assert op(empty).count() == 0, name
    assert packing.pack(awkward, TOKENIZER).count() >= len(AWKWARD)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_pipeline_stages_take_awkward_and_empty_tables(spark, awkward, empty, sf):
    import corpus_pipeline

    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            if docs is empty:
                assert out.count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), ORACLE[name])


def test_exact_with_colliding_fingerprints(spark, awkward):
    def rows(bits):
        return sorted(map(str, exact_duplicates(awkward, bits).drop("copies").collect()))

    assert rows(4) == rows(48)
    kept = [r for r in exact_duplicates(awkward).collect() if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept})


def test_drop_duplicates_keeps_one_of_each(awkward):
    out = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in drop_duplicates(awkward).collect()]
    assert sorted(out) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in AWKWARD})


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        assert (exchange.unrice(exchange.rice(v)) == v).all()


def brute_links(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = word_list(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up, links = {i: i for i in sets}, Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links[a] += 1
                links[b] += 1
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


@pytest.fixture(scope="module")
def near_copies():
    """Groups of near copies from two to sixty, short sets at the threshold, and a passage that many share."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(vocabulary, 30))
    out = []
    for size in (2, 3, 60):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(size):
            t = list(base)
            for _ in range(rng.integers(0, 5)):
                t[rng.integers(0, len(t))] = str(rng.choice(vocabulary))
            out.append(" ".join(t))
    out += [" ".join([*passage, *rng.choice(vocabulary, 20)]) for _ in range(40)]
    out += [" ".join(vocabulary[:n]) for n in range(1, 30)] + [" ".join(vocabulary[:12])] * 3 + ["", "a", "A b", "a B"]
    return list(enumerate(out))


@pytest.mark.parametrize("width,percent,block", [(3, 90, 2048), (3, 90, 7), (5, 80, 16), (2, 60, 9)])
def test_jaccard_join_matches_brute_force(spark, near_copies, width, percent, block):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_jaccard.jaccard_join(docs, width, percent, block).collect()}
    assert got == brute_links(near_copies, width, percent)


def test_tree_bound_is_safe():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.choice(base, 150 + 3 * i, replace=False), rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for i in range(70)]
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    got = set()
    for x, y in ngram_jaccard.linked(sets, None, 60):
        got |= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    assert got == want and want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (300, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 300: 200, 200: 200}


def test_lm_counts_and_gain(spark, sf, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    monkeypatch.setattr(gru_lm, "TABLE", 500)  # most words take the join
    got = {r["doc_id"]: r for r in gru_lm.score(documents(spark, sf)).collect()}
    tokens = {i: [*word_list(lower(t)), None] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_learns_from_all_training_documents(spark, monkeypatch):
    docs = spark.range(3500).select("id", F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    train = docs.withColumnRenamed("id", "doc_id")
    mean, seen = gru_lm._mean, []

    def spy(t):
        seen.append(sum(t["tokens"].to_pylist()))
        return mean(t)

    monkeypatch.setattr(gru_lm, "_mean", spy)
    v, _ = gru_lm.vocabulary(train.select("text"))
    gru_lm.train_model(train, v)
    assert sum(seen) == v.total == 4 * 3500


def test_lm_state_crosses_windows_and_chunks():
    texts = [b"a b c " * 50, b"", b"c a b"]
    k = gru_lm.Tokens(texts)
    counts = np.bincount(k.index, minlength=len(k.hashes))
    v = gru_lm.Vocabulary(k.hashes, counts, k.tails, int(counts.sum()), len(counts), np.bincount(k.tails, counts + 1, gru_lm.TAILS))
    w = gru_lm.start_weights(v)
    together, _ = gru_lm.log_probabilities(k, v, w)
    alone = [gru_lm.log_probabilities(gru_lm.Tokens([t]), v, w)[0][0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-5)


def test_lm_gradients():
    rng = np.random.default_rng(0)
    texts = [b"a b c a b", b"b c"]
    k = gru_lm.Tokens(texts)
    counts = np.bincount(k.index, minlength=len(k.hashes))
    v = gru_lm.Vocabulary(k.hashes, counts, k.tails, int(counts.sum()), len(counts), np.bincount(k.tails, counts + 1, gru_lm.TAILS))
    w = {n: x.astype(np.float64) for n, x in gru_lm.start_weights(v).items()}
    _, rank, cls = v.look_up(k)
    now = k.index[:6][:, None]
    inputs = np.where(rank[now] >= 0, rank[now], gru_lm.HEAD)
    h = rng.normal(0, 0.3, (1, gru_lm.HIDDEN))
    live = np.ones((6, 1), bool)

    def loss():
        s, total = h, 0.0
        for t in range(6):
            s = gru_lm._step(w["vectors"][inputs[t]] @ w["in"] + w["in_bias"], s, w)[0]
            total -= gru_lm._outputs(s, cls[now[t]], rank[now[t]], w).sum()
        return total / 6

    g, _ = gru_lm._train_window(inputs, cls[now], rank[now], live, h, w)
    for name, at in (("state", (2, 5)), ("in", (1, 40)), ("out", (3, 0)), ("member", (0, 1, 2)), ("vectors", (int(inputs[2, 0]), 3)), ("in_bias", (20,))):
        x = w[name][at]
        w[name][at] = x + 1e-5
        up = loss()
        w[name][at] = x - 1e-5
        down = loss()
        w[name][at] = x
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8), name


def test_word_hashes_equal_plain_ones():
    odd, whole = int(wordhash._ODD), (1 << 64) - 1
    raw = b"  a " + b"b" * 1021 + b" c\tD " + b"xy" * 3000 + b" A"
    starts, ends, hashes = wordhash.words(np.frombuffer(raw, np.uint8))
    assert [raw[a:b] for a, b in zip(starts, ends)] == raw.split()
    for word, got in zip(raw.split(), hashes.tolist()):
        total = sum(int(wordhash.LOWER[c]) * pow(odd, i, whole + 1) for i, c in enumerate(word)) + len(word) * odd
        assert got == int(wordhash.mix(np.array([total & whole], np.uint64))[0])


def test_lm_updates_are_single_precision_adam():
    k = gru_lm.Tokens([b"a b c a b"])
    counts = np.bincount(k.index, minlength=len(k.hashes))
    v = gru_lm.Vocabulary(k.hashes, counts, k.tails, int(counts.sum()), len(counts), np.bincount(k.tails, counts + 1, gru_lm.TAILS))
    trainer, rng = gru_lm.Trainer(gru_lm.start_weights(v), gru_lm.Head(v)), np.random.default_rng(1)
    plain = {n: x.astype(float) for n, x in trainer.w.items()}
    first, second = ({n: np.zeros_like(x) for n, x in plain.items()} for _ in range(2))
    for i in range(1, 6):
        g = {n: rng.normal(0, 0.01, x.shape).astype(np.float32) for n, x in plain.items()}
        trainer._update(g)
        norm = max(1.0, sum(float((x.astype(float) ** 2).sum()) for x in g.values()) ** 0.5)
        for n, x in g.items():
            first[n] = 0.9 * first[n] + 0.1 * x / norm
            second[n] = 0.99 * second[n] + 0.01 * (x / norm) ** 2
            plain[n] -= gru_lm.RATE * first[n] / (1 - 0.9**i) / (np.sqrt(second[n] / (1 - 0.99**i)) + 1e-7)
    assert all(trainer.w[n] == pytest.approx(plain[n], abs=1e-5) for n in plain)
    assert {x.dtype for held in (trainer.first, trainer.second) for x in (held.values() if isinstance(held, dict) else [held])} == {np.dtype("f4")}


def test_lm_steps_by_gates_equal_plain_steps(monkeypatch):
    monkeypatch.setattr(gru_lm, "STATES", 7)  # blocks end inside texts
    texts = [b"a b c A b " * 9, b"", b"c a b", b"zz"]
    k = gru_lm.Tokens(texts)
    counts = np.bincount(k.index, minlength=len(k.hashes))
    v = gru_lm.Vocabulary(k.hashes, counts, k.tails, int(counts.sum()), len(counts), np.bincount(k.tails, counts + 1, gru_lm.TAILS))
    w = {n: x.astype(float) for n, x in gru_lm.start_weights(v).items()}
    got, _ = gru_lm.log_probabilities(k, v, w)
    _, rank, cls = v.look_up(k)
    assert (rank >= 0).all()  # so that no share is to be added
    for i, (a, b) in enumerate(zip(k.bounds[:-1], k.bounds[1:])):
        h, total, last = np.zeros((1, gru_lm.HIDDEN)), 0.0, gru_lm.FIRST
        for j in k.index[a:b]:
            h = gru_lm._step(w["vectors"][[last]] @ w["in"] + w["in_bias"], h, w)[0]
            total, last = total + gru_lm._outputs(h, cls[[j]], rank[[j]], w)[0], rank[j]
        assert got[i] == pytest.approx(total)


def test_language_accuracy(spark, sf):
    got = language_id.identify(documents(spark, sf)).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_defined_cases(spark, awkward):
    got = {r["doc_id"]: r for r in language_id.identify(awkward).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 9)] == ["und"] * 4


def test_filters_return_all_languages():
    f = language_id.Filters({"x": np.array([1, 2], np.uint32), "y": np.array([2, 3], np.uint32)}, "x")
    g = np.array([1, 2, 3], np.uint32)
    one = np.arange(3)
    assert (f.counts(g, one, one + 1) >= [[1, 0], [1, 1], [0, 1]]).all()


def test_line_groups(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ane", "ilo", "uster", "ong", "ere", "it")]
    line = " ".join(rng.choice(vocabulary, 200))
    near = line.replace(" ", "  ").upper() + "!"
    typo = line[:-1] + "x"
    rows = [(1, f"{line}\nshort line\nunique words that stand here alone {1}"), (2, f"{near}\nshort line"), (3, f"other first of all lines\n{typo}"), (4, None), (5, "")]
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (3, []) and got[2] == (2, [0, 1]) and got[4] == (1, []) and got[5] == (1, [])  # equal short lines too
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[2] == "" and clean[1] == rows[0][1] and clean[4] is None


def test_lines_with_edits_are_near_copies(spark):
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 10)))
    rows = []
    for i in range(120):
        line = [word() for _ in range(rng.integers(12, 60))]
        new = list(line)
        if i % 2:  # a word in twelve is another of its length, so the edit similarity is above 0.8
            for at in rng.choice(len(line), len(line) // 12, replace=False):
                new[at] = "".join(rng.choice(letters, len(line[at])))
        else:  # a letter in thirty is another
            text = list(" ".join(line))
            for at in rng.choice(len(text), len(text) // 30, replace=False):
                text[at] = "x" if text[at] != " " else " "
            new = "".join(text).split(" ")
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(new))]
    rows += [(1000 + i, " ".join(word() for _ in range(20))) for i in range(50)]
    gone = {r["doc_id"] for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["dropped"]}
    assert gone <= {2 * i + 1 for i in range(120)} and len(gone) >= 0.95 * 120


def test_line_dedup_is_native(spark, awkward):
    plan = line_dedup.dedup_report(awkward)._jdf.queryExecution().toString() + license_scan.scan(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_lines_all_drop_but_one(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").split("\n") for r in documents(spark, sf).collect()}
    gone = {r["doc_id"]: set(r["dropped"]) for r in line_dedup.dedup_report(documents(spark, sf)).collect()}
    seen = set()
    for i in sorted(docs):
        for p, t in enumerate(docs[i]):
            n = re.sub(r"[\W_]+", " ", t.lower()).strip()
            if n and n in seen:
                assert p in gone[i]
            seen.add(n)


def test_media_round_trip_and_carving():
    for text in (b"", b"x", b"y" * 64, b"z" * 65, "é".encode() * 100):
        payload, blob = media_columns.store(text)
        found = media_columns.sniff(blob)[0]
        assert (found.offset, found.length) == (0, len(blob)) and blob[found.data : found.data + found.size] == payload
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 9 + b"\x02" + b"\x02ab\0" + b"\x3b"
    found = media_columns.sniff(b"BM no bitmap " + png + b"--" + gif + b"RIFF\xff\xff\xff\xffWAVE")
    assert [(f.kind, f.length) for f in found] == [("image/png", len(png)), ("image/gif", len(gif))]
    assert media_columns.sniff(png[:-1]) == [] and media_columns.sniff(None) == []


def test_declared_types(spark):
    _, wav = media_columns.store(b"z" * 130)
    rows = [(1, bytearray(wav), "image/png", 1), (2, bytearray(b"junk"), None, 2), (3, None, None, 3)]
    got = {r["row"]["id"]: (r["media_type"], r["type_ok"]) for r in media_columns.correct_types(spark.createDataFrame(rows, "id int, b binary, t string, media_type int"), "b", "t").collect()}
    assert got[1][1] is False and got[2] == (None, True) and got[3] == (None, True)


def test_mix_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = mixing.mix_report(documents(spark, sf)).join(documents(spark, sf).select("doc_id", "source"), "doc_id").toPandas()
    size = {i: len(word_list(t)) for i, t in documents(spark, sf).select("doc_id", "text").collect()}
    assert (rows["size"] == rows.doc_id.map(size)).all() and (rows.taken <= 2 * rows["size"]).all()
    by = rows.groupby("source").agg(n=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by.n == by.source_size).all() and ((by.taken - by.target).abs() <= 0.02 * by.target).all()
    assert by.target.sum() == pytest.approx(1.5 * by.n.sum())
    again = mixing.mix_report(documents(spark, sf).repartition(3))
    assert {r[0]: r[1] for r in again.select("doc_id", "taken").collect()} == dict(zip(rows.doc_id, rows.taken))


def test_flow_routes_overlapping_sources():
    p = {json.dumps(["a"]): 100.0, json.dumps(["a", "b"]): 100.0, json.dumps(["b"]): 50.0}
    got = mixing.route(p, {"a": 100.0, "b": 150.0}, 2)
    assert sum(got.values()) == pytest.approx(250) and got == pytest.approx({k: v for k, v in p.items()})
    more = mixing.route(p, {"a": 100.0, "b": 250.0}, 2)
    assert sum(more.values()) == pytest.approx(350) and all(more[k] <= 2 * v for k, v in p.items())


def test_packing_is_whole(spark, sf):
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    t = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in docs}
    rows = packing.pack(documents(spark, sf), TOKENIZER).toPandas()
    for i, g in rows.sort_values("start").groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    fill = []
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.cumsum(g.length.values) - g.length.values).all()
        fill.append(int(g.length.sum()))
    assert max(fill) <= 4096 and sum(4096 - x for x in fill) <= 0.05 * sum(fill) + 4096


def test_cut_items_are_whole(spark):
    """Lengths that nothing complements force cuts; copies and repeated rows are packed one by one."""
    rows = [(i % 5, "word " * 40) for i in range(20)] + [(50, "other " * 7)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, window=64).toPandas()
    assert out.length.sum() == 20 * 41 + 8 and (out.groupby("sequence_id").length.sum() <= 64).all()
    assert (64 - out.groupby("sequence_id").length.sum()).sum() < 64
    whole = np.array([*[0] * 0], "<u4")
    from tokenizers import Tokenizer

    whole = np.array([*Tokenizer.from_file(TOKENIZER).encode("word " * 40, add_special_tokens=False).ids, 2], "<u4")
    for r in out[out.doc_id != 50].itertuples():
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())


def test_plan_uses_every_item_once():
    plan = packing.pack_plan({3000: 5, 1096: 3, 700: 9, 1: 40}, 4096)
    used = Counter()
    for item, a, b, start, length, *_ in plan:
        used[item] += (b - a) * length
    assert used == {3000: 15000, 1096: 3288, 700: 6300, 1: 40}


def test_word_pieces_equal_the_tokenizer():
    from tokenizers import Tokenizer

    odd = ["it's don't.x 'sound ''s a.'s", "foo.<|endoftext|>bar", "", " \n", "É. é! 東京 123abc a1.b2", "\x01 a\x01b \x01", "İstanbul ΑΣ. é", "a_b a|b <a> (x)'s", "word" * 300]
    t = Tokenizer.from_file(TOKENIZER)
    for x, got in zip(odd, packing.token_ids([x.encode() for x in odd], packing._Coder(TOKENIZER))):
        assert got.tolist() == [*t.encode(x, add_special_tokens=False).ids, 2], x


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(documents(spark, sf), labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.93 * len(held)


def test_quality_gradients(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 3)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (700, 90, 0)]
    y = np.array([1, 0, 1], np.float32)
    w = quality.fit(texts * 4, np.tile(y, 4))
    w = {k: v.astype(np.float64) for k, v in w.items()}
    g = quality._gradients(texts, y, w)
    parts = [quality._gradients(texts[i : i + 1], y[i : i + 1], w, 3) for i in range(3)]  # a batch in parts adds up
    assert all(np.allclose(sum(p[k] for p in parts), g[k], atol=1e-6) for k in g)

    def loss():
        s = quality.scores(texts, w)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, at in (("w1", (3, 2)), ("w2", (1, 0)), ("filters", (7, 3)), ("bias", (2,)), ("b2", (0,))):
        x = w[name][at]
        w[name][at] = x + 1e-4
        up = loss()
        w[name][at] = x - 1e-4
        down = loss()
        w[name][at] = x
        assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=1e-4), name


def test_licences(spark):
    mit = license_scan.LICENCES["MIT"]
    variant = "Copyright (c) 2020 Some One\n" + mit.split("\n", 1)[1].upper().replace(",", " ;")
    rows = [(1, mit), (2, variant), (3, "prose\nReleased under the MIT Licence\nmore"), (4, mit + " and more"), (5, None), (6, "© 2020 x")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[3]["notices"] == ["MIT"] and got[1]["notices"] == [] and got[5]["canonical_sha256"] == got[6]["canonical_sha256"]


def test_longer_licences_and_titles(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(f, folder / f) for f in names if (folder / f).exists()]
    rows = [(i, "  " + p.read_text().upper()) for i, (_, p) in enumerate(found)]
    rows += [(90, "The MIT License (MIT)\n\nCopyright (c) 2020 X\n" + license_scan.LICENCES["MIT"].split("\n", 1)[1]), (91, "This program is distributed under the terms of the GNU General Public License, version 2 or later.\nspdx-license-identifier: MPL-2.0\nunder no MIT")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(len(found))] == [names[f] for f, _ in found]
    assert got[90]["license_id"] == "MIT" and got[91]["notices"] == ["GPL-2.0-or-later", "MPL-2.0"]


def test_other_licences_can_be_given(spark):
    docs = spark.createDataFrame([(1, "Be nice.\nCopyright 2020 Y")], "doc_id long, text string")
    digest = license_scan.scan(docs).first()["canonical_sha256"]
    known = spark.createDataFrame([("Nice-1.0", digest)], "license_id string, digest string")
    assert license_scan.scan(docs, known).first()["license_id"] == "Nice-1.0"


def test_lm_does_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARD_TOKENS", 5000)
    monkeypatch.setattr(gru_lm, "SHARDS_AT_ONCE", 4)  # more than one level of averages
    train = documents(spark, sf).select("doc_id", "text")
    v, _ = gru_lm.vocabulary(train.select("text"))
    one, other = gru_lm.train_model(train, v), gru_lm.train_model(train.repartition(5), v)
    assert all((one[k] == other[k]).all() for k in one)


def test_ids_that_texts_share(spark):
    rows = [(1, "A", "x"), (5, "A", "x"), (5, "B", "y"), (None, "A", "z"), (7, "C", "q"), (7, "C", "q")]
    out = drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, "A"), (5, "B"), (7, "C")]


def test_near_copies_of_a_repeated_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, other = " ".join(words), " ".join([*words[:-1], "x"]), "quite another text of more than five words"
    rows = [(1, a), (2, b), (2, other)]
    out = ngram_jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, a), (2, other)]


def test_work_folder_and_settings(spark):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.work_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))
    assert common.work_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:")
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.checkpoint.dir"]
    before = [spark.conf.get(k) for k in keys]
    language_id.identify(spark.createDataFrame([(1, "ab cd", "en")], "doc_id long, text string, lang string")).count()
    assert [spark.conf.get(k) for k in keys] == before


def test_key_filter_holds_many_keys(spark):
    keys = spark.range(1 << 20).withColumnRenamed("id", "k")  # four times as many as the filter has rows
    rows = spark.range(1 << 20, 2 << 20).select((F.col("id") * 7 + 3).alias("k")).unionByName(keys)
    out = common.passing(rows, common.key_filter(keys, "k"), F.col("k"))
    inside = out.join(keys, "k", "left_semi").count()
    assert inside >= keys.count() and out.count() <= inside + 0.08 * (1 << 20)


def test_lines_against_brute_force(spark, sf):
    """Of all pairs of lines with an edit similarity of 0.85 or more (by bytes) and under 250 characters, found by comparing all with all."""
    lines = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    distinct = line_dedup._distinct(lines).filter("n >= 20 and n < 250").select("words").distinct().toPandas()
    con = connect(sf)
    con.register("n", distinct)
    sql = "select x.words, y.words from n x join n y on x.words < y.words and abs(strlen(x.words) - strlen(y.words)) <= 0.15 * greatest(strlen(x.words), strlen(y.words)) where levenshtein(x.words, y.words) <= 0.15 * greatest(strlen(x.words), strlen(y.words))"
    pairs = con.execute(sql).fetchall()
    staged = line_dedup.staged(line_dedup._distinct(lines.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    roots = {r["words"]: r["root"] for r in staged.join(line_dedup._links(staged, 20, 0.8), F.col("id") == F.col("node")).select("words", "root").collect()}
    found = sum(a in roots and roots.get(a) == roots.get(b) for a, b in pairs)
    assert len(pairs) >= 10 and found >= 0.9 * len(pairs)


def test_heaps_shrink(spark):
    """Tasks make the JVM that runs them collect all garbage; here it is the driver's own."""
    jvm = spark._jvm
    beans = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "Mark" in b.getName())
    before = beans()
    common.shrink_heaps(spark)
    assert beans() > before


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_pair_of_like_lines_is_linked(spark, monkeypatch):
    """Lines with letters changed in all words share no key; chunks of a few lines meet all others."""
    rng = np.random.default_rng(17)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäñ"))
    lines = []
    for i in range(14):
        line = list(" ".join("".join(rng.choice(letters, 6)) for _ in range(rng.integers(4, 10))))
        new = list(line)
        for at in range(int(rng.integers(0, 6)), len(line), 6 if i % 2 else 5):  # in each word a letter is lost, replaced or put in
            new[at] = ["", str(rng.choice(letters)), line[at] + str(rng.choice(letters))][int(rng.integers(3))] if line[at] != " " else " "
        lines += ["".join(line), "".join(new)]
    lines = [" ".join(x.split()) for x in lines]
    up = list(range(len(lines)))
    for j, y in enumerate(lines):
        for i, x in enumerate(lines[:j]):
            if edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                up = [up[i] if r == up[j] else r for r in up]
    smallest = {r: min(i for i, q in enumerate(up) if q == r) for r in up}
    wanted = {i for i, r in enumerate(up) if i != smallest[r]}
    monkeypatch.setattr(line_dedup, "CHUNK", 500)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.dedup_report(docs).collect() if r["dropped"]} == wanted and len(wanted) >= 7


def test_bounds_before_the_edit_distance_lose_no_link(spark):
    """Packed counts and missing pieces never exceed an edit distance that counts, whatever the lengths, shifts and scripts; both tell most others apart."""
    rng = np.random.default_rng(23)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789 ") + ["é", "字", "語", "𝒳", "𐍈"])
    pairs = []
    for i in range(300):
        x = list(rng.choice(letters[:37] if i % 3 else letters, rng.integers(20, 160)))
        y, room = list(x), int(0.2 * len(x))
        if i % 4 == 0:  # a block is put in or lost, so that all behind it is shifted
            at = int(rng.integers(0, len(x)))
            y[at : at + room // 2] = [] if i % 8 else list(rng.choice(letters, room))
        elif i % 4 < 3:
            for at in sorted(rng.choice(len(x), room, replace=False))[::-1]:
                y[at : at + 1] = [[], [str(rng.choice(letters))], [x[at], str(rng.choice(letters))]][int(rng.integers(3))]
        else:
            y = list(rng.choice(letters[:37], len(x)))
        pairs.append(("".join(x), "".join(y)) if len(x) <= len(y) else ("".join(y), "".join(x)))
    size, x, y = line_dedup._piece_size(0.8), F.col("x"), F.col("y")
    most = line_dedup._most("m", "n", 0.8)
    df = spark.createDataFrame(pairs, "x string, y string").withColumn("m", F.length("x")).withColumn("n", F.length("y")).withColumn("most", most)
    df = df.withColumn("wide", line_dedup._wide(x, F.col("m"), 0.8)).withColumn("tiles", line_dedup._tiles(y, size, 0.8))
    first, width = line_dedup._window(F.col("m"), F.col("n"), F.col("most"), 0.8, size)
    missing = line_dedup._missing(F.col("wide"), F.col("tiles"), first, width, size)
    free = [c.bitwiseOR(F.lit(line_dedup.FREE)) for c in line_dedup._counts(y, F.col("n"))]
    more = line_dedup._more(free, line_dedup._counts(x, F.col("m")))
    kinds = {c: i for i, k in enumerate(line_dedup.COUNTED) for c in k}
    of = lambda text: np.bincount([kinds.get(c, len(line_dedup.COUNTED)) for c in text], minlength=len(line_dedup.COUNTED) + 1)
    linked = apart = told = 0
    for r in df.select("x", "y", "most", missing.alias("missing"), more.alias("more")).collect():
        assert r["more"] == np.maximum(of(r["y"]) - of(r["x"]), 0).sum()
        if edit_distance(r["x"], r["y"]) <= r["most"]:
            linked += 1
            assert r["more"] <= r["most"] and r["missing"] <= r["most"]
        else:
            apart, told = apart + 1, told + (r["missing"] > r["most"])
    assert linked >= 150 and apart >= 70 and told >= 0.9 * apart


def test_the_join_of_lines_is_compiled(spark, monkeypatch):
    """The JVM compiles no method of more than 8,000 bytes; all pairs of lines of like lengths go through this one."""
    words = [" ".join(f"{a}{i * 37 % 101}word" for a in "abcdef") for i in range(40)]
    lines = line_dedup.staged(line_dedup._distinct(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")))
    plans, told = [], line_dedup._told(lines, spark.createDataFrame([], "node long, root long"), 0.8)
    monkeypatch.setattr(line_dedup, "_told", lambda *_: told)
    frame, write = type(told), type(told).write
    monkeypatch.setattr(frame, "write", property(lambda df: plans.append(df) or write.fget(df)))
    monkeypatch.setattr(line_dedup, "discard", lambda *_: None)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_dedup._other_links(lines, None, 0.8)
        said = spark._jvm.PythonSQLUtils.explainString(plans[-1]._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert "BroadcastHashJoin" in said and sizes and max(sizes) <= 8000


def test_unspaced_lines(spark):
    rng = np.random.default_rng(6)
    line = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 120))
    rows = [(1, line), (2, line[:50] + "X" + line[51:]), (3, line[::-1])]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: []}


def test_media_columns_against_brute_force(spark, sf):
    import hashlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark, sf).collect()}
    for r in media_columns.text_media(documents(spark, sf)).collect():
        t = texts[r["doc_id"]]
        padded = t + b"\0" * (max(1, -(-len(t) // 64)) * 64 - len(t))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_quality_learns_from_whole_texts(spark):
    """What tells the classes apart stands in the middle of texts of 20,000 bytes; the byte bound is kept."""
    rng = np.random.default_rng(1)
    body = lambda n: "".join(rng.choice(list("abcdefg hijk"), n))
    rows = [(i, body(10_000) + ("#@#@" * 100 if i % 2 else body(400)) + body(10_000)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda texts, y, seed=5: seen.append(texts) or {"constant": 0.5}
        quality.train(docs, labels)
        quality.train(docs, labels, sample_bytes=50_000)
    finally:
        quality.fit = fit
    whole = {t.encode() for _, t in rows}
    assert len(seen[0]) > 30 and set(seen[0]) <= whole and len(seen[1]) == 2


def test_pipeline_runs_from_end_to_end(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).toPandas()
    ids = {r["doc_id"] for r in documents(spark, sf).collect()}
    assert set(out.doc_id) <= ids and (out.groupby("sequence_id").length.sum() <= 4096).all()
    # each copy of a document that the mix took is packed whole, so each of its positions occurs equally often
    for _, g in out.groupby("doc_id"):
        spans = g.groupby(["start", "length"]).size()
        covered = np.zeros(int(g.doc_tokens.iloc[0]), int)
        for (a, n), k in spans.items():
            covered[a : a + n] += k
        assert covered.min() == covered.max() >= 1


def test_revised_documents_and_nested_archives():
    import io
    import zipfile

    pdf = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF\nmore\nstartxref\n20\n%%EOF"
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "x" * 50)
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("in.zip", inner.getvalue())
    found = media_columns.sniff(b"--" + pdf + b"\n" + outer.getvalue() + b"%PDF-" * 1000)
    assert [(f.kind, f.length) for f in found] == [("application/pdf", len(pdf)), ("application/zip", len(outer.getvalue()))]
