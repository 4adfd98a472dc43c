from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import scorers
from millrace.functions import text as T
from millrace.operators import checks, ranker, requests, similarity
from millrace.plans.queries import QUERIES
from millrace.sources import catalog, files
from millrace.streaming import feedback, resume, rollups


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["retrieval_rerank_topk", "quota_cap", "session_list"])
def test_limits_keep_few_rows_before_the_exchange(spark, sf, name):
    assert plan(QUERIES[name](spark, sf)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["stratified_split", "negative_samples", "positive_samples"])
def test_a_group_is_cut_into_slices(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "_s" in text and "partitionBy" not in text and "[_g#" in text


def test_numbering_is_that_of_one_window(spark):
    from pyspark.sql import Window

    from millrace.operators.sampling import numbered, shuffled

    rows = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3))
    one = rows.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(shuffled(F.col("id"), 7), "id")) - 1)
    both = numbered(rows, F.col("g"), "id", 7).join(one.select("id", "w"), "id")
    assert both.count() == 3000 and both.filter("_i <> w").count() == 0


def test_broken_arrays_are_set_aside(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"user": "u", "reply": "r", "mode": "m", "tags": ["t"]}]))
    bad.write_text('[{"user": "u", ')
    assert files.load_array(spark, str(good)).count() == 1 and good.exists()
    assert files.load_array(spark, str(bad)).count() == 0
    assert not bad.exists() and (tmp_path / "bad.json.bak").exists()
    assert files.load_array(spark, str(tmp_path / "none.json")).count() == 0


def test_arrays_are_written_whole_and_in_order(spark, tmp_path):
    path = tmp_path / "out.json"
    for n in (5, 3):
        rows = spark.range(n).select((-F.col("id")).alias("at"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("user"), F.lit(None).cast("string").alias("reply"))
        files.write_array(rows.repartition(4), str(path), "at")
    assert json.loads(path.read_text()) == [{"user": f"u{i}", "reply": None} for i in (2, 1, 0)]
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["out.json"]


def test_held_out_pairs_and_uploads(spark, tmp_path):
    chat = lambda u, a: f"<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n{u}<|im_end|>\n<|im_start|>assistant\n{a}<|im_end|>"
    path = tmp_path / "val.jsonl"
    path.write_text("\n".join(json.dumps({"text": t}) for t in (chat("a", "1"), "none", chat("b", "2"), chat("c", "3"))))
    assert [tuple(r) for r in files.held_out(spark, str(path), 2).collect()] == [("a", "1"), ("b", "2")]
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "note.md").write_text(" hello ")
    (folder / "blank.txt").write_text("  ")
    (folder / "x.exe").write_text("no")
    rows = files.upload_memories(files.uploads(spark, str(folder))).collect()
    assert [(r["title"], r["content"], r["source"]) for r in rows] == [("note", "hello", "upload")]


def test_catalog_tables(spark):
    names = catalog.create_tables(spark, "default")
    assert len(names) == 8 and catalog.create_tables(spark, "default") == names
    assert all(spark.catalog.tableExists(n) for n in names)
    catalog.create_vectors(spark, "default.vectors", 4)
    rows = spark.createDataFrame([(f"p{i}", f"u{i % 2}", "high", "t", [float(i), 1.0]) for i in range(6)], "id string, user_id string, user_priority string, topic string, embedding array<double>")
    catalog.put_vectors(rows, "default.vectors", 2, 4)
    assert catalog.get_point(spark, "default.vectors", "p3").first()["user_id"] == "u1"
    assert requests.point_count(spark, "default.vectors").first()["n"] == 6
    assert requests.point_count(spark, "default.nothing").first()["n"] == -1
    with pytest.raises(Exception, match="wide"):
        catalog.put_vectors(rows, "default.vectors", 3, 4)
    by_user = spark.table("default.vectors").groupBy("user_id").count()
    assert "Exchange hashpartitioning(user_id" not in by_user._jdf.queryExecution().executedPlan().toString()


def test_keyed_sink_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "out")
    write = resume.keyed_sink(path, "id")
    for n, ids in enumerate(([1, 2, 2], [2, 3], [1, 2, 3])):
        write(spark.createDataFrame([(i, n) for i in ids], "id long, batch long"), n)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_lines_sink_logs_whether_or_not_it_writes(spark, tmp_path):
    said: list[str] = []
    rows = spark.range(3)
    resume.lines_sink(str(tmp_path / "log"), "FEEDBACK", said.append)(rows, 0)
    resume.lines_sink("nosuchscheme://x/y", "FEEDBACK", said.append)(rows, 1)
    assert said[0] == "FEEDBACK batch 0: 3 rows" and said[1].startswith("FEEDBACK batch 1: 3 rows not written")
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def _fed(spark, tmp_path, schema, batches, build, mode="append"):
    """Results of a stream that gets the batches one after the other."""
    source, sink = tmp_path / "in", str(tmp_path / "rows")
    source.mkdir()
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    for n, rows in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
        q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(sink)
        q.awaitTermination()
    return spark.read.parquet(sink)


def test_a_day_is_final_and_late_rows_drop(spark, tmp_path):
    row = lambda day, hour, v: {"ts": f"2024-01-{day:02d}T{hour:02d}:00:00", "event_type": "a", "value": v}
    batches = [[row(1, 9, 1.0), row(1, 10, 1.0)], [row(4, 9, 1.0)], [row(1, 11, 100.0)], [row(9, 9, 1.0)], [row(12, 9, 1.0)]]
    out = _fed(spark, tmp_path, "ts timestamp, event_type string, value double", batches, lambda s: rollups.buckets(s))
    got = {str(r["start"])[:10]: (r["n"], float(r["value_sum"])) for r in out.collect()}
    assert got["2024-01-01"] == (2, 2.0) and got["2024-01-04"] == (1, 1.0)


def test_a_pending_session_times_out(spark, tmp_path):
    import time

    turn = lambda s, n, m: {"session": s, "seq": n, "message": m, "memory_text": "alpha beta gamma"}

    def build(s):
        return feedback.label_stream(s, timeout_ms=1)

    source = [[turn("x", 1, "alpha beta gamma delta")], [turn("y", 1, "other words here")], [turn("x", 2, "alpha beta gamma again")]]
    schema = "session string, seq long, message string, memory_text string"
    folder, sink = tmp_path / "in", str(tmp_path / "rows")
    folder.mkdir()
    for n, rows in enumerate(source):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = build(spark.readStream.schema(schema).json(str(folder)))
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start(sink)
        time.sleep(4)  # with a timeout there is always another trigger, so the query is stopped by the clock
        q.stop()
    # x's first turn was dropped while y's came, so its next message resolves nothing
    assert spark.read.schema(feedback.OUT).parquet(sink).filter("session = 'x'").count() == 0


def test_scorers_fall_back_to_the_rules(spark):
    rows = spark.createDataFrame([("Should I quit? Or stay? Both look wrong to me.",), (" ",), (None,)], "text string")
    out = rows.select(scorers.sentiment(F.col("text")).alias("s"), scorers.complexity(F.col("text")).alias("c"), T.complexity(F.col("text"))["label"].alias("want")).collect()
    assert [r["s"]["confidence"] for r in out][1:] == [0.0, 0.0] and out[1]["s"]["label"] == "neutral"
    assert all(r["c"]["label"] == r["want"] for r in out)


def test_ranker_learns_the_grades(spark):
    rows = ranker.split_queries(files.ranking_rows(spark, 120))
    assert rows.groupBy("query_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    model = ranker.train_ranker(rows.filter("split = 'train'"), trees=10, depth=4)
    shares = ranker.importance(model)
    assert abs(sum(shares.values()) - 1) < 1e-6 and list(shares.values()) == sorted(shares.values(), reverse=True)
    from millrace.operators.metrics import ndcg

    val = ranker.ranked(model, rows.filter("split = 'val'"))
    mean = lambda c: ndcg(val.select("query_id", "id", c.alias("score"), "grade"), 3).agg(F.avg("ndcg")).first()[0]
    assert mean(F.col("score_learned")) > mean(F.rand(1)) + 0.1


def test_greedy_duplicates_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, rnd.sample("pqrstuvw", rnd.randint(4, 6))) for i in range(150)]
    kept: dict[str, list] = {"a": [], "b": []}
    want = set()
    for t, i, s in rows:
        if any(4 * len(set(s) & o) > 3 * len(set(s) | o) for o in kept[t]):
            want.add(i)
        else:
            kept[t].append(set(s))
    got = similarity.greedy_duplicates(spark.createDataFrame(rows, "topic string, id long, tokens array<string>"))
    assert {r["id"] for r in got.collect()} == want


def test_split_problems_name_what_is_wrong(spark):
    ok = "<|im_start|>system s<|im_end|><|im_start|>user u<|im_end|><|im_start|>assistant a<|im_end|>"
    rows = spark.createDataFrame([("m", "train", ok), ("m", "train", None), ("n", "train", ok), ("n", "val", ok), ("n", "val", ok + "x" * 9000)], "mode string, split string, text string")
    got = {r["mode"]: r["problems"] for r in checks.split_problems(rows).collect()}
    assert "val: empty" in got["m"] and "train: 1 no usable text" in got["m"] and got["n"] == ["val: 1 over 2048 tokens"]


def test_shown_percent_and_dates(spark):
    rows = spark.createDataFrame([(1.0, 8.0), (1.0, 0.0), (None, 4.0), (9.0, 4.0)], "a double, b double")
    assert [r[0] for r in rows.select(T.shown_percent(F.col("a"), F.col("b"))).collect()] == [13, 0, 0, 100]
    days = spark.createDataFrame([("2024-02-30",), ("2024-02-29T10:00",), ("x",), (None,)], "v string")
    assert [str(r[0]) for r in days.select(T.parse_day(F.col("v"))).collect()] == ["None", "2024-02-29", "None", "None"]
