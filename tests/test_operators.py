from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.operators import feedback, gates, insights, metrics, sampling, similarity, tables
from millrace.sources import files
from millrace.streaming import rollups
from millrace.streaming.feedback import label_stream


def sets(spark, rows):
    return spark.createDataFrame(rows, "id long, tokens array<string>")


def brute(rows, num=3, den=4):
    out = set()
    for a, x in rows:
        for b, y in rows:
            x1, y1 = set(x), set(y)
            if a > b and x1 and y1 and den * len(x1 & y1) > num * len(x1 | y1):
                out.add((a, b, len(x1 & y1), len(x1 | y1)))
    return out


def test_jaccard_threshold_is_strict(spark):
    rows = [(1, list("abcd")), (2, list("abc")), (3, list("abcd")), (4, []), (5, list("abcde")), (6, list("abcdefgh")), (7, list("abcdefghi"))]
    got = {tuple(r) for r in similarity.jaccard_pairs(sets(spark, rows)).collect()}
    assert got == brute(rows) and (2, 1, 3, 4) not in got


def test_greedy_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [("g", i, rng.sample("abcdefgh", rng.randint(3, 6)), rng.random() > 0.2) for i in range(60)]
    got = {r["id"]: r["kept"] for r in similarity.greedy_keep(spark.createDataFrame(rows, "grp string, id long, tokens array<string>, passes boolean"), window=5).collect()}
    kept = []
    for _, i, t, ok in rows:
        near = any(4 * len(set(t) & o) > 3 * len(set(t) | o) for o in kept[-5:])
        assert got[i] == (ok and not near)
        if got[i]:
            kept.append(set(t))


def test_split_sizes(spark):
    rows = [(f"s{n}", f"{n}-{i}") for n in (9, 10, 25, 35) for i in range(n)]
    out = sampling.stratified_split(spark.createDataFrame(rows, "topic string, id string"), "topic", "id")
    held = {r["topic"]: r["n"] for r in out.filter("split = 'val'").groupBy("topic").agg(F.count("*").alias("n")).collect()}
    assert held == {"s10": 1, "s25": 2, "s35": 4}


def test_mood(spark):
    rows = [(1, "negative"), (1, "anxious"), (1, "neutral"), (1, "positive"), (2, None), (3, "positive"), (3, "motivated"), (3, "neutral")]
    df = spark.createDataFrame(rows, "u int, sentiment string")
    assert {r["u"]: r["m"] for r in df.groupBy("u").agg(insights.mood().alias("m")).collect()} == {1: "mixed", 2: "mixed", 3: "strong"}


def test_few_messages_make_no_insight(spark):
    rows = [(1, "2024-01-01 10:00:00", i, "text with words", "neutral") for i in range(2)]
    m = spark.createDataFrame(rows, "user_id int, ts string, seq int, text string, sentiment string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert insights.daily(m).count() == 0


def test_patches(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    assert sorted(map(tuple, tables.merge_fields(df, spark.createDataFrame([(1, None, 9)], "id int, x string, y int"), "id").collect())) == [(1, "a", 9), (2, "b", 2)]
    patch = spark.createDataFrame([(1, None, True)], "id int, x string, has_x boolean")
    assert sorted(map(tuple, tables.set_fields(df, patch, "id").collect()), key=str)[0] == (1, None, 1)


def test_gates(spark):
    spec = gates.PersonaSpec("p", (2, 4), (2, 5), markers=("runway",), require_verse=True, require_ends_with_question=True, forbidden_phrases=("you must",))
    rows = [(1, "one two", "runway 2.47 krishna says?"), (2, "", "x"), (3, "one two", " "), (4, "one", "You must act. Why? How?")]
    found = {r["id"]: r["r"] for r in spark.createDataFrame(rows, "id int, user string, reply string").select("id", gates.reasons(spec).alias("r")).collect()}
    assert found[1] == [] and found[2] == ["'user' is missing or empty"] and found[3] == ["'reply' is missing or empty"]
    assert len(found[4]) == 5
    near = spark.createDataFrame([], "id int")
    report = gates.quality_report(spark.createDataFrame(rows, "id int, user string, reply string").withColumn("topic", F.lit("t")), spec, near).first()
    assert report["verdict"] == "needs_review" and "verse_rate" in report["blocking_issues"]
    assert gates.quality_report(spark.createDataFrame([], "id int, user string, reply string, topic string"), spec, near).first()["verdict"] == "empty"


def test_metrics(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, 3), ("q", 2, 0.8, 0), ("z", 1, 0.5, 0)], "query_id string, id int, score double, grade int")
    assert {r["query_id"]: r["ndcg"] for r in metrics.ndcg(rows, 3).collect()} == {"q": 1.0, "z": 1.0}


def turns(spark):
    rows = [("s", 1, "buy green apples today", "apples"), ("s", 2, "green apples taste well", "pears"), ("s", 3, "nothing alike", ""), ("t", 1, "alone", "x")]
    return spark.createDataFrame(rows, "session string, seq long, message string, memory_text string")


def test_feedback_batch_and_stream_agree(spark, tmp_path):
    batch = sorted(tuple(r) for r in feedback.label_turns(turns(spark)).collect())
    assert [(r[0], r[1], r[6]) for r in batch] == [("s", 1, True), ("s", 2, False)]
    turns(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns(spark).schema).parquet(str(tmp_path / "in"))
    q = label_stream(stream, None).writeStream.format("memory").queryName("labels").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("labels").collect()) == batch


def test_stream_rollup(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    q = rollups.buckets(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, rollups.buckets(events).collect()))


def test_sources(spark, tmp_path):
    good = tmp_path / "rows.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\nnot json\n')
    assert files.read_lines(spark, str(good), "a int").count() == 2
    array = tmp_path / "pairs.json"
    array.write_text(json.dumps([{"user": " u ", "reply": "r", "mode": "m", "tags": ["t"]}, {"user": " ", "reply": "r"}]))
    assert files.count_rows(spark, str(array)) == 2 and files.count_rows(spark, str(tmp_path / "none.json")) == 0
    assert [tuple(r) for r in files.pools(spark, {"m": str(array), "n": str(tmp_path / "none.json")}).collect()] == [("m", "u")]
    files.write_lines(files.read_array(spark, str(array)), str(tmp_path / "out"))
    assert files.read_lines(spark, str(tmp_path / "out"), files.PAIR, strict=True).count() == 2
    assert files.read_prompt(spark, str(tmp_path / "none.txt"), "default") == "default"
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.txt").write_bytes("é".encode())
    (up / "c.exe").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["accepted"], r["why"]) for r in files.uploads(spark, str(up)).collect()}
    assert got == {"a.txt": (True, None), "c.exe": (False, "type")}
    assert files.template_rows(spark, {"x": ["a {}", "b {}"]}, ["1", "2", "3"], 4).count() == 4
    ranking = files.ranking_rows(spark, 5, 4)
    assert ranking.count() == 20 and ranking.filter("grade not between 0 and 3").count() == 0
    assert "_pending_" in files.markdown(spark.createDataFrame([("a", 1.0)], "config string, x double"), ["a", "b"], "config", ["x"])


def test_dataset_report_blocks_on_near_duplicates(spark, monkeypatch):
    from millrace.plans import queries

    verdicts = []
    for copies in (0, 1):
        rows = [(i, " ".join(f"w{i}x{k}" for k in range(8)), "the reply", "3") for i in range(520)]
        rows += [(1000 + i, rows[i][1] + " more", "the reply", "3") for i in range(copies)]
        monkeypatch.setattr(queries, "_pairs_table", lambda *_: spark.createDataFrame(rows, "id long, user string, reply string, topic string"))
        verdicts.append(queries.dataset_report(spark, "").first()["verdict"])
    assert verdicts == ["ok_to_train", "needs_review"]


def test_joins_of_large_sets_and_copies_against_brute_force(spark):
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = rng.sample(words, rng.choice([1, 2, 5, 30, 150]))
        for _ in range(rng.randint(1, 4)):  # copies in another order, or a few tokens other
            keep = [w for w in base if rng.random() > rng.choice([0, 0.05, 0.15])]
            rows.append((3 * len(rows), rng.sample(keep, len(keep))))
    pairs = {tuple(r) for r in similarity.jaccard_pairs(sets(spark, rows)).collect()}
    assert pairs == brute(rows) and len(pairs) > 20
    best = {}
    for a, b, i, u in pairs:
        best[a] = max(best.get(a, (0, 0)), (i / u, -b))
    assert {r["id"]: (r["score"], -r["match"]) for r in similarity.worst_match(sets(spark, rows)).collect()} == best
    new, old = rows[::2], rows[1::2]
    first = {}
    for a, b, *_ in pairs:
        for n, o in ((a, b), (b, a)):
            if any(n == r[0] for r in new) and any(o == r[0] for r in old):
                first[n] = min(first.get(n, o), o)
    assert {r["id"]: r["match"] for r in similarity.first_duplicate(sets(spark, new), sets(spark, old)).collect()} == first


def test_rows_without_id_and_low_thresholds_leave_no_pair_out(spark):
    def set_of(first, n):
        return [f"t{i}" for i in range(first, first + n)]

    rows = [(None, set_of(0, 8)), (1, set_of(0, 8)), (2, set_of(0, 8)), (3, set_of(0, 7)), (None, set_of(0, 7)), (4, set_of(20, 5)), (None, set_of(20, 5)), (5, set_of(20, 6)), (None, None), (6, None)]
    known = [r for r in rows if r[0] is not None and r[1]]
    assert {tuple(r) for r in similarity.jaccard_pairs(sets(spark, rows)).collect()} == brute(known)
    assert {(r["id"], r["match"]) for r in similarity.worst_match(sets(spark, rows)).collect()} == {(2, 1), (3, 1), (5, 4)}
    assert {(r["id"], r["match"]) for r in similarity.first_duplicate(sets(spark, rows[3:]), sets(spark, rows[:3])).collect()} == {(3, 1)}
    topics = sets(spark, rows).withColumn("topic", F.lit("t"))
    assert {r["id"] for r in similarity.greedy_duplicates(topics).collect()} == {2, 3, 5}
    few = [(1, set_of(0, 100)), (2, set_of(95, 100))]  # five of 195
    assert {tuple(r) for r in similarity.jaccard_pairs(sets(spark, few), 1, 50).collect()} == brute(few, 1, 50) == {(2, 1, 5, 195)}
    assert similarity.worst_match(sets(spark, few), 1, 50).first()["match"] == 1


def test_copies_are_not_paired(spark):
    copies = spark.range(20_000).select("id", F.lit("t").alias("topic"), F.array(F.lit("x"), F.lit("y")).alias("tokens"))
    assert similarity.greedy_duplicates(copies).count() == 19_999
    assert similarity.worst_match(copies).filter("match = 0 and score = 1").count() == 19_999


def test_greedy_keep_streams_its_groups(spark):
    rows = spark.createDataFrame([("g", 1, ["a", "b"], True), ("g", 2, ["b", "a"], True), (None, 1, ["a", "b"], True), (None, 2, [], True), (None, 3, None, None)], "grp string, id long, tokens array<string>, passes boolean")
    out = similarity.greedy_keep(rows)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert {(r["grp"], r["id"]): r["kept"] for r in out.collect()} == {("g", 1): True, ("g", 2): False, (None, 1): True, (None, 2): True, (None, 3): False}
