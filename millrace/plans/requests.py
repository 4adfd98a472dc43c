"""Registered queries of what requests and file checks ask, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scorers
from ..functions import text as T
from ..operators import checks, gates, insights, metrics, ranker, requests, retrieval, sampling
from ..sources.files import ranking_rows
from .queries import CHAT_SQL, MEM_SQL, TEXTS_SQL, _list, _q, chat, memories, query, table, texts


@query("""SELECT doc_id, substring(text, 1, 255) AS title, greatest(1, least(10, doc_id % 15 - 2)) AS importance, len(coalesce(tags, [])) AS n_tags, md5(CASE WHEN text <> '' THEN text || '. ' || source ELSE source END) AS embed_md5
 FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN [lang] END AS tags FROM documents)""")
def new_memories(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"), F.col("source").alias("content"), (F.col("doc_id") % 15 - 2).alias("importance"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("tags"))
    out = requests.new_memories(rows)
    return out.select("doc_id", "title", F.col("importance").cast("long").alias("importance"), F.size("tags").cast("long").alias("n_tags"), F.md5("embed_text").alias("embed_md5"))


@query(f"""WITH {MEM_SQL} SELECT user_id, id AS memory_id, title, source, CASE WHEN id % 7 = 0 THEN '' ELSE topic END AS topic, 0 AS n_tags, CASE WHEN id % 5 = 0 THEN 0 ELSE access_count END AS access_count,
 strftime(CASE WHEN id % 6 = 0 THEN TIMESTAMP '2024-02-01' ELSE created_date END, '%Y-%m-%dT%H:%M:%S') AS created_date FROM mem""")
def memory_payload(spark, d):
    m, i = memories(spark, d), F.col("id")
    rows = m.withColumn("topic", F.when(i % 7 != 0, F.col("topic"))).withColumn("access_count", F.when(i % 5 != 0, F.col("access_count"))).withColumn("created_date", F.when(i % 6 != 0, F.col("created_date"))).withColumn("tags", F.lit(None).cast("array<string>"))
    return requests.payload(rows, F.lit("2024-02-01").cast("timestamp")).select("user_id", "memory_id", "title", "source", "topic", F.size("tags").cast("long").alias("n_tags"), "access_count", "created_date")


@query(f"""WITH {MEM_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 0.0 ELSE id / 8.0 END::DOUBLE AS score, CASE WHEN id % 9 <> 0 THEN title END AS title, CASE WHEN id % 9 <> 0 THEN content END AS content, CASE WHEN id % 9 <> 0 THEN topic END AS topic,
 CASE WHEN id % 9 <> 0 THEN importance END AS importance, CASE WHEN id % 9 <> 0 THEN user_priority END AS user_priority, CASE WHEN id % 9 <> 0 THEN source END AS source FROM mem""")
def search_projection(spark, d):
    i = F.col("id")
    body = F.struct("title", "content", "topic", "importance", "user_priority", "source")
    return requests.search_results(memories(spark, d).select("id", F.when(i % 4 != 0, i / 8.0).alias("score"), F.when(i % 9 != 0, body).alias("payload")))


@query(f"WITH {MEM_SQL} SELECT id, title FROM mem WHERE id % 3 = 0 AND (id % 6 = 0 OR id % 5 = user_id)")
def tenant_guard(spark, d):
    m, i = memories(spark, d), F.col("id")
    by = m.filter(i % 3 == 0).select("id", F.when(i % 6 != 0, i % 5).alias("user_id"))
    return requests.visible(by, m, "id").select("id", "title")


@query(f"""WITH {MEM_SQL} SELECT id, CASE WHEN id % 6 = 0 THEN 'new title' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 'moved' ELSE topic END AS topic, id % 6 = 0 AS needs_embed FROM mem""")
def memory_update(spark, d):
    """A changed title needs a new vector; a changed topic doesn't, nor does a content that is set to what it was."""
    m, i = memories(spark, d).select("id", "title", "content", "topic"), F.col("id")
    patch = m.filter(i % 3 == 0).select("id", F.when(i % 2 == 0, "new title").alias("title"), "content", F.lit("moved").alias("topic"))
    return requests.update_memories(m, patch, "id").select("id", "title", "topic", "needs_embed")


@query(f"WITH {MEM_SQL} SELECT id, md5(title || '. ' || content) AS embed_md5 FROM mem WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 6 <> 0)")
def reembed_orphans(spark, d):
    vectors = table(spark, d, "embeddings").filter("vec_id % 6 <> 0").select(F.col("vec_id").alias("id"))
    return requests.orphans(memories(spark, d), vectors).select("id", F.md5("embed_text").alias("embed_md5"))


@query("""WITH s AS (SELECT DISTINCT conv_id FROM conversations) SELECT c_custkey, coalesce(s.conv_id::VARCHAR, 'new-' || c_custkey) AS session, s.conv_id IS NULL AS created FROM customer LEFT JOIN s ON s.conv_id = CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 2 END""")
def open_sessions(spark, d):
    k = F.col("c_custkey")
    known = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"))
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 3 != 0, (k * 2).cast("string")).alias("session"))
    return requests.open_sessions(rows, known, F.concat(F.lit("new-"), k.cast("string")))


_SESSION_SQL = "ses AS (SELECT conv_id AS session, conv_id % 10 AS user_id, conv_id % 4 = 1 AS archived, conv_id % 3 <> 0 AS is_active, max(turn) AS updated_date FROM conversations GROUP BY conv_id)"


def _sessions(spark, d):
    s = F.col("session")
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session")).agg(F.max("turn").alias("updated_date"))
    return rows.select("session", (s % 10).alias("user_id"), (s % 4 == 1).alias("archived"), (s % 3 != 0).alias("is_active"), "updated_date")


@query(f"WITH {_SESSION_SQL} SELECT session, archived OR session % 5 = 0 AS archived, is_active AND session % 5 <> 0 AS is_active FROM ses")
def archived_sessions(spark, d):
    s = _sessions(spark, d)
    return requests.archive(s, s.filter("session % 5 = 0"), "session").select("session", "archived", "is_active")


@query(f"WITH {_SESSION_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_date DESC, session) AS rank FROM ses WHERE NOT archived) SELECT user_id, session, rank FROM r WHERE rank <= 5")
def session_list(spark, d):
    return requests.session_list(_sessions(spark, d), 5).select("user_id", "session", F.col("rank").cast("long").alias("rank"))


@query("SELECT conv_id AS session, turn AS seq, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3")
def session_messages(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")
    return requests.session_messages(rows, 3).drop("rank")


_GOAL_SQL = "goal AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_date, CASE o_orderstatus WHEN 'O' THEN 'active' ELSE 'done' END AS status FROM orders)"


def _goals(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_date"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("done").alias("status"))


@query(f"WITH {_GOAL_SQL} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_date, id) AS n FROM goal WHERE status = 'active') WHERE n <= 5")
def active_goals(spark, d):
    return requests.goals(_goals(spark, d), True, 5).select("user_id", "id")


@query(f"WITH {_GOAL_SQL} SELECT user_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_date DESC, id) AS n FROM goal) WHERE n <= 5")
def all_goals(spark, d):
    return requests.goals(_goals(spark, d), False, 5).select("user_id", "id", "status")


@query("""WITH r AS (SELECT doc_id, n_chars FROM documents WHERE lang = 'en'), p AS (SELECT doc_id, n_chars FROM r ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 20)
 SELECT (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY n_chars DESC, doc_id) FROM p) AS items, (SELECT count(*) FROM r) AS total, 20 AS skip, 100 AS "limit" """)
def page_envelope(spark, d):
    """500 rows are asked for; a page has 100 at most."""
    rows = table(spark, d, "documents").filter("lang = 'en'")
    out = requests.envelope(rows, F.col("doc_id").cast("string"), [F.desc("n_chars"), F.asc("doc_id")], 20, 500)
    return out.select(F.array_join("items", ",").alias("items"), "total", F.col("skip").cast("long").alias("skip"), F.col("limit").cast("long").alias("limit"))


@query("SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 200 AND (text ILIKE '%the%') GROUP BY 1")
def filtered_counts(spark, d):
    return requests.counted(table(spark, d, "documents"), "source", equal={"lang": "en", "source": None}, since=("n_chars", 200), search=(["text"], "the"))


@query("SELECT vec_id % 8 AS user_id, count(*) AS n FROM embeddings GROUP BY 1")
def point_counts(spark, d):
    return requests.counted(memories(spark, d), "user_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06') WHERE n = 1")
def last_of_day(spark, d):
    rows = table(spark, d, "events")
    return requests.of_day(rows, F.lit("2024-01-05").cast("timestamp_ntz"), key="event_id").select("user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS pos FROM r WHERE n <= 7""")
def mood_strip(spark, d):
    out = requests.recent(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS ranker, n_chars FROM documents")
def public_fields(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("tier:heuristic")).otherwise(F.col("lang")).alias("ranker"), "n_chars", F.lit(1).alias("latency_ms"), F.col("source").alias("provider"))
    return requests.public(rows)


_TAGGED_SQL = "tagged AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN [lang, source] WHEN 1 THEN CAST([] AS VARCHAR[]) END AS tags FROM documents)"


def _tagged(spark, d):
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select("doc_id", "source", F.when(k == 0, F.array("lang", "source")).when(k == 1, F.array().cast("array<string>")).alias("tags"))


@query(f"WITH {_TAGGED_SQL} SELECT doc_id, coalesce(tags[1], CASE WHEN doc_id % 2 = 0 THEN source END, '') AS topic FROM tagged")
def topic_of(spark, d):
    return _tagged(spark, d).select("doc_id", checks.topic_of(F.col("tags"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("topic"))


@query(f"WITH {_TAGGED_SQL} SELECT coalesce(tags[1], '?') AS topic, count(*) AS n FROM tagged GROUP BY 1")
def tag_counts(spark, d):
    return checks.tag_counts(_tagged(spark, d))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND trim(coalesce(text, '')) <> '' AND doc_id % 7 <> 0")
def usable_triplets(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("anchor"), F.when(k % 5 == 0, F.col("text")).otherwise("other").alias("positive"), F.when(k % 7 == 0, " ").otherwise("third").alias("negative"))
    return checks.usable_triplets(rows).select("doc_id")


_SPLIT_SQL = """sp AS (SELECT source AS mode, CASE WHEN doc_id % 10 = 3 THEN 'val' ELSE 'train' END AS split, CASE WHEN doc_id % 50 = 7 THEN ' ' WHEN doc_id % 40 = 9 THEN text
 ELSE '<|im_start|>system x<|im_end|><|im_start|>user ' || coalesce(text, '') || '<|im_end|><|im_start|>assistant y<|im_end|>' END AS text FROM documents)"""


@query(f"""WITH {_SPLIT_SQL}, r AS (SELECT mode, split, x.why, count(*) AS n FROM sp, LATERAL (SELECT unnest(list_filter([CASE WHEN trim(text) = '' THEN 'no usable text' END, {", ".join(f"CASE WHEN NOT contains(text, {_q(m)}) THEN 'missing {m}' END" for m in checks.MARKERS)},
 CASE WHEN length(text) // 4 > 2048 THEN 'over 2048 tokens' END], lambda y: y IS NOT NULL)) AS why) x GROUP BY 1, 2, 3),
 e AS (SELECT m.mode, s.split FROM (SELECT DISTINCT mode FROM sp) m, (VALUES ('train'), ('val')) s(split) EXCEPT SELECT mode, split FROM sp),
 a AS (SELECT mode, split || ': ' || n || ' ' || why AS p FROM r UNION ALL SELECT mode, split || ': empty' FROM e)
 SELECT m.mode, coalesce(string_agg(p, '; ' ORDER BY p), '') AS problems FROM (SELECT DISTINCT mode FROM sp) m LEFT JOIN a ON a.mode = m.mode GROUP BY 1""")
def split_problems(spark, d):
    k = F.col("doc_id")
    chatml = F.concat(F.lit("<|im_start|>system x<|im_end|><|im_start|>user "), F.coalesce("text", F.lit("")), F.lit("<|im_end|><|im_start|>assistant y<|im_end|>"))
    rows = table(spark, d, "documents").select(F.col("source").alias("mode"), F.when(k % 10 == 3, "val").otherwise("train").alias("split"), F.when(k % 50 == 7, " ").when(k % 40 == 9, F.col("text")).otherwise(chatml).alias("text"))
    return checks.split_problems(rows).select("mode", F.array_join("problems", "; ").alias("problems"))


@query("SELECT round(avg(length(coalesce(text, '')) // 4), 6) AS avg_tokens, max(length(coalesce(text, '')) // 4) AS max_tokens FROM documents")
def length_stats(spark, d):
    return checks.lengths(table(spark, d, "documents")).select(F.round("avg_tokens", 6).alias("avg_tokens"), "max_tokens")


@query("SELECT lang, count(*) AS n, round(avg(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0B]+'))), 6) AS avg_words, round(avg(length(text)), 6) AS avg_chars FROM documents GROUP BY 1")
def class_lengths(spark, d):
    return checks.class_lengths(table(spark, d, "documents"), "lang", "text").select("lang", "n", F.round("avg_words", 6).alias("avg_words"), F.round("avg_chars", 6).alias("avg_chars"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 9 = 0")
def drift(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_comment" if "o_comment" in table(spark, d, "orders").columns else "o_orderstatus")
    value = o.columns[1]
    made = o.filter("o_orderkey % 9 <> 0").withColumn(value, F.when(F.col("o_orderkey") % 8 == 0, F.concat(F.col(value), F.lit("!"))).otherwise(F.col(value)))
    return requests.drift(o, made, "o_orderkey", value)


@query(f"""WITH {TEXTS_SQL}, s AS (SELECT id, list_filter(regexp_extract_all(text, '(?s)[^.!?]*[.!?]+[\\s"'')\\]]*|[^.!?]+$'), lambda x: x <> '') AS ss FROM texts), u AS (SELECT id, unnest(range(len(ss))) AS pos, ss FROM s)
 SELECT id, pos, list_sum(list_transform(ss[1:pos], lambda x: length(x)))::BIGINT AS at, ss[pos + 1] AS sentence FROM u WHERE pos > 0 UNION ALL SELECT id, 0, 0, ss[1] FROM s WHERE len(ss) > 0""")
def sentence_offsets(spark, d):
    return texts(spark, d).select("id", F.posexplode(T.sentence_offsets(F.col("text"))).alias("pos", "s")).select("id", F.col("pos").cast("long").alias("pos"), F.col("s.at").cast("long").alias("at"), "s.sentence")


_DATES = ["2024-03-05", "2024-03-05T10:20:30", "2024-02-30", "05.03.2024", "", "2024-12-30"]


@query(f"""SELECT o_orderkey, CAST(CASE v WHEN '2024-03-05' THEN '2024-03-05' WHEN '2024-03-05T10:20:30' THEN '2024-03-05' WHEN '2024-12-30' THEN '2024-12-30' END AS DATE) AS day,
 CASE WHEN v = '' THEN CAST(date_trunc('week', o_orderdate) AS DATE) ELSE CAST(CASE v WHEN '2024-03-05' THEN '2024-03-05' WHEN '2024-03-05T10:20:30' THEN '2024-03-05' WHEN '2024-12-30' THEN '2024-12-30' END AS DATE) END AS week_start,
 CASE v WHEN '' THEN '' WHEN '2024-02-30' THEN v WHEN '05.03.2024' THEN v WHEN '2024-12-30' THEN 'Monday, December 30' ELSE 'Tuesday, March 5' END AS headline FROM (SELECT *, ([{_list(_DATES)}])[o_orderkey % 6 + 1] AS v FROM orders)""")
def request_dates(spark, d):
    v = F.element_at(F.array(*map(F.lit, _DATES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_day(v).alias("day"), T.week_start(v, F.col("o_orderdate")).alias("week_start"), T.long_date(v).alias("headline"))


@query("""SELECT o_orderkey, greatest(0.0, least(cur + delta, coalesce(target, 1.0)))::DOUBLE AS bumped, CASE WHEN target IS NULL OR target = 0 THEN 0 ELSE least(100, floor(cur / target * 100 + 0.5)) END::BIGINT AS percent
 FROM (SELECT o_orderkey, (o_orderkey % 40)::DOUBLE AS cur, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 30)::DOUBLE END AS target, (o_orderkey % 11 - 8)::DOUBLE AS delta FROM orders)""")
def goal_steps(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (k % 40).cast("double").alias("cur"), F.when(k % 7 > 0, (k % 30).cast("double")).alias("target"), (k % 11 - 8).cast("double").alias("delta"))
    return rows.select("o_orderkey", T.bump(F.col("cur"), F.col("target"), F.col("delta")).alias("bumped"), T.shown_percent(F.col("cur"), F.col("target")).cast("long").alias("percent"))


@query("""SELECT o_custkey AS run, count(*) >= 5 AS ready, count(*) >= 5 AND bool_and(o_orderstatus <> 'P') AS publish FROM orders GROUP BY 1""")
def publish_gate(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("ok_to_train").alias("verdict"))
    return checks.publishable(rows, "run", 5)


@query("""WITH n AS (SELECT doc_id, md5(doc_id || ':42') AS h FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= (SELECT floor(0.9 * count(*)) FROM n) THEN 'train' ELSE 'val' END AS split FROM n""")
def shuffled_split(spark, d):
    return sampling.shuffled_split(table(spark, d, "documents").select("doc_id"), "doc_id")


_DAY_CHAT_SQL = "c AS (SELECT *, CAST(ts AS DATE) AS day FROM chat)"


@query(f"""WITH {CHAT_SQL}, {_DAY_CHAT_SQL}, b AS (SELECT user_id, day, count(*) AS message_count, string_agg(message, ' ' ORDER BY pos) FILTER (message <> '') AS corpus FROM c GROUP BY 1, 2 HAVING count(*) >= 3),
 p AS (SELECT user_id, day, substring(replace(trim(message), chr(10), ' '), 1, 80) || CASE WHEN length(message) > 80 THEN '...' ELSE '' END AS s, sentiment IN ({_list(C.POSITIVE)}) AS good, pos FROM c WHERE message <> '' AND sentiment IN ({_list([*C.POSITIVE, *C.NEGATIVE])})),
 q AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, good ORDER BY pos) AS n FROM p),
 t AS (SELECT user_id, day, string_agg(s, '|' ORDER BY pos) FILTER (good) AS a, string_agg(s, '|' ORDER BY pos) FILTER (NOT good) AS h FROM q WHERE n <= 5 GROUP BY 1, 2)
 SELECT b.user_id, b.day, message_count, round(CASE WHEN b.user_id % 2 = 0 THEN least(100.0, CASE WHEN contains(lower(corpus), 'the') THEN 100.0 ELSE 0.0 END + CASE WHEN message_count > 5 THEN 10 ELSE 0 END)
 ELSE least(100.0, 40 + CASE WHEN message_count > 5 THEN 10 ELSE 0 END + least(30, 3 * message_count)) END, 6)::DOUBLE AS alignment, coalesce(a, '') AS achievements, coalesce(h, '') AS challenges
 FROM b LEFT JOIN t ON t.user_id = b.user_id AND t.day = b.day""")
def full_daily_insights(spark, d):
    rows = chat(spark, d).select("user_id", "ts", F.col("pos").alias("seq"), F.col("message").alias("text"), "sentiment")
    goals = spark.range(10).select((F.col("id") * 2).alias("user_id"), F.lit("").alias("goal_name"), F.lit("the").alias("category"))
    out = insights.full_daily(rows, goals)
    return out.select("user_id", "day", "message_count", F.round("alignment", 6).alias("alignment"), F.array_join("achievements", "|").alias("achievements"), F.array_join("challenges", "|").alias("challenges"))


_BATCH_SQL = """b AS (SELECT o_orderkey AS id, o_orderstatus AS topic, o_custkey % 500 AS c, o_orderkey % 7 AS p FROM orders WHERE o_orderkey % 4 = 0),
 k AS (SELECT DISTINCT o_custkey % 500 AS c, o_orderkey % 7 AS p FROM orders WHERE o_orderkey % 4 = 1 AND o_custkey % 500 < 50)"""


@query(f"""WITH {_BATCH_SQL}, s1 AS (SELECT b.*, CASE WHEN id % 10 = 0 THEN 'rejected' WHEN k.c IS NOT NULL THEN 'duplicate' WHEN id % 12 = 4 THEN 'advice' END AS s FROM b LEFT JOIN k ON k.c = b.c AND k.p = b.p),
 s2 AS (SELECT id, topic, CASE WHEN s IS NOT NULL THEN s WHEN row_number() OVER (PARTITION BY topic, c, p, s IS NULL ORDER BY id) > 1 THEN 'duplicate' END AS s FROM s1),
 s3 AS (SELECT *, row_number() OVER (PARTITION BY topic, s IS NULL ORDER BY id) AS n FROM s2) SELECT id, topic, CASE WHEN s IS NOT NULL THEN s WHEN topic = 'F' AND n > 80 THEN 'over_quota' WHEN topic = 'O' AND n > 150 THEN 'over_quota' ELSE 'accepted' END AS state FROM s3""")
def accept_batch(spark, d):
    """Two tokens a row: sets are equal or far from similar, so the first of equal rows is what greedy acceptance keeps."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    tokens = F.array(F.concat(F.lit("c"), (F.col("o_custkey") % 500).cast("string")), F.concat(F.lit("p"), (k % 7).cast("string")))
    batch = o.filter(k % 4 == 0).select(k.alias("id"), F.col("o_orderstatus").alias("topic"), tokens.alias("tokens"), F.when(k % 10 == 0, F.array(F.lit("too short"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(k % 12 == 4, True).when(k % 12 != 8, False).alias("advises"))
    known = o.filter((k % 4 == 1) & (F.col("o_custkey") % 500 < 50)).select(k.alias("id"), tokens.alias("tokens"))
    quotas, have = (spark.createDataFrame(r, "topic string, " + c) for r, c in (([("F", 100), ("O", 150)], "quota int"), ([("F", 20)], "n long")))
    return checks.accept(batch, have, quotas, known)


@query(f"WITH {TEXTS_SQL} SELECT id, CASE WHEN length(text) % 2 = 0 THEN 'long' WHEN length(text) > 0 THEN 'rules' END AS complexity_from, CASE WHEN trim(text) = '' THEN 'neutral' WHEN length(text) % 2 = 0 THEN 'model' ELSE 'rules' END AS sentiment_from FROM texts WHERE length(text) > 0 AND NOT regexp_matches(text, '^[ \\n]*$')")
def model_scores(spark, d):
    """A stand-in model answers for texts of an even length; for others the rules do."""

    def load():
        import pandas as pd

        def score(x):
            known = x.str.len() % 2 == 0
            return pd.DataFrame({"label": known.map({True: "long", False: None}), "confidence": known.map({True: 1.0, False: None})})

        return score

    t = F.col("text")
    rows = texts(spark, d).filter(F.length("text") > 0).filter(~t.rlike(r"^[ \n]*$"))
    mine = lambda c, name: F.when(c["label"] == "long", name).otherwise("rules")
    return rows.select("id", mine(scorers.complexity(t, load), "long").alias("complexity_from"), mine(scorers.sentiment(t, load), "model").alias("sentiment_from"))


@query()
def learned_ranker(spark, d):
    """NDCG@3 of trees and of the blend on queries that were not trained on."""
    rows = ranker.split_queries(ranking_rows(spark, 200))
    scored = ranker.ranked(ranker.train_ranker(rows.filter("split = 'train'"), trees=15, depth=4), rows.filter("split = 'val'"))
    of = lambda c, name: metrics.ndcg(scored.select("query_id", "id", F.col(c).alias("score"), "grade"), 3).agg(F.lit(name).alias("scorer"), F.round(F.avg("ndcg"), 4).alias("ndcg"))
    return of("score_learned", "trees").unionByName(of("score", "blend"))


_SOURCE = "intro\n# ====\n# SECTION 1 — SETUP\n# first\n# second\n# ====\n{}\n# ====\n# SECTION 2 — END\n# ====\nlast"


@query("SELECT doc_id, 1 AS number, 'SETUP' AS title, 'first' || chr(10) || 'second' AS prose, lang || chr(10) || source AS body FROM documents UNION ALL SELECT doc_id, 2, 'END', '', 'last' FROM documents")
def sections(spark, d):
    before, after = _SOURCE.split("{}")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit(before), F.coalesce(F.concat("lang", F.lit("\n"), "source"), F.lit("")), F.lit(after)).alias("text"))
    return checks.sections(rows, "doc_id").withColumn("number", F.col("number").cast("int"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'the response is N words, below the N-word minimum' WHEN doc_id % 3 = 1 THEN 'the response gives direct advice' ELSE 'scored N' END AS reason FROM documents) GROUP BY 1""")
def reason_histogram(spark, d):
    k = F.col("doc_id")
    reason = F.when(k % 3 == 0, F.concat(F.lit("the response is "), (k % 50).cast("string"), F.lit(" words, below the 30-word minimum"))).when(k % 3 == 1, F.concat(F.lit("the response gives direct advice ('"), F.col("lang"), F.lit("')"))).otherwise(F.concat(F.lit("scored 0."), k.cast("string")))
    return gates.histogram(table(spark, d, "documents").select(F.array(F.coalesce(reason, F.lit("the response gives direct advice"))).alias("reasons")))


@query("SELECT event_type, count(*) FILTER (value >= 10) AS judged, round(count(*) FILTER (value >= 10) / count(*), 6)::DOUBLE AS coverage FROM events GROUP BY 1")
def judge_coverage(spark, d):
    sums = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 10).alias("judged"), F.count_if(~(F.coalesce(F.col("value") >= 10, F.lit(False)))).alias("missing"))
    return sums.select("event_type", "judged", F.round(metrics.coverage(F.col("judged"), F.col("missing")), 6).alias("coverage"))


@query("SELECT doc_id, CASE WHEN ('0x' || substring(md5(doc_id || ':42'), 1, 8))::BIGINT / 4294967296 < 0.8 THEN 'train' ELSE 'val' END AS split FROM documents")
def hash_split(spark, d):
    return sampling.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8)


@query("SELECT doc_id, [3, 4, 6, 8, 5][doc_id % 5 + 1] AS importance FROM documents")
def importance_of(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["simple", "normal", "complex", "deep", "other"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.importance_of(label).alias("importance"))


@query(f"""WITH {CHAT_SQL}, s AS (SELECT DISTINCT session FROM chat) SELECT session AS query_id, CASE WHEN session % 2 = 0 THEN 'RELEVANT CONTEXT — things you already know about this person:' || chr(10) || '1. plan: short' || chr(10) || '2. ' || rtrim(repeat('word ', 80)) || '...' || chr(10) || chr(10) ELSE '' END
 || 'CURRENT GOALS:' || chr(10) || '- goal 0' || chr(10) || '- goal 1 (25% of 40 kg)' || chr(10) || '- goal 2 (50% of 40 kg)' || chr(10) || '- goal 3 (75% of 40 kg)' || chr(10) || '- goal 4 (100% of 40 kg)' || chr(10) || chr(10) || 'User: next' AS prompt FROM s""")
def full_prompt(spark, d):
    """Memories for every other query, one of them cut between words, and the first five of six goals."""
    s = chat(spark, d).select(F.col("session").alias("query_id")).distinct()
    known = spark.createDataFrame([(1, "plan", "short"), (2, " ", "word " * 100)], "rank int, title string, content string")
    aims = spark.createDataFrame([(i, f"goal {i}", 10.0 * i, 40.0 if i else 0.0, "kg") for i in range(6)], "pos long, goal_name string, current_value double, target_value double, unit string")
    none = spark.createDataFrame([], "query_id long, pos long, user_message string, reply string")
    return retrieval.prompts(s.withColumn("message", F.lit("next")), s.filter("query_id % 2 = 0").join(F.broadcast(known)), none, s.join(F.broadcast(aims)))
