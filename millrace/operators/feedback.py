"""Weak relevance labels in batch: each retrieval is judged by the message that follows in its session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOPIC, MEMORY = 0.08, 0.06


def judge(topic, memory):
    return (topic >= TOPIC) | (memory >= MEMORY)


def label_turns(turns: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Labels of turns (session, seq, message, memory_text): overlap of the next message with this one and with what
    was retrieved. Texts are cut to 400 and 1200 characters before; a session's last turn has no label."""
    words = {} if stop is None else {"stop": stop}
    nxt = F.lead("message").over(Window.partitionBy("session").orderBy("seq"))
    paired = turns.withColumn("next_message", nxt).filter(F.col("next_message").isNotNull())
    message, memory = F.substring("message", 1, 400), F.substring("memory_text", 1, 1200)
    out = paired.withColumn("topic_overlap", T.content_overlap(message, F.col("next_message"), **words)).withColumn("memory_overlap", T.content_overlap(memory, F.col("next_message"), **words))
    return out.select("session", "seq", message.alias("message"), F.substring("next_message", 1, 400).alias("next_message"), "topic_overlap", "memory_overlap", judge(F.col("topic_overlap"), F.col("memory_overlap")).alias("continued"))
