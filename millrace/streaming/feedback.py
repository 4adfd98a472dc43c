"""The same labels as a stream: one pending retrieval a session, resolved by the session's next message.

State is keyed by session, so it scales with the state store; a timeout drops sessions that never come back, where a
single process would bound the number of pending entries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C
from ..operators.feedback import MEMORY, TOPIC

OUT = "session string, seq long, message string, next_message string, topic_overlap double, memory_overlap double, continued boolean"
STATE = "seq long, message string, memory_text string"


def overlap(a: str | None, b: str | None, stop: frozenset[str]) -> float:
    x, y = (set(re.findall(r"[a-z0-9']{3,}", (t or "").lower())) - stop for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def label_stream(turns: DataFrame, timeout_ms: int | None = 3_600_000, stop: frozenset[str] = frozenset(C.OVERLAP_STOPWORDS)) -> DataFrame:
    """Labels of a stream of turns (session, seq, message, memory_text); a newer retrieval replaces a pending one.
    timeout_ms: after which a session without a next turn is dropped; None never drops one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, pending = [], state.get if state.exists else None
        # a trigger may give a session in several frames
        for turn in pd.concat(list(frames)).sort_values("seq").itertuples():
            if pending is not None and turn.message is not None:
                seq, message, memory = pending
                topic, kept = overlap(message, turn.message, stop), overlap(memory, turn.message, stop)
                rows.append((key[0], seq, message, turn.message[:400], topic, kept, topic >= TOPIC or kept >= MEMORY))
            if turn.message is not None:
                pending = (int(turn.seq), turn.message[:400], (turn.memory_text or "")[:1200])
        if pending is not None:
            state.update(pending)
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["session", "seq", "message", "next_message", "topic_overlap", "memory_overlap", "continued"])

    return turns.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
