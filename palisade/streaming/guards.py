"""Guards and memory over streams.

The guards are columns and need no state, so a stream of prompts takes the same
plan as a table. Memory is keyed state: one bounded list a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.functions import guards
from palisade.operators.memory import TURNS
from palisade.settings import Settings


def guard_stream(prompts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``prompts(..., text)``, bounded or streaming, with the input guard's verdict as ``input``."""
    s = settings or Settings()
    return prompts.withColumn("input", guards.input_guard(F.col("text"), s.input_guard_enabled, s.emergency_detection_enabled))


def milliseconds(duration: str) -> int:
    """A duration such as "10 minutes"."""
    return max(1, round(pd.Timedelta(duration).total_seconds() * 1000))


def memory_stream(turns: DataFrame, window: int = 10, idle: str | None = None) -> DataFrame:
    """``(conv_id, turn, memory)``: what is remembered before each of a stream of ``turns(conv_id, turn, user, assistant, accepted)``.

    The state of a conversation is its last ``window`` accepted turns. With
    ``idle`` (a duration such as "1 hour" of processing time) a silent
    conversation is forgotten; by default none is. Turns are taken in the order
    of the micro-batches, and within one by number, then texts; where turns may come in
    any order see ``answers.ordered_memory_stream``.
    """
    patience = milliseconds(idle) if idle else None
    if window < 0:
        raise ValueError("window must not be negative")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [{"user": u, "assistant": a} for u, a in zip(*state.get)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["turn", "user", "assistant"], na_position="first")
        out = []
        for turn, user, assistant, accepted in zip(*(rows[c] for c in ("turn", "user", "assistant", "accepted"))):
            out.append((key[0], turn, list(kept)))
            if accepted and window:
                kept = [*kept, {"user": user, "assistant": assistant}][-window:]
        state.update(([t["user"] for t in kept], [t["assistant"] for t in kept]))
        if patience:
            state.setTimeoutDuration(patience)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "memory"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.groupBy("conv_id").applyInPandasWithState(
        update, f"conv_id long, turn long, memory {TURNS}", "users array<string>, assistants array<string>", "append", timeout
    )
