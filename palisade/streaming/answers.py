"""Streamed answers and memory over streams whose rows come in any order: keyed state, timers and watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.functions import fixed, replies
from palisade.operators.memory import TURNS
from palisade.settings import Settings
from palisade.streaming.guards import milliseconds

PIECES = "query_id long, piece_no long, piece string, ended boolean, kept boolean, draft string"


def piece_stream(pieces: DataFrame, settings: Settings | None = None, wait: str = "10 minutes") -> DataFrame:
    """The rows of a stream of answers in pieces, and a last row for each answer after its check.

    ``pieces(query_id, piece_no, piece, ended)`` has an answer's pieces, numbered
    from 0, and a row with ``ended`` whose number is that of pieces and whose piece is not read. Each
    piece passes in the micro-batch that brings it (``ended`` false, ``kept`` null), in order of its number within that
    batch; one that comes again is left out. The draft grows in keyed state. When the end
    and all pieces before it have come, in whatever order, or after ``wait`` without news, the draft is checked and the last row follows: the
    notice as its piece if the draft is blocked (else null), whether it is ``kept`` in memory, and
    the draft, put together by number. A blocked draft's pieces have been shown by then, as in ``rag.pieces``.

    Rows with a null query_id or piece_no are left out; a null piece is an empty
    one. Pieces that come after the last row begin a new answer of that id. The timer
    is the clock's, so Spark always plans a next micro-batch: the query runs until it is
    stopped, and the trigger that ends with the data at hand does not suit it.
    """
    enabled, patience = (settings or Settings()).output_guard_enabled, milliseconds(wait)

    def last(query_id: int, held: dict[int, str]) -> tuple[Any, ...]:
        draft = "".join(held[n] for n in sorted(held))
        blocked = enabled and replies.toxic(draft)
        return (query_id, max(held, default=-1) + 1, fixed.STREAM_NOTICE if blocked else None, True, not blocked, draft)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts, total = state.get if state.exists else ([], [], -1)
        held, out = dict(zip(numbers, texts)), []
        if state.hasTimedOut:
            out.append(last(key[0], held))
            state.remove()
        else:
            for rows in batches:
                for n, piece, ended in sorted(zip(rows["piece_no"], rows["piece"], rows["ended"]), key=lambda r: (r[0], bool(r[2]))):
                    if ended is True or ended == 1:
                        total = int(n)
                    elif int(n) not in held:
                        held[int(n)] = piece if isinstance(piece, str) else ""
                        out.append((key[0], int(n), held[int(n)], False, None, None))
            if 0 <= total <= len(held):
                out.append(last(key[0], held))
                if state.exists:
                    state.remove()
            else:
                state.update((list(held), list(held.values()), total))
                state.setTimeoutDuration(patience)
        yield pd.DataFrame(out, columns=["query_id", "piece_no", "piece", "ended", "kept", "draft"])

    rows = pieces.where("query_id is not null and piece_no is not null").select(
        F.col("query_id").cast("long"), F.col("piece_no").cast("long"), "piece", F.coalesce("ended", F.lit(False)).alias("ended")
    )
    return rows.groupBy("query_id").applyInPandasWithState(update, PIECES, "numbers array<long>, texts array<string>, total long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ordered_memory_stream(turns: DataFrame, window: int = 10, delay: str = "10 minutes", at: str = "at") -> DataFrame:
    """``(conv_id, turn, at, memory)`` before each turn of a stream that may bring them in any order, within ``delay``.

    ``turns(conv_id, turn, at, user, assistant, accepted)`` have an event time. A
    turn is held in its conversation's state until the watermark (the latest time
    seen, less ``delay``) has passed it; then no earlier one can come, and those held are
    remembered in order of time, number and texts, as ``memory.remembered`` does over a
    table. Turns behind the watermark when they come are too late: Spark leaves
    them out before this and counts them; see ``late``. State is the window and
    what the delay holds back. Rows with a null time or conv_id are left out.
    """
    if window < 0:
        raise ValueError("window must not be negative")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ("times", "turns", "users", "assistants", "accepted")
        kept_users, kept_assistants, *waiting = state.get if state.exists else ([], [], [], [], [], [], [])
        held = list(zip(*waiting))
        kept = [{"user": u, "assistant": a} for u, a in zip(kept_users, kept_assistants)]
        if not state.hasTimedOut:
            for rows in batches:
                held += [
                    (int(t), int(n), u if isinstance(u, str) else None, a if isinstance(a, str) else None, bool(ok))
                    for t, n, u, a, ok in zip(rows["micros"], rows["turn"], rows["user"], rows["assistant"], rows["accepted"])
                ]
        limit = state.getCurrentWatermarkMs() * 1000
        held.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        out = []
        while held and held[0][0] < limit:
            micros, turn, user, assistant, ok = held.pop(0)
            out.append((key[0], turn, micros, list(kept)))
            if ok and window:
                kept = [*kept, {"user": user, "assistant": assistant}][-window:]
        state.update(([t["user"] for t in kept], [t["assistant"] for t in kept], *([r[n] for r in held] for n in range(len(columns)))))
        if held:
            # the first moment at which the watermark is past the next one
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "micros", "memory"])

    rows = turns.where(F.col(at).isNotNull() & F.col("conv_id").isNotNull()).withWatermark(at, delay)
    rows = rows.select("conv_id", "turn", at, F.unix_micros(F.col(at)).alias("micros"), "user", "assistant", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    state = "kept_users array<string>, kept_assistants array<string>, times array<long>, turns array<long>, users array<string>, assistants array<string>, accepted array<boolean>"
    out = rows.groupBy("conv_id").applyInPandasWithState(update, f"conv_id long, turn long, micros long, memory {TURNS}", state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("conv_id", "turn", F.timestamp_micros("micros").alias(at), "memory")


def late(query: Any) -> int:
    """Turns that a running or finished query's watermark has left out, over the progress that the session remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
