"""Rolling conversation memory over a table of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURNS = "array<struct<user:string,assistant:string>>"
#: Turns of one number are told apart by their texts.
ORDER = ("turn", "user", "assistant")


def remembered(turns: DataFrame, window: int = 10, accepted: Column | None = None, cleared: Column | None = None) -> DataFrame:
    """Adds ``memory``: the last ``window`` accepted turns before each of ``turns(conv_id, turn, user, assistant)``.

    Turns that are not ``accepted`` (all are, by default) see the memory but do
    not enter it. Where ``cleared`` is true (nowhere, by default) the memory is
    emptied just before the turn. The frame is bounded: a turn looks back over
    ``window`` rows, so a long conversation is read once, in order, without
    being gathered. Turns of one number follow each other by their texts, a null
    conv_id is one conversation, and a null number comes first; the columns
    ``_ok``, ``_n``, ``_m`` and ``_part`` are not for callers.
    """
    if window < 0:
        raise ValueError("window must not be negative")
    if window == 0:
        return turns.withColumn("memory", F.array().cast(TURNS))
    ok = F.lit(True) if accepted is None else F.coalesce(accepted, F.lit(False))
    order = W.partitionBy("conv_id").orderBy(*ORDER)
    # what was stored before a clearing is another partition
    part = F.lit(0) if cleared is None else F.count_if(F.coalesce(cleared, F.lit(False))).over(order.rowsBetween(W.unboundedPreceding, 0))
    turns = turns.withColumn("_part", part)
    order = W.partitionBy("conv_id", "_part").orderBy(*ORDER)
    numbered = turns.withColumn("_ok", ok).withColumn("_n", F.sum(F.col("_ok").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    numbered = numbered.withColumn("_n", F.coalesce("_n", F.lit(0)))
    # accepted turns since: a range over the count of accepted turns holds exactly the last ones
    back = W.partitionBy("conv_id", "_part").orderBy("_n").rangeBetween(-window, -1)
    entry = F.when(F.col("_ok"), F.struct(F.col("_n").alias("n"), F.col("user"), F.col("assistant")))
    found = numbered.withColumn("_m", F.collect_list(entry).over(back))
    memory = F.transform(F.sort_array("_m"), lambda t: F.struct(t["user"].alias("user"), t["assistant"].alias("assistant")))
    return found.withColumn("memory", memory.cast(TURNS)).drop("_ok", "_n", "_m", "_part")


def stored(turns: DataFrame, window: int = 10) -> DataFrame:
    """``(conv_id, memory, length)`` after the last turn of each conversation; empty for a window of 0.

    The last turns are cut by a ranked window before they are put together, so
    no conversation is gathered whole.
    """
    if window < 0:
        raise ValueError("window must not be negative")
    last = W.partitionBy("conv_id").orderBy(*(F.col(c).desc() for c in ORDER))
    kept = turns.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= max(window, 1))
    entry = F.struct("turn", "user", "assistant")
    memory = F.transform(F.sort_array(F.collect_list(entry)), lambda t: F.struct(t["user"].alias("user"), t["assistant"].alias("assistant")))
    out = kept.groupBy("conv_id").agg(memory.alias("memory"))
    if window == 0:
        out = out.withColumn("memory", F.array().cast(TURNS))
    return out.withColumn("memory", F.col("memory").cast(TURNS)).withColumn("length", F.size("memory").cast("long"))


def messages(memory: Column) -> Column:
    """Turns as alternating user and assistant messages, oldest first."""
    pair = lambda t: F.array(
        F.struct(F.lit("user").alias("role"), t["user"].alias("content")), F.struct(F.lit("assistant").alias("role"), t["assistant"].alias("content"))
    )
    return F.flatten(F.transform(memory, pair))


def exchanges(chats: DataFrame) -> DataFrame:
    """``(conv_id, turn, user, assistant)``: each user row of ``(conv_id, turn, role, text)`` that an assistant row follows.

    Rows of one turn follow each other with the user's first, then by their texts.
    """
    order = W.partitionBy("conv_id").orderBy("turn", F.col("role").desc(), "text")
    rows = chats.withColumn("_role", F.lead("role").over(order)).withColumn("_text", F.lead("text").over(order))
    return rows.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), F.col("_text").alias("assistant"))
