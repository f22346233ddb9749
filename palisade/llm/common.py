"""Shared plumbing: scratch tables, connected components and salted sequence numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import discard, staged

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker turns into objects at a time.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short pieces, so that what a worker holds as objects does not follow the batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Rows that travel to and from a Python worker at a time.
BATCH = 1024


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, after limiting its session's Arrow batches to ``BATCH`` rows if they were longer.

    Rows hold whole texts here: ten thousand of them, twice for each running
    task and again on the way back, are memory that no executor plans for.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, BATCH)
    return df


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open ranges."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def common_keys(rows: DataFrame, known: DataFrame, *keys: str, parts: int = 256) -> DataFrame:
    """``rows`` whose ``keys`` occur more than once, with the columns of ``known(*keys, ..., times)`` beside them.

    ``known`` has one row a key, read several times, so it should be a table.
    Keys with more than one in ``parts`` of all rows are at most ``parts``, and
    go to the rows as a broadcast; the rows of all other keys meet theirs in a
    shuffle in which no key is large. Keys must not be null.
    """
    more = [c for c in known.columns if c not in keys and c != "times"]
    total = known.agg(F.sum("times")).first()[0] or 0
    known = known.where("times > 1")
    beside = lambda df, mark: df.select(*(F.col(k).alias(f"{mark}{k}") for k in keys), *(F.col(c).alias(f"{mark}{c}") for c in more), F.lit(True).alias(mark))
    often = beside(known.where(F.col("times") > total / parts), "_hot_")
    seldom = beside(known.where(F.col("times") <= total / parts), "_cold_")
    meets = lambda mark: [F.col(k) == F.col(f"{mark}{k}") for k in keys]
    both = rows.join(F.broadcast(often), meets("_hot_"), "left")
    # rows that are served are dealt evenly and meet nothing
    salt = F.when(F.col("_hot_"), F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(1 << 20)) + 1).otherwise(F.lit(0)).cast("int")
    both = both.withColumn("_salt", salt).join(seldom.withColumn("_none", F.lit(0)), [*meets("_cold_"), F.col("_salt") == F.col("_none")], "left")
    found = [F.when(F.col("_hot_"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in more]
    return both.where("_hot_ or _cold_").select(*(F.col(c) for c in rows.columns), *found)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(src, dst)`` with the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014), which ends
    after O(log^2 n) rounds with one star for each component. A node with very
    many neighbours is never gathered: the minimum is a partial aggregate, and
    the join that follows is one whose hot side AQE can split. Self loops and
    repeated edges are allowed; edges with a null end are ignored.

    Returns ``(node, root)`` for nodes with at least one neighbour besides
    themselves; an isolated node is its own root and is not listed.
    """
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct()
    e = staged(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m"))
        large = (
            both.where("dst > src")
            .join(low, "src")
            .select(F.col("dst").alias("src"), F.least("m", "src").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = (
            down.join(low, "src")
            .select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        old, e = e, staged(small, "edges")
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
