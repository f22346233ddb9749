"""Streams over several micro-batches, held against the plans over tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.operators import memory
from palisade.plans import rag
from palisade.streaming.answers import late, ordered_memory_stream, piece_stream

DRAFTS = {1: ["all ", "good ", "here"], 2: ["You should ", "harm ", "yourself"], 3: ["one"], 4: [], 5: ["", "a@b.org ", "x"], 6: ["never ", "ended: you should harm yourself"]}


def ran(spark, tmp_path, stream, name):
    q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    q.awaitTermination()
    return q


def ran_until(spark, tmp_path, stream, name, done):
    """With timers by the clock there is always a next micro-batch, so the test says when to stop."""
    q = stream.writeStream.format("memory").queryName(name).trigger(processingTime="0 seconds").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    for _ in range(120):
        if q.awaitTermination(0.5) or done(spark.table(name)):
            break
    q.stop()


def source(spark, tmp_path, batches, schema):
    """A stream that takes one of the lists of rows a micro-batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


@pytest.fixture()
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", [0, 1])
def test_pieces_over_micro_batches(spark, tmp_path, few, seed):
    """In order, or shuffled so that the end may come before pieces: the same pieces, notices and verdicts as over a table."""
    rows = [(q, n, p, False) for q, pieces in DRAFTS.items() for n, p in enumerate(pieces)] + [(q, len(p), None, True) for q, p in DRAFTS.items() if q != 6]
    if seed:
        random.Random(seed).shuffle(rows)
        rows.append(rows[0])  # once more
    else:
        rows.sort(key=lambda r: (r[1], r[0]))
    stream = piece_stream(source(spark, tmp_path, [rows[n::4] for n in range(4)], "query_id long, piece_no int, piece string, ended boolean"))
    ran_until(spark, tmp_path, stream, f"pieces{seed}", lambda t: t.where("ended").count() == 5 and t.where("query_id = 6").count() == 2)
    got = spark.table(f"pieces{seed}").collect()
    drafts = spark.createDataFrame([(q, "".join(p), p) for q, p in DRAFTS.items() if q != 6], "query_id long, draft string, pieces array<string>")
    drafts = drafts.withColumn("safe_query", F.lit("q")).withColumn("sources", F.array().cast(rag.SOURCES))
    want = sorted((r.query_id, r.piece_no, r.piece, r.kept) for r in rag.pieces(drafts).collect())
    kept = {r.query_id: r.kept for r in got if r.ended}
    assert kept == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert {r.query_id: r.draft for r in got if r.ended} == {q: "".join(p) for q, p in DRAFTS.items() if q != 6}
    assert sorted((r.query_id, r.piece_no, r.piece, kept[r.query_id]) for r in got if r.query_id != 6 and r.piece is not None) == want
    # an answer that has not ended is shown so far
    assert sorted(r.piece for r in got if r.query_id == 6) == sorted(DRAFTS[6])


def test_a_silent_answer_is_checked_after_a_wait(spark, tmp_path, few):
    rows = [(6, n, p, False) for n, p in enumerate(DRAFTS[6])]
    stream = piece_stream(source(spark, tmp_path, [rows], "query_id long, piece_no int, piece string, ended boolean"), wait="1 second")
    ran_until(spark, tmp_path, stream, "silent", lambda t: t.where("ended").count() > 0)
    last = spark.table("silent").where("ended").collect()
    assert [(r.query_id, r.piece_no, r.piece, r.kept, r.draft) for r in last] == [(6, 2, fixed.STREAM_NOTICE, False, "".join(DRAFTS[6]))]


def test_memory_of_turns_out_of_order(spark, tmp_path, few):
    """Shuffled micro-batches give the window's result; what comes behind the watermark is left out and counted."""
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(7)
    rows = [(c, n, start + datetime.timedelta(minutes=n), f"q{c}-{n}", f"a{n}" if n % 6 else None, n % 4 != 1) for c in range(3) for n in range(20)]
    moved = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))  # none is more than eight minutes behind
    batches = [moved[n : n + 15] for n in range(0, 60, 15)]
    batches.append([(9, 0, start + datetime.timedelta(days=1), "end", "end", True)])
    batches.append([(0, 3, start + datetime.timedelta(minutes=3), "late", "late", True), (9, 1, start + datetime.timedelta(days=2), "end", "end", True)])
    schema = "conv_id long, turn long, at timestamp, user string, assistant string, accepted boolean"
    q = ran(spark, tmp_path, ordered_memory_stream(source(spark, tmp_path, batches, schema), 2, "10 minutes"), "unordered")
    got = {(r.conv_id, r.turn): (r.at, [tuple(t) for t in r.memory]) for r in spark.table("unordered").where("conv_id < 9").collect()}
    whole = memory.remembered(spark.createDataFrame(rows, schema), 2, F.col("accepted"))
    assert got == {(r.conv_id, r.turn): (r.at, [tuple(t) for t in r.memory]) for r in whole.collect()} and len(got) == 60
    assert late(q) == 1
