"""Substring dedup by hashing lines or paragraphs, and passages within them.

Only digests, offsets and ranks are shuffled; texts move once to read the
passages that may repeat, and once when kept units are put together again. A
digest that fills a third of all units is reduced to its first occurrence by a
partial aggregate, which then goes to its occurrences as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import common_keys, merged, short_batches, sliced
from palisade.llm.passages import WORDS, repeated, spans
from palisade.sources.scratch import staged

#: What separates units, by kind; both are matched literally in the text.
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}

NAMES = ["doc_id", "kept_text", "n_units", "n_removed", "n_passages", "kept_spans", "removed_spans", "passage_spans"]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def normalised(unit: Column) -> Column:
    """Lower case, with each run of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x20\x09-\x0D]+", " "))


def units(docs: DataFrame, unit: str = "line") -> DataFrame:
    """``(doc_id, rank, n, digest)`` for each non-blank unit; ``n`` counts from 0 within the text.

    ``rank`` is a hash of the whole text: it tells apart rows that share a doc_id.
    """
    sep = SEPARATORS[unit]
    parts = docs.select("doc_id", F.xxhash64("text").alias("rank"), F.posexplode(F.split("text", sep, -1)).alias("n", "u"))
    parts = parts.withColumn("norm", normalised(F.col("u"))).where("norm <> ''")
    return parts.select("doc_id", "rank", "n", F.unhex(F.md5("norm")).alias("digest"))


def repeats(found: DataFrame) -> DataFrame:
    """The units of ``found`` that are not the earliest of their digest, ranked by doc_id (null last), rank, n."""
    found = staged(found, "units")
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("rank").alias("rank"), F.col("n").alias("n"))
    first = found.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("times"))
    return common_keys(found, staged(first, "first-units"), "digest").where(~order.eqNullSafe(F.col("first"))).drop("first")


def dedup(docs: DataFrame, unit: str = "line", passage: int | None = WORDS) -> DataFrame:
    """Texts of ``docs(doc_id, text)`` without the units that came earlier elsewhere.

    A unit is a line (or a paragraph), compared after ``normalised``; blank
    units are never removed. Of equal units the earliest stays: smallest
    doc_id (null last), then position. Removing a unit removes the separator
    after it, or before it if nothing stays behind it.

    A run of ``passage`` words (None: no such units), compared with A-Z as a-z, is a
    unit too, wherever it starts: from the first to the last word of one that
    started in an earlier document, or at least as many words earlier in the
    same, all is removed. Units are judged on the input, not on what is left;
    what stays is byte for byte what it was.

    Returns ``doc_id, kept_text, n_units, n_removed, n_passages, kept_spans,
    removed_spans, passage_spans``; a span is the place of its first character in the
    input, from 0, and its length. ``removed_spans`` are the removed lines without
    separators, ``passage_spans`` the maximal runs of words that repeat, and
    ``kept_spans`` make up the kept text.

    A null text gives null with 0 units; an empty text has one blank unit.
    Rows sharing doc_id and text count as one occurrence and lose the same
    units; a null doc_id is kept. Extra columns are not looked at; an empty
    table gives no rows.
    """
    rows = _marked(short_batches(docs).select("doc_id", "text"), unit, passage)
    sep, n = SEPARATORS[unit], passage or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [_cut(t, marks, sep, n) for t, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), SPANS, SPANS, SPANS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], NAMES)

    kind = dict(rows.dtypes)["doc_id"]
    listed = "array<struct<start:bigint,length:bigint>>"
    return rows.mapInArrow(run, f"doc_id {kind}, kept_text string, n_units long, n_removed long, n_passages long, kept_spans {listed}, removed_spans {listed}, passage_spans {listed}")


def cut(docs: DataFrame, unit: str = "line", passage: int | None = WORDS) -> DataFrame:
    """``docs`` with what ``dedup`` keeps as text, without texts of which nothing but blanks is left.

    A text that lost nothing stays, even if it is blank or null.
    """
    rows = _marked(short_batches(docs), unit, passage)
    sep, n, at = SEPARATORS[unit], passage or 0, docs.columns.index("text")
    schema = rows.drop("_removed").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            marks = b.column(b.num_columns - 1).to_pylist()
            old = b.column(at).to_pylist()
            new = [_cut(t, gone, sep, n)[0] if gone else t for t, gone in zip(old, marks)]
            keep = pa.array([not gone or bool(t and t.strip()) for t, gone in zip(new, marks)], pa.bool_())
            columns = [*b.columns[:-1]]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(keep)

    return rows.mapInArrow(run, schema)


def _marked(docs: DataFrame, unit: str, passage: int | None) -> DataFrame:
    """``docs`` with what to remove as the last column, ``_removed``: numbers of units, ranges of passage windows, and whether all of them go."""
    docs = docs.withColumn("_row", F.xxhash64("text"))
    rows = docs.select("doc_id", F.col("_row").alias("rank"), "text")
    none, window = F.lit(None), "struct<first:bigint,last:bigint>"
    lines = repeats(units(docs.select("doc_id", "text"), unit)).select("doc_id", "rank", F.col("n").cast("int").alias("n"), none.cast(window).alias("w"), F.lit(False).alias("whole"))
    if passage is not None:
        found, late = repeated(rows, passage)
        lines = lines.unionByName(found.select("doc_id", "rank", none.cast("int").alias("n"), F.struct("first", "last").alias("w"), F.lit(False).alias("whole")))
        lines = lines.unionByName(late.select("doc_id", "rank", none.cast("int").alias("n"), none.cast(window).alias("w"), F.lit(True).alias("whole")))
    gone = lines.groupBy("doc_id", "rank").agg(F.struct(F.collect_set("n").alias("n"), F.collect_set("w").alias("w"), F.max("whole").alias("whole")).alias("_removed"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "rank": "_rank"})
    # joined on the keys that the passages' texts are read by, so that Spark shuffles a table of ids and texts once
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_rank"))
    return docs.drop("_id", "_rank", "_removed").join(gone, same, "left").drop("_id", "_rank", "_row")


def _cut(text: str | None, marks: dict | None, sep: str, n: int) -> tuple:
    if text is None:
        return None, 0, 0, 0, [], [], []
    parts, drop = text.split(sep), set(marks["n"] if marks else ())
    last = max((k for k in range(len(parts)) if k not in drop), default=-1)
    at, removed, gone = 0, [], []
    for k, p in enumerate(parts):
        if k in drop:
            removed.append((at, at + len(p)))
            gone.append((at, at + len(p) + len(sep)) if k < last else (max(0, at - len(sep)), at + len(p)))
        at += len(p) + len(sep)
    again = spans(text, [(w["first"], w["last"]) for w in marks["w"]], marks["whole"], n) if marks and n else []
    edges = [0, *(x for g in merged(gone + again) for x in g), len(text)]
    kept = [(a, z) for a, z in zip(edges[::2], edges[1::2]) if a < z]
    listed = [[{"start": a, "length": z - a} for a, z in s] for s in (kept, removed, again)]
    return "".join(text[a:z] for a, z in kept), len(parts), len(drop), len(again), *listed
