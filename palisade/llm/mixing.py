"""Mixing sources to target weights by capped water-filling.

Every step is a partial aggregate or a window whose groups are bounded: sources
are one row each, and the documents of a source, however large it is, are dealt
over 16 ** ``BUCKET_HEX`` seeded hash ranges before any running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import WORD

#: Most repetitions of a source (and of a document) in the mix.
MAX_EPOCHS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Leading hex digits of the hash that deal the documents of one source (4096 ranges).
BUCKET_HEX = 3
SEED = 17


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of ``sources(source, source_size, weight)``: adds ``target``.

    The total of all sizes is shared by weight; a share above ``max_epochs``
    times its source's size stops there, and the excess is shared again by
    weight until none is above. That fixed point has a closed form: in rising
    order of cap over weight, a prefix of the sources is capped and the rest
    share what is left at one level, so two running sums replace the rounds.
    Sources of size 0 get 0. All weights must be positive.
    """
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = sources.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    s = (
        s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
        # levels rise while sources are capped and fall after: the first uncapped source has the highest
        .withColumn("final", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, source, text)``.

    Sources in code point order, null last, weigh ``weights`` in turn. Each
    document is taken whole as often as its source's target holds its size;
    the fraction that remains is filled with further whole documents in the
    order of a seeded hash, and the document at the edge gives only as many of
    its words as are missing. So a source's taken words equal its target,
    rounded, and no document exceeds ``max_epochs`` times its size.

    Returns ``doc_id, size, source_size, target, taken, source`` and the columns
    named in ``carry``. Null or
    wordless texts have size 0 and are taken 0 times; the null source is a
    source of its own; rows with equal or null doc_id are rows of their own,
    and hash ties are broken by size; extra columns are not looked at; an empty
    table gives no rows. Reruns agree.
    """
    rows = docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("b", F.substring("h", 1, BUCKET_HEX))
    cells = rows.drop(*carry).groupBy("source", "b").agg(F.sum("size").alias("cell"))
    sizes = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((nth - 1) % len(weights) + 1).cast("int")))
    goals = water_fill(ranked, max_epochs).withColumn("words", F.round("target").cast("long"))
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s")
    starts = cells.withColumn("start", F.sum("cell").over(W.partitionBy("source").orderBy("b")) - F.col("cell"))
    starts = starts.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("s"), F.col("b").alias("cell_b"), "start", "source_size", "target", "whole", "rest"
    )
    before = W.partitionBy("source", "b").orderBy("h", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = rows.withColumn("ahead", ahead).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("cell_b")))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start") - F.col("ahead")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "source", *carry)
