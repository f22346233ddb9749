"""Order MinHash fingerprints, in DataFrame functions only.

A text is a sequence of words. Its k-mers are numbered by occurrence, so the
second "a b c" differs from the first; each (k-mer, occurrence) pair is hashed.
The hash range is cut into ``SLOTS`` equal parts; in each part the ``TUPLE``
smallest pairs are picked, put back into text order and hashed together. A slot
therefore changes when the picked k-mers change or change places, which makes
the share of equal slots follow the edit distance, not only the set overlap.

All of it is one expression on a row: no exploding, no shuffle. K-mers are
handled as longs that hold 34 hash bits and a 30-bit position, so the sort is
one of plain longs, and runs of equal k-mers give the occurrence numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.sources.scratch import staged

#: Words of a k-mer.
K = 3
#: Slots of a fingerprint, a power of two.
SLOTS = 64
#: Pairs that are hashed together.
TUPLE = 2
#: Bits of a packed long that hold the position: a string of under 2 ** 31 bytes has fewer than 2 ** 30 words.
PLACE_BITS = 30
_PLACE = (1 << PLACE_BITS) - 1
#: Written for a slot that no k-mer falls in (null in arrays).
EMPTY = "--------"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pack(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~_PLACE).cast("long")).bitwiseOR(at.cast("long"))


def _top(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of the k-mers of a text, in order; fewer than k words are one k-mer, none are none."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def of(h: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, F.array(F.xxhash64(h))).otherwise(some)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def numbered(kms: Column) -> Column:
    """Packed (k-mer, occurrence) hashes with their positions, in hash order."""

    def runs(s: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (_top(F.get(s, i)) != _top(F.get(s, F.greatest(i - 1, F.lit(0))))),
        )

        def pairs(starts: Column) -> Column:
            return F.flatten(
                F.transform(
                    starts,
                    lambda a, n: F.transform(
                        F.sequence(a, F.coalesce(F.get(starts, n + 1), F.size(s)) - 1),
                        lambda i: _pack(F.xxhash64(_top(F.get(s, i)), i - a), F.get(s, i).bitwiseAND(F.lit(_PLACE).cast("long"))),
                    ),
                )
            )

        return _let(first, pairs)

    packed = F.sort_array(F.transform(kms, _pack))
    done = F.sort_array(_let(packed, runs))
    return F.when(F.size(kms) > 0, done).otherwise(F.array().cast("array<bigint>"))


def slots(text: Column, k: int = K, n: int = SLOTS, size: int = TUPLE) -> Column:
    """The ``n`` slots of a text, as ints; null where no k-mer falls."""
    shift = 64 - (n.bit_length() - 1)

    def part(packed: Column) -> Column:
        return F.shiftright(packed, shift) + n // 2

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < size) | (part(x) != part(F.get(s, F.greatest(i - size, F.lit(0))))))

    def signed(few: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(few) - 1), lambda i: (i == 0) | (part(F.get(few, i)) != part(F.get(few, F.greatest(i - 1, F.lit(0))))))

        def one(i: Column) -> Column:
            own = F.filter(F.slice(few, i + 1, F.lit(size)), lambda x: part(x) == part(F.get(few, i)))
            # text order: position in front, then the hash bits
            back = F.sort_array(F.transform(own, lambda x: F.struct(x.bitwiseAND(F.lit(_PLACE).cast("long")).alias("at"), _top(x).alias("h"))))
            return _let(back, lambda b: F.shiftright(F.shiftleft(F.xxhash64(b["h"]), 32), 32).cast("int"))

        def filled(found: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.try_element_at(found, j.cast("long")))

        found = _let(at, lambda a: F.map_from_arrays(F.transform(a, lambda i: part(F.get(few, i))), F.transform(a, one)))
        return F.when(F.size(few) == 0, F.array_repeat(F.lit(None).cast("int"), n)).otherwise(_let(found, filled))

    return _let(_let(numbered(kmers(text, k)), smallest), signed)


def printed(found: Column) -> Column:
    """Slots as one string, eight hex digits each."""
    return F.array_join(F.transform(found, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit(EMPTY))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that either text fills; 1 if neither fills any."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(x.eqNullSafe(y).cast("int")))
    used = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(
        F.aggregate(used, F.lit(0), lambda s, x: s + x).cast("double") / F.size(used)
    )


def next_ids(ids: DataFrame) -> DataFrame:
    """``(doc_id, next_id)`` in descending order, without a global sort in one task.

    Ids are dealt into ranges; the ranges are written down once, each finds its
    neighbours by a window of its own, and the ends are joined by a window over
    one row a range. After the smallest id comes the largest; a single id is
    its own next.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.select("doc_id").where("doc_id is not null").distinct().repartitionByRange(parts, "doc_id")
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()), "id-ranges")
    ends = dealt.groupBy("part").agg(F.max("doc_id").alias("top"))
    whole = W.partitionBy()
    below = F.lag("top").over(W.orderBy("part"))
    ends = ends.withColumn("below", F.coalesce(below, F.max("top").over(whole))).select(F.col("part").alias("p"), "below")
    inner = dealt.withColumn("next_id", F.lag("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    edge = inner.where("next_id is null").join(ends, F.col("part") == F.col("p")).select("doc_id", F.col("below").alias("next_id"))
    return inner.where("next_id is not null").select("doc_id", "next_id").union(edge)


def with_edits(docs: DataFrame) -> DataFrame:
    """``(doc_id, next_id, text, edited)``: half of each text replaced by the start of the next document's.

    Each text moves once under its own id, for both joins, and at most half of
    one under the previous id.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # both joins below read this one, filtered alike, so that Spark shuffles it once
    rows = every.where("doc_id is not null")
    ids = rows.groupBy("doc_id")
    ids = staged(ids.agg(F.floor(F.max(F.char_length("text")) / 2).cast("int").alias("most"), F.min(F.xxhash64("text")).alias("best"), F.count("*").alias("times")), "ids")
    chain = next_ids(ids).join(ids.select("doc_id", "most"), "doc_id").select(F.col("doc_id").alias("cur"), "next_id", "most")
    chain = chain.join(ids.select(F.col("doc_id").alias("next_id"), "best"), "next_id")
    heads = rows.join(chain, F.col("doc_id") == F.col("next_id"))
    shared = not ids.where("times > 1").isEmpty()
    if shared:
        heads = heads.where(F.xxhash64("text") == F.col("best"))
    heads = heads.select("cur", "next_id", F.substring(F.col("text"), F.lit(1), F.col("most")).alias("head"))
    if shared:
        heads = heads.dropDuplicates(["cur"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
        F.substring(F.coalesce("head", F.lit("")), F.lit(1), half),
    )
    joined = rows.join(heads, F.col("doc_id") == F.col("cur"), "left")
    without = every.where("doc_id is null").withColumns({"next_id": F.lit(None).cast(dict(every.dtypes)["doc_id"]), "head": F.lit(None).cast("string")})
    both = joined.select("doc_id", "next_id", "text", "head").unionByName(without)
    return both.select("doc_id", "next_id", "text", edited.alias("edited"))


def fingerprint_edits(docs: DataFrame, k: int = K, n: int = SLOTS, size: int = TUPLE) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text)``, of its edited text, and how alike they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    A null text is an empty one, whose slots are all empty; two empty texts are
    alike to 1, an empty and another to 0. Rows with one doc_id stay rows of
    their own; as the next document, the text of the smallest hash counts. A row
    with a null doc_id has no next document: it is edited with nothing and
    near_next is null. A single document is its own next. Extra columns are not
    looked at; an empty table gives no rows.
    """
    rows = with_edits(docs)
    rows = rows.select(
        "doc_id",
        "next_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.transform(F.array("text", "edited"), lambda t: slots(t, k, n, size)).alias("prints"),
        "text",
    )
    rows = rows.select("doc_id", "next_id", "n_chars", "edited_sha256", F.get("prints", F.lit(0)).alias("own"), F.get("prints", F.lit(1)).alias("other"), F.xxhash64("text").alias("order"))
    rows = staged(rows, "order-minhash")
    heads = rows.where("doc_id is not null").select(F.col("doc_id").alias("i"), F.col("own").alias("next_own"), "order")
    if not heads.groupBy("i").count().where("count > 1").isEmpty():
        heads = heads.groupBy("i").agg(F.min_by("next_own", "order").alias("next_own"))
    return rows.join(heads, F.col("next_id") == F.col("i"), "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        F.when(F.col("next_own").isNotNull(), likeness(F.col("own"), F.col("next_own"))).alias("near_next"),
    )
