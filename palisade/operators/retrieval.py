"""Top-k retrieval of passages for queries.

Queries are ``(query_id, query)``; corpora ``(ordinal, content, source, ...)``;
ranked lists ``(query_id, rank, ordinal, score, ...)`` with ranks from 1, by
falling score, then ordinal.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators import inverted, pivots
from palisade.sources.scratch import staged

EMBEDDING_SIZE = 256
#: What a passage of a list is known by.
KEY = ("ordinal", "key")


class RetrieverError(Exception):
    """A retriever cannot be built or reached."""


class Found(NamedTuple):
    """Ranked lists without texts, and each passage that is in them once.

    ``lists(query_id, rank, part, row, ordinal, key, hits, n_terms, score)``; ``terms(part, row, terms)`` of
    all passages; ``passages(ordinal, key, content, source, ...)`` of those that are in a list.
    """

    lists: DataFrame
    terms: DataFrame
    passages: DataFrame


def _checked(top_k: int) -> int:
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    return top_k


def ranked(scored: DataFrame, top_k: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``top_k`` of each query by ``order``; Spark cuts each partition down before it shuffles."""
    _checked(top_k)
    by = W.partitionBy("query_id").orderBy(*(order or [F.col("score").desc(), F.col("ordinal").asc()]))
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, n_terms, token)`` of each different content token of a query."""
    terms = queries.select("query_id", text.token_set(F.col("query")).alias("terms"))
    return terms.select("query_id", F.size("terms").cast("long").alias("n_terms"), F.explode("terms").alias("token"))


def overlap_best(queries: DataFrame, corpus: DataFrame, top_k: int = 5) -> DataFrame:
    """``(query_id, rank, ordinal, key, hits, n_terms, score)``: the first ``top_k`` passages of each query by token overlap.

    ``key`` is a hash of the content, which tells apart rows that share an
    ordinal. The corpus is indexed for this call; see ``inverted.search``, and
    ``inverted.StoredIndex`` for an index that stays.

    Queries without content tokens, and passages without a hit, have no row.
    Rows with a null query_id, query, ordinal or content match nothing; a query_id
    should be there once.
    """
    _checked(top_k)
    return inverted.search(queries, inverted.build(corpus), top_k).drop("part", "row")


def overlap_found(queries: DataFrame, corpus: DataFrame, top_k: int = 5) -> Found:
    """The lists of ``overlap_topk`` by reference.

    A few long passages are in the lists of many queries: copied to each of them,
    texts of 0.17 GB become several GB. So texts stay apart until something needs them.
    """
    _checked(top_k)
    index = inverted.build(corpus)
    best = staged(inverted.search(queries, index, top_k), "winners")
    known = corpus.drop("query_id", "rank", "key", "hits", "n_terms", "score")
    known = known.withColumns({"key": F.xxhash64("content"), "ordinal": F.col("ordinal").cast("long")}).join(best.select(*KEY).distinct(), [*KEY], "left_semi")
    return Found(best, index.passages.select(*inverted.PASSAGE, "terms"), known.dropDuplicates([*KEY]))


def known_terms(texts: DataFrame, found: Found) -> DataFrame:
    """``(query_id, known)``: the content tokens of each of ``texts(query_id, text)`` that the passages of its list have.

    A query's passages and tokens meet the passages' tokens in an equi-join on both, so no
    passage's tokens are copied to the queries. Rows without such a token are left out.
    """
    own = texts.select("query_id", F.explode(text.token_set(F.col("text"))).alias("token"))
    wanted = found.lists.select("query_id", *inverted.PASSAGE).join(own.hint("merge"), "query_id")
    has = found.terms.join(found.lists.select(*inverted.PASSAGE).distinct(), [*inverted.PASSAGE], "left_semi").select(*inverted.PASSAGE, F.explode("terms").alias("token"))
    return wanted.join(has.hint("merge"), [*inverted.PASSAGE, "token"]).groupBy("query_id").agg(F.collect_set("token").alias("known"))


def overlap_topk(queries: DataFrame, corpus: DataFrame, top_k: int = 5) -> DataFrame:
    """Ranked lists by token overlap, with the passages' columns; see ``overlap_best``.

    Passages are fetched once the winners are known. Columns of the corpus that
    are named like those of a ranked list are left out. Rows that are alike in
    ordinal and content take a rank each.
    """
    found = overlap_found(queries, corpus, top_k)
    return found.lists.drop(*inverted.PASSAGE).join(found.passages, [*KEY]).drop("key")


def hashed_embedding(corpus: DataFrame, id: str, content: str, size: int = EMBEDDING_SIZE, tokens: Column | None = None) -> DataFrame:
    """``(id, embedding)``: token counts in ``size`` hashed buckets, of length 1; all zero without tokens.

    ``tokens`` is a column of integer token ids; by default crc32 of each
    content token, which needs no vocabulary file and is the same everywhere.
    """
    ids = F.transform(text.content_tokens(F.col(content)), lambda t: F.crc32(t.cast("binary"))) if tokens is None else tokens
    rows = corpus.select(F.col(id), F.transform(ids, lambda t: F.pmod(t, F.lit(size)).cast("int")).alias("_buckets"))

    def dense(b: Column) -> Column:
        spread = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))

        def unit(v: Column) -> Column:
            norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
            return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)

        return F.element_at(F.transform(F.array(spread), unit), 1)

    return rows.select(id, F.coalesce(dense(F.coalesce("_buckets", F.array().cast("array<int>"))), F.array_repeat(F.lit(0.0), size)).alias("embedding"))


def hashed_weights(corpus: DataFrame, id: str, content: str, size: int = EMBEDDING_SIZE, token_id: Callable[[Column], Column] | None = None) -> DataFrame:
    """The embedding's non-zero places as rows ``(id, bucket, weight)``, for joins on the bucket.

    One exchange, on the id: the counts of a passage are its own.
    """
    number = token_id or (lambda t: F.crc32(t.cast("binary")))
    rows = corpus.select(F.col(id), F.explode(text.content_tokens(F.col(content))).alias("t"))
    counts = rows.groupBy(id, F.pmod(number(F.col("t")), F.lit(size)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(id)))
    return counts.select(id, "bucket", (F.col("n") / norm).alias("weight"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 if either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_topk(queries: DataFrame, vectors: DataFrame, top_k: int = 5, digits: int = 6) -> DataFrame:
    """Exact cosine top-k of ``queries(query_id, vector)`` over ``vectors(ordinal, vector, ...)``, with the rows' columns.

    The rows are indexed for this call; see ``pivots``. Rows that share an ordinal
    each bring their columns.
    """
    _checked(top_k)
    found = pivots.search(queries, pivots.build(vectors, max(top_k, 1)), top_k, digits)
    return found.hint("merge").join(vectors.drop("vector", "score", "rank", "query_id"), "ordinal")
