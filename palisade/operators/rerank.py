"""Reordering of ranked candidates: lexical scores and reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators.retrieval import query_terms, ranked

RRF_K = 60
FETCH_K = 10


class RerankerError(Exception):
    """A reranker cannot be built."""


def lexical(queries: DataFrame, candidates: DataFrame, top_k: int = 3, passages: DataFrame | None = None) -> DataFrame:
    """Rerank ``candidates(query_id, rank, content, ...)`` by tf over length times ln(1 + 1 / df).

    df counts the query's candidates that have the term. Scores have six digits;
    candidates without a term are left out; ties keep their former rank.
    A passage is tokenised once, however many queries it is a candidate of, and
    what meets the queries' terms is its counts. Exchanges after that are keyed
    by query and by query and candidate: each group is one candidate list.
    ``passages(key, content)``, if given, has the candidates' texts, and candidates
    have the ``key`` instead; rows of one key have one content.
    """
    own = candidates.withColumnRenamed("rank", "old_rank").drop("score").withColumn("_passage", F.xxhash64("content") if passages is None else F.col("key"))
    texts = own if passages is None else passages.withColumnRenamed("key", "_passage")
    bags = texts.groupBy("_passage").agg(F.first("content").alias("content")).select("_passage", text.content_tokens(F.col("content")).alias("bag"))
    counts = bags.select("_passage", F.size("bag").alias("n"), F.explode("bag").alias("token")).groupBy("_passage", "token").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    wanted = own.select("query_id", "old_rank", "_passage").join(query_terms(queries).drop("n_terms"), "query_id")
    tf = wanted.hint("merge").join(counts, ["_passage", "token"])
    df = F.count("*").over(W.partitionBy("query_id", "token"))
    parts = tf.withColumn("part", F.col("tf") / F.col("n") * F.log1p(F.lit(1.0) / df))
    scores = parts.groupBy("query_id", "old_rank").agg(F.bround(F.sum("part"), 6).alias("score"))
    best = ranked(scores, top_k, [F.col("score").desc(), F.col("old_rank").asc()])
    return best.join(own.drop("_passage"), ["query_id", "old_rank"])


def reciprocal_rank_fusion(lists: Sequence[DataFrame], top_k: int = 3, k: int = RRF_K, fetch_k: int = FETCH_K, candidates: DataFrame | None = None) -> DataFrame:
    """Fuse ranked lists ``(query_id, rank, content, source)`` by the sum of 1 / (k + rank).

    Of each list the first ``fetch_k`` count; ``candidates``, if given, is a last
    list that counts whole. Equal contents are one passage, which the first list
    (then rank) that has it stands for; one that is twice in a list adds twice.
    Scores have six digits; ties go to what was seen first. Ranks are those of a
    ranked list: each once a query.
    """
    if not lists:
        raise RerankerError("at least one retriever is needed")
    parts = [d.where(F.col("rank") <= fetch_k) for d in lists] + ([candidates] if candidates is not None else [])
    rows = None
    for n, d in enumerate(parts):
        d = d.select("query_id", F.lit(n).alias("list_no"), F.col("rank").cast("int").alias("list_rank"), "content", "source")
        rows = d if rows is None else rows.unionByName(d)
    # texts are told apart by their digests; only winners' texts are moved
    seen, digest = F.struct("list_no", "list_rank"), F.unhex(F.md5("content")).alias("digest")
    score = F.bround(F.sum(F.lit(1.0) / (F.lit(k) + F.col("list_rank"))), 6).alias("score")
    fused = rows.select("query_id", digest, "list_no", "list_rank").groupBy("query_id", "digest").agg(score, F.min(seen).alias("seen"))
    best = ranked(fused, top_k, [F.col("score").desc(), F.col("seen").asc()]).select("query_id", "rank", "score", "seen.*")
    return best.join(rows, ["query_id", "list_no", "list_rank"]).select("query_id", "rank", "content", "source", "score")
