"""Corpora of passages: any Spark source as ``(ordinal, content, source, score, metadata)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chunks(df: DataFrame, content: str | Column, ordinal: str | Column, source: str | Column = "source", metadata: Column | None = None) -> DataFrame:
    """Passages of a table. ``ordinal`` is the order in which equal scores are given."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    meta = F.create_map().cast("map<string,string>") if metadata is None else metadata
    return df.select(
        col(ordinal).cast("long").alias("ordinal"), col(content).alias("content"), col(source).alias("source"), F.lit(0.0).alias("score"), meta.alias("metadata")
    )


def read_chunks(spark: SparkSession, path: str, content: str, ordinal: str, source: str = "source", format: str = "parquet", **options) -> DataFrame:
    """Passages from files of any format that Spark reads; only the named columns are scanned."""
    return chunks(spark.read.format(format).options(**options).load(path), content, ordinal, source)


def from_payload(df: DataFrame, payload: str = "payload", id: str = "id", score: str = "score") -> DataFrame:
    """Passages from hits of a vector store: ``payload`` is a map of strings.

    Content is the payload's ``content`` or else ``text``; source its ``source``
    or else the hit's id; an empty string counts as absent. Entries that
    were not used are the metadata.
    """
    p = F.col(payload)
    given = lambda k: F.nullif(F.try_element_at(p, F.lit(k)), F.lit(""))
    # the text entry is used up only where there is no content
    rest = F.map_filter(p, lambda k, v: ~k.isin("content", "source") & ~((k == "text") & given("content").isNull()))
    return df.withColumns(
        {
            "content": F.coalesce(given("content"), given("text"), F.lit("")),
            "source": F.coalesce(given("source"), F.col(id).cast("string")),
            "score": F.col(score).cast("double"),
            "metadata": F.coalesce(rest, F.create_map().cast("map<string,string>")),
        }
    ).drop(payload)
