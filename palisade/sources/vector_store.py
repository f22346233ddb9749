"""Ranked lists from an external vector store with a REST search, one connection a partition."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.retrieval import EMBEDDING_SIZE, RetrieverError, hashed_embedding
from palisade.settings import Settings, get_settings
from palisade.sources.calls import Calls, called
from palisade.sources.corpus import from_payload
from palisade.sources.providers import post


def search(
    queries: DataFrame, top_k: int = 5, settings: Settings | None = None, size: int = EMBEDDING_SIZE, transport: Callable[..., Iterator[dict[str, Any]]] = post, calls: Calls = Calls()
) -> DataFrame:
    """Ranked lists for ``queries(query_id, query)`` from the collection that the settings name.

    Queries are embedded as hashed term frequencies. A hit's payload becomes a
    passage as ``from_payload`` says. Without a configured address this raises at
    once. A task has a few searches under way at once and tries again after failures
    that pass (``calls``); one that fails for good raises in its task.
    """
    s = settings or get_settings()
    if not s.qdrant_url:
        raise RetrieverError("no vector store is configured; set QDRANT_URL in the environment or .env file")
    url = f"{s.qdrant_url}/collections/{s.qdrant_collection}/points/search"
    collection = s.qdrant_collection

    def one(vector: list[float]) -> dict[str, Any]:
        try:
            return next(iter(transport(url, {}, {"vector": vector, "limit": top_k, "with_payload": True})))
        except (OSError, ValueError, StopIteration) as e:
            raise RetrieverError(f"search in {collection} failed: {e}") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, reply in zip(b.column(0).to_pylist(), called(b.column(1).to_pylist(), one, calls)):
                for n, hit in enumerate(reply.get("result", []), 1):
                    text = {k: x if isinstance(x, str) else json.dumps(x) for k, x in (hit.get("payload") or {}).items()}
                    rows.append((q, n, str(hit.get("id", "")), float(hit.get("score", 0.0)), list(text.items())))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["query_id", "rank", "id", "score", "payload"])

    embedded = hashed_embedding(queries.select(F.col("query_id").cast("long").alias("query_id"), "query"), "query_id", "query", size)
    return from_payload(embedded.mapInArrow(run, "query_id long, rank int, id string, score double, payload map<string,string>"))
