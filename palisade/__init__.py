"""Text-safety, retrieval and corpus-preparation analytics over DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from palisade.functions.emergency import detect as detect_emergency  # noqa: E402
from palisade.functions.guards import confidence, hallucination, input_guard, output_guard  # noqa: E402
from palisade.functions.text import content_tokens, pii, pii_kinds, redact, sanitize  # noqa: E402
from palisade.operators.memory import messages, remembered, stored  # noqa: E402
from palisade.operators.rerank import RerankerError, lexical, reciprocal_rank_fusion  # noqa: E402
from palisade.operators.retrieval import RetrieverError, hashed_embedding, overlap_topk, vector_topk  # noqa: E402
from palisade.plans.rag import answer, converse, pieces, replay  # noqa: E402
from palisade.settings import Settings, get_settings  # noqa: E402
from palisade.sources.corpus import chunks, read_chunks  # noqa: E402
from palisade.sources.providers import ChainProvider, HttpProvider, Provider, ProviderError, ProviderResponse, completed  # noqa: E402
from palisade.sources.vector_store import search as vector_store_search  # noqa: E402

__version__ = "0.1.0"
__all__ = [
    "ChainProvider", "HttpProvider", "Provider", "ProviderError", "ProviderResponse", "RerankerError", "RetrieverError", "Settings", "answer", "chunks", "completed", "confidence",
    "content_tokens", "converse", "detect_emergency", "get_settings", "hallucination", "hashed_embedding", "input_guard", "lexical", "messages", "output_guard", "overlap_topk",
    "pieces", "pii", "pii_kinds", "read_chunks", "reciprocal_rank_fusion", "redact", "remembered", "replay", "sanitize", "stored", "vector_store_search", "vector_topk",
]
