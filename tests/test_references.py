"""Queries over a few long passages that are in nearly every list: their texts are not copied to each query."""

import random

import duckdb
import pytest

from palisade import oracles, queries

N_QUERIES, N_LONG, WORDS = 150, 12, 20_000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of 150 turns that share words with 12 passages of 0.2 MB; the lists' texts are 90 MB and more."""
    at, rng = tmp_path_factory.mktemp("long"), random.Random(3)
    some = [f"w{n}x" for n in range(300)]
    docs = [(n, " ".join(f"{rng.getrandbits(32):08x}" for _ in range(WORDS)) + " " + " ".join(rng.sample(some, 200)), f"s{n}", "en") for n in range(N_LONG)]
    docs += [(100 + n, " ".join(rng.choices(some, k=4)), f"s{n}", "en") for n in range(50)] + [(900, docs[0][1], "copy", "en"), (901, None, "none", "en"), (902, "the of", "empty", "en")]
    chats = []
    for n in range(N_QUERIES):
        question = " ".join(rng.sample(some, 8)) if n % 10 else "the of"
        chats += [(n // 5, 2 * (n % 5), "user", question), (n // 5, 2 * (n % 5) + 1, "assistant", f"{' '.join(rng.sample(some, 6))}. unknown words; {docs[n % N_LONG][1][:17]}!")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    return str(at)


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("name", ["hallucination_verdict", "grounding_confidence", "lexical_rerank_topk", "rrf_fusion", "prompt_assembly", "pipeline_replay"])
def test_long_passages_are_moved_few_times(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    found = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in found.description]
    before = shuffled(spark)
    got = queries.QUERIES[name](spark, tables).select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall())) and len(got) >= 135
    # the whole corpus is under 3 MB; before, each list had its passages' texts with it
    assert shuffled(spark) - before < 25e6


def test_replay_has_texts_or_none(spark, tables):
    """All columns with texts, or the wanted ones, from the same lists."""
    turns, docs = queries.turns(spark, tables).where("recorded is not null"), queries.documents(spark, tables)
    whole = {r.query_id: r for r in queries.rag.replay(turns, docs, top_k=3).collect()}
    some = {r.query_id: r for r in queries.rag.replay(turns, docs, top_k=3, columns=("query_id", "answer", "n_sources", "hallucination")).collect()}
    assert set(whole) == set(some) and len(whole) == N_QUERIES
    for q, r in whole.items():
        assert (r.answer, len(r.sources), r.hallucination) == (some[q].answer, some[q].n_sources, some[q].hallucination)
        assert [s.rank for s in r.sources] == list(range(1, len(r.sources) + 1)) and all(s.content and s.content in r.messages[-1].content for s in r.sources)
