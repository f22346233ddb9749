"""Retrieval, reranking, embeddings and payloads on hand-worked corpora."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators import counting, inverted, pivots, rerank, retrieval
from palisade.plans import rag
from palisade.settings import Settings
from palisade.sources import corpus, vector_store
from palisade.sources.scratch import staged

CORPUS = [(0, "alpha beta"), (1, "alpha gamma"), (2, "alpha beta beta delta")]


@pytest.fixture()
def chunks(spark):
    return corpus.chunks(spark.createDataFrame([(i, c, f"s{i}") for i, c in CORPUS], "ordinal long, content string, source string"), "content", "ordinal")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def listed(df):
    return [(r.ordinal, r.score) for r in df.orderBy("query_id", "rank").collect()]


def test_overlap(spark, chunks):
    assert listed(retrieval.overlap_topk(asked(spark, "alpha beta"), chunks, 5)) == [(0, 1.0), (2, 1.0), (1, 0.5)]
    assert listed(retrieval.overlap_topk(asked(spark, "alpha beta"), chunks, 2)) == [(0, 1.0), (2, 1.0)]
    assert listed(retrieval.overlap_topk(asked(spark, "the of", ""), chunks)) == []
    assert listed(retrieval.overlap_topk(asked(spark, "alpha"), chunks, 0)) == []
    with pytest.raises(ValueError):
        retrieval.overlap_topk(asked(spark, "alpha"), chunks, -1)


@pytest.mark.parametrize(("champions", "seeds", "extra", "telling"), [(64, 8, 2, 5000), (2, 1, 0, 5000), (3, 2, 1, 0)])
def test_overlap_against_brute_force(spark, monkeypatch, champions, seeds, extra, telling):
    """With short and long lists of first candidates; with repeated rows, clashing columns, nulls and texts of no token."""
    for name, value in {"CHAMPIONS": champions, "SEEDS": seeds, "EXTRA": extra, "TELLING": telling, "SEED_TERMS": seeds}.items():
        monkeypatch.setattr(inverted, name, value)
    rng = random.Random(champions)
    words = [f"w{n}x" for n in range(12)] + ["the", "ab"]
    some = lambda: " ".join(rng.choices(words, k=rng.randint(0, 9)))
    rows = [(n, some(), "s", 9, 0.5, "x") for n in range(40)] + [(None, "w1x", "s", 9, 0.5, "x"), (41, None, "s", 9, 0.5, "x")]
    rows += [rows[3], rows[3], (3, rows[4][1], "s", 9, 0.5, "x")]
    corpus = spark.createDataFrame(rows, "ordinal long, content string, source string, rank int, score double, query_id string").repartition(3)
    questions = [f"{some()} {some()}" for _ in range(10)] + ["", None, "w1x unknown", "unknown"]
    tokens = lambda t: {w for w in (t or "").split() if w.startswith(("w", "u"))}
    want = []
    for n, q in enumerate(questions):
        own = tokens(q)
        found = sorted((-round(len(own & tokens(c)) / len(own), 4), o, c) for o, c, *_ in rows if o is not None and c is not None and own & tokens(c)) if own else []
        # of rows alike in ordinal, the hash of the content decides
        want += [(n, r, -s, o) for r, (s, o, _) in enumerate(found[:4], 1)]
    out = retrieval.overlap_topk(asked(spark, *questions), corpus, 4)
    got = [(r.query_id, r["rank"], r.score, r.ordinal) for r in out.collect()]
    assert sorted(got) == want and len(want) > 25
    assert sorted(out.columns) == sorted(["query_id", "rank", "ordinal", "hits", "n_terms", "score", "content", "source"])
    assert retrieval.overlap_topk(asked(spark, "w1x"), corpus.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 2])
def test_hits_that_round_to_one_score_are_ties(spark, partitions):
    """Of 25,000 terms, 10,000 and 10,001 hits both score 0.4: the ordinal decides, however rows are dealt."""
    terms = [f"t{n:05d}" for n in range(25000)]
    rows = [(1, " ".join(terms[:10000]), "a"), (2, " ".join(terms[:10001]), "b"), (3, " ".join(terms[:9000]), "c")]
    corpus = spark.createDataFrame(rows, "ordinal long, content string, source string").repartition(partitions)
    best = retrieval.overlap_best(asked(spark, " ".join(terms)), corpus, 1).collect()
    assert [(r.ordinal, r.hits, r.score) for r in best] == [(1, 10000, 0.4)]


@pytest.mark.parametrize(("size", "k"), [(1, 2), (63, 1), (64, 3), (65, 5), (300, 7), (300, 300)])
def test_hits_counted_in_bits(size, k):
    """A block's first passages of each query against plain counts; rare and common tokens, unknown ones, queries of none."""
    rng = np.random.default_rng(size)
    share = 1 / np.arange(1, 401)
    draw = lambda n: np.unique(rng.choice(400, n, p=share / share.sum()))
    passages, queries = [draw(20) for _ in range(size)], [draw(rng.integers(0, 60)) for _ in range(90)]
    block = counting.Block(np.concatenate(passages), np.repeat(np.arange(size), [len(p) for p in passages]), size, 400)
    found = {}
    for part in block.best(np.concatenate([np.r_[q, -1] for q in queries]), np.array([len(q) + 1 for q in queries]), k):
        for q, place, hits in zip(*part):
            found.setdefault(q, []).append((-hits, place))
    for n, q in enumerate(queries):
        want = sorted((-h, i) for i, p in enumerate(passages) if (h := len(np.intersect1d(p, q))))
        assert sorted(found.get(n, []))[:k] == want[:k]


def test_overlap_over_many_blocks(spark, monkeypatch):
    """Blocks of a few passages and several slices of queries give what one block gives, and no block passes on more than a few rows a query."""
    rng = random.Random(2)
    words = [f"w{n}x" for n in range(30)]
    rows = [(n, " ".join(rng.choices(words, k=12)), "s") for n in range(200)]
    docs, questions = spark.createDataFrame(rows, "ordinal long, content string, source string"), asked(spark, *(" ".join(rng.choices(words, k=6)) for _ in range(20)))
    want = sorted(map(tuple, retrieval.overlap_best(questions, docs, 3).collect()))
    for name, value in {"BLOCK": 40, "TASK_TOKENS": 50}.items():
        monkeypatch.setattr(inverted, name, value)
    assert sorted(map(tuple, retrieval.overlap_best(questions, docs, 3).collect())) == want and len(want) == 60
    terms = questions.select("query_id", text.token_set(F.col("query")).alias("terms"))
    assert inverted.candidates(terms, inverted.build(docs), 3).count() == 20 * 5 * 3


@pytest.mark.parametrize(("size", "share", "dense"), [(64, 1, 2), (300, 0.1, 4), (300, 1, 128), (300, 1, 1)])
def test_hits_from_a_floor(monkeypatch, size, share, dense):
    """Passages that have a query's floor of hits or more: all are found, with their hits, by lists or by counting."""
    monkeypatch.setattr(counting, "SHARE", share)
    monkeypatch.setattr(counting, "DENSE", dense)
    monkeypatch.setattr(counting, "LISTED", 500)
    rng = np.random.default_rng(size)
    often = 1 / np.arange(1, 401)
    draw = lambda n: np.unique(rng.choice(400, n, p=often / often.sum()))
    passages, queries = [draw(40) for _ in range(size)], [draw(rng.integers(0, 60)) for _ in range(90)]
    block = counting.Block(np.concatenate(passages), np.repeat(np.arange(size), [len(p) for p in passages]), size, 400)
    floor = rng.integers(0, 14, 90)
    found = {}
    for part in block.at_least(np.concatenate([np.r_[q, -1] for q in queries]), np.array([len(q) + 1 for q in queries]), floor, size):
        for q, place, hits in zip(*part):
            found.setdefault(q, []).append((-hits, place))
    for n, q in enumerate(queries):
        want = sorted((-h, i) for i, p in enumerate(passages) if (h := len(np.intersect1d(p, q))) >= max(floor[n], 1))
        assert sorted(x for x in found.get(n, []) if -x[0] >= floor[n]) == want


def test_a_block_holds_places_only():
    """A million tokens of rare words: kept are four bytes each and the words' counts, and little more than two copies while it is built."""
    rng = np.random.default_rng(1)
    token, place = rng.integers(0, 20000, 1 << 20).astype(np.int32), rng.integers(0, 1 << 16, 1 << 20).astype(np.int32)
    tracemalloc.start()
    block = counting.Block(token, place, 1 << 16, 20000)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(block.dense) <= 1 and kept < 6 * (1 << 20) and most < 20 * (1 << 20)


def test_overlap_with_floors(spark, monkeypatch):
    """Floors from the longest passages change no list, equal scores and lengths included, and fewer rows leave the blocks."""
    rng = random.Random(7)
    words = [f"w{n}x" for n in range(60)]
    rows = [(n, " ".join(rng.choices(words, k=rng.choice([8, 8, 40]))), "s") for n in range(300)] + [(n, "w1x w2x w3x", "s") for n in range(300, 340)]
    docs = spark.createDataFrame(rows, "ordinal long, content string, source string")
    questions = asked(spark, *(" ".join(rng.choices(words, k=12)) for _ in range(25)), "w1x w2x w3x", "unknown", "w5x")
    want = sorted(map(tuple, retrieval.overlap_best(questions, docs, 3).collect()))
    terms, index = questions.select("query_id", text.token_set(F.col("query")).alias("terms")), inverted.build(docs)
    monkeypatch.setattr(inverted, "BLOCK", 40)
    before = inverted.candidates(terms, index, 3).count()
    for longest in (2, 30, 1000):
        monkeypatch.setattr(inverted, "LONGEST", longest)
        monkeypatch.setattr(inverted, "FLOORS_FROM", 0)
        assert sorted(map(tuple, retrieval.overlap_best(questions, docs, 3).collect())) == want
        if longest == 30:
            assert inverted._longest(index.passages).count() <= 40
            assert inverted.candidates(terms, index, 3).count() < before / 2
    assert len(want) == 27 * 3


def test_few_pairs_are_checked(spark):
    """At sf0.1 the filter leaves under a twentieth of all pairs of query and passage."""
    sf = "/root/testdata/sf0.1"
    docs = corpus.chunks(spark.read.parquet(f"{sf}/documents.parquet"), "text", "doc_id")
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    terms = staged(turns.select(F.xxhash64("conv_id", "turn").alias("query_id"), text.token_set(F.col("text")).alias("terms")).where(F.size("terms") > 0), "queries")
    pairs = inverted.candidates(terms, inverted.build(docs), 5).count()
    assert 0 < pairs < terms.count() * docs.count() / 20


def test_stored_index(spark, tmp_path):
    """Appended parts, merged parts and a fresh build give the same lists; texts are tokenised once; old readers go on."""
    rng = random.Random(9)
    words = [f"w{n}x" for n in range(40)]
    rows = [(n, " ".join(rng.choices(words, k=rng.randint(1, 15))), f"s{n}", n * 2) for n in range(120)]
    corpus = spark.createDataFrame(rows, "ordinal long, content string, source string, page int")
    questions = asked(spark, *(" ".join(rng.choices(words, k=6)) for _ in range(15)))
    columns = ["query_id", "rank", "ordinal", "content", "source", "hits", "n_terms", "score"]
    want = sorted(map(tuple, retrieval.overlap_topk(questions, corpus, 5).select(columns).collect()))
    index = inverted.StoredIndex(spark, str(tmp_path / "index"), buckets=3).create()
    with pytest.raises(ValueError):
        index.open()
    for n in range(3):
        index.append(corpus.where(F.col("ordinal") % 3 == n), "page")
    before = index.open()
    assert len(before.postings) == 3
    assert sorted(map(tuple, index.topk(questions, 5).select(columns).collect())) == want
    plan = index.spark.table(inverted.StoredIndex._table(index.parts()[0]["folder"])).join(spark.createDataFrame([("w1x",)], "token string").hint("merge"), "token")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the lists stay where they are
    index.merge()
    merged = index.open()
    assert len(merged.postings) == 1 and merged.passages.count() == 120
    assert sorted(map(tuple, index.topk(questions, 5).select(columns).collect())) == want
    assert {(r.ordinal, r.page) for r in index.topk(questions, 5).collect()} <= {(o, p) for o, _, _, p in rows}
    assert sorted((r.query_id, r["rank"], r.ordinal) for r in inverted.search(questions, before, 5).collect()) == [(q, r, o) for q, r, o, *_ in want]
    # another session has no table of it yet
    for p in index.parts():
        spark.sql(f"DROP TABLE {inverted.StoredIndex._table(p['folder'])}")
    again = inverted.StoredIndex(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, again.topk(questions, 5).select(columns).collect())) == want
    by_index = rag.answer(questions.withColumnRenamed("query", "text"), corpus, top_k=2, retriever=again.retriever())
    by_corpus = rag.answer(questions.withColumnRenamed("query", "text"), corpus, top_k=2)
    assert sorted((r.query_id, r.answer) for r in by_index.collect()) == sorted((r.query_id, r.answer) for r in by_corpus.collect())


def test_overlap_plan_has_no_cross_join(spark, chunks):
    plan = retrieval.overlap_best(asked(spark, "alpha beta"), chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_lexical(spark, chunks):
    q = asked(spark, "beta")
    best = rerank.lexical(q, chunks.select(F.lit(0).cast("long").alias("query_id"), (F.col("ordinal") + 1).alias("rank"), "ordinal", "content", "score"), 3)
    assert listed(best) == [(0, 0.202733), (2, 0.202733)]
    assert round(0.5 * math.log(1.5), 6) == 0.202733


def test_rrf(spark):
    make = lambda rows: spark.createDataFrame([(0, n, c, s) for n, (c, s) in enumerate(rows, 1)], "query_id long, rank int, content string, source string")
    out = rerank.reciprocal_rank_fusion([make([("A", "x"), ("B", "y")]), make([("B", "z"), ("C", "w")])], 3).orderBy("rank").collect()
    assert [(r.content, r.source, r.score) for r in out] == [("B", "y", 0.032522), ("A", "x", 0.016393), ("C", "w", 0.016129)]
    twice = rerank.reciprocal_rank_fusion([make([("A", "x"), ("A", "x2")])], 3, candidates=make([("D", "d")])).orderBy("rank").collect()
    assert [(r.content, r.source, r.score) for r in twice] == [("A", "x", 0.032522), ("D", "d", 0.016393)]
    with pytest.raises(rerank.RerankerError):
        rerank.reciprocal_rank_fusion([])


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, [1, 257, 2]), (2, []), (3, None)], "id long, tokens array<long>").withColumn("c", F.lit(""))
    rows = {r.id: r.embedding for r in retrieval.hashed_embedding(df, "id", "c", 256, F.col("tokens")).collect()}
    assert rows[1][1] == pytest.approx(2 / math.sqrt(5)) and rows[1][2] == pytest.approx(1 / math.sqrt(5)) and len(rows[1]) == 256
    assert rows[2] == rows[3] == [0.0] * 256
    text = spark.createDataFrame([(1, "alpha beta alpha")], "id long, c string")
    dense = retrieval.hashed_embedding(text, "id", "c").first().embedding
    sparse = {r.bucket: r.weight for r in retrieval.hashed_weights(text, "id", "c").collect()}
    assert {i: v for i, v in enumerate(dense) if v} == pytest.approx(sparse)


def test_vector_topk(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "ordinal long, vector array<double>")
    q = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, vector array<double>")
    assert listed(retrieval.vector_topk(q, v, 3)) == [(0, 1.0), (5, 1.0), (2, 0.707107)]
    assert listed(retrieval.vector_topk(q.limit(0), v, 3)) == []


@pytest.mark.parametrize(("page", "part", "asked_", "each"), [(512, 64, 1024, 32), (7, 2, 5, 4)])
def test_vector_topk_against_brute_force(spark, monkeypatch, page, part, asked_, each):
    """Clusters, copies, ties, zeros, nulls; one page a cell, or many pages, parts and blocks."""
    for name, value in {"PAGE": page, "PART": part, "ASKED": asked_, "EACH": each}.items():
        monkeypatch.setattr(pivots, name, value)
    rng = np.random.default_rng(page)
    centers = rng.normal(size=(5, 6))
    rows = [(n, [float(x) for x in centers[rng.integers(5)] + rng.normal(size=6) * rng.choice([0.0, 0.05, 1.0])]) for n in range(300)]
    rows += [(300 + n, rows[1][1]) for n in range(40)] + [(400 + n, [0.0] * 6) for n in range(7)] + [(500, None), (None, rows[1][1]), (501, [1e200] + [0.0] * 5), (502, [1.0])]
    v = spark.createDataFrame(rows, "ordinal long, vector array<double>").repartition(3)
    q = [(n, [float(x) for x in rng.normal(size=6)]) for n in range(30)] + [(100 + n, rows[n][1]) for n in range(10)] + [(200, [0.0] * 6), (201, None), (None, rows[0][1])]
    want = []
    for i, x in q:
        if i is None or x is None:
            continue
        x, scored = np.array(x), []
        for o, y in rows:
            if o is not None and y is not None:
                y = np.pad(np.array(y), (0, 6 - len(y)))
                y = y / (np.abs(y).max() or 1)
                norm = np.linalg.norm(x) * np.linalg.norm(y)
                scored.append((-round(float(x @ y / norm), 6) + 0.0 if norm else 0.0, o))
        want += [(i, r, o) for r, (_, o) in enumerate(sorted(scored)[:5], 1)]
    found = retrieval.vector_topk(spark.createDataFrame(q, "query_id long, vector array<double>"), v, 5).collect()
    assert sorted((r.query_id, r["rank"], r.ordinal) for r in found) == sorted(want)
    assert retrieval.vector_topk(spark.createDataFrame(q, "query_id long, vector array<double>"), v.limit(0), 5).count() == 0
    only_zeros = retrieval.vector_topk(spark.createDataFrame(q[:1], "query_id long, vector array<double>"), v.where("ordinal between 400 and 406"), 2)
    assert [(r.ordinal, r.score) for r in only_zeros.orderBy("rank").collect()] == [(400, 0.0), (401, 0.0)]


def test_no_vectors_are_broadcast(spark, monkeypatch):
    """Queries, pages and results meet in joins that send no side through the driver, however small they are."""
    plans, staged_ = [], pivots.staged
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(pivots, "staged", lambda df, label: (planned(df), staged_(df, label))[1])
    rng = random.Random(3)
    rows = spark.createDataFrame([(n, [rng.gauss(0, 1) for _ in range(4)]) for n in range(200)], "ordinal long, vector array<double>")
    out = retrieval.vector_topk(rows.where("ordinal < 9").withColumnRenamed("ordinal", "query_id"), rows, 3)
    planned(out)
    assert out.count() == 27 and sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]


def test_few_vectors_are_visited(spark):
    """Of clustered rows, queries compare themselves with few."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    rows = [(n, [float(x) for x in centers[n % 20] + rng.normal(size=16) * 0.05]) for n in range(4000)]
    v = spark.createDataFrame(rows, "ordinal long, vector array<double>")
    q = v.where("ordinal < 200").withColumnRenamed("ordinal", "query_id")
    visited = spark.sparkContext.accumulator(0)
    assert pivots.search(q, pivots.build(v, 5), 5, visited=visited).count() == 1000
    assert visited.value < 0.15 * 200 * 4000


def test_payload(spark):
    rows = [("1", 0.5, {"content": "c", "text": "t", "source": "s", "k": "v"}), ("2", 0.4, {"text": "t", "content": ""}), ("3", 0.1, None)]
    df = spark.createDataFrame(rows, "id string, score double, payload map<string,string>")
    got = {r.id: (r.content, r.source, r.metadata) for r in corpus.from_payload(df).collect()}
    assert got == {"1": ("c", "s", {"text": "t", "k": "v"}), "2": ("t", "2", {}), "3": ("", "3", {})}


def test_vector_store(spark):
    with pytest.raises(retrieval.RetrieverError):
        vector_store.search(asked(spark, "x"), settings=Settings())
    reply = {"result": [{"id": 9, "score": 0.5, "payload": {"text": "t", "n": 1}}]}
    out = vector_store.search(asked(spark, "alpha"), settings=Settings(qdrant_url="http://store"), transport=lambda u, h, b: iter([reply])).collect()
    assert [(r.query_id, r.rank, r.content, r.source, r.score, r.metadata) for r in out] == [(0, 1, "t", "9", 0.5, {"n": "1"})]


def test_index_without_posting_lists(spark, tmp_path):
    """No posting lists are stored for an index that is only searched, and merged parts can go; lists stay the same."""
    rows = [(n, f"w{n % 7}x w{n % 5}x", f"s{n}") for n in range(60)]
    docs = spark.createDataFrame(rows, "ordinal long, content string, source string")
    questions = asked(spark, "w1x w2x", "w3x")
    index = inverted.StoredIndex(spark, str(tmp_path / "index"), buckets=0).create()
    index.append(docs.where("ordinal < 20")).append(docs.where("ordinal between 20 and 39")).merge().vacuum().append(docs.where("ordinal > 39"))
    assert len(list((tmp_path / "index").glob("part-*"))) == 2 and not list((tmp_path / "index").glob("*/postings"))
    again = inverted.StoredIndex(spark, str(tmp_path / "index"))
    assert again.open().postings == [] and again.open().passages.count() == 60
    assert listed(again.topk(questions, 5)) == listed(retrieval.overlap_topk(questions, docs, 5))
