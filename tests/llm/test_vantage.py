"""Hard negatives by the vantage-point tree, held against all pairs in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import vantage
from palisade.llm.queries import QUERIES

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def expected(rows, anchor, positives=5, negatives=3, window=(50, 95)):
    """``rows`` of (id, label, vector), as hard negatives, all pairs compared."""
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(256 * float(x)) for x in v])
        own[i] = min(own.get(i, r), r)
    out = []
    for a in filter(anchor, sorted(own)):
        scored = sorted((-sum(x * y for x, y in zip(own[a][1], v)), i, label) for i, (label, v) in own.items())
        for p, i, _ in [s for s in scored if s[2] == own[a][0] and s[1] != a][:positives]:
            fit = [(n, j) for n, j, label in scored if label != own[a][0] and window[0] * -p <= 100 * -n <= window[1] * -p][:negatives]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows):
    """With columns whose names the operator also uses inside."""
    return spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "id long, label int, vector array<float>, cell int, score double, page string")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed):
    """Clusters, copies, ties, zero vectors; small pages, parts and blocks, so that all of them are many."""
    for name, value in {"PAGE": 16, "PART": 2, "ASKED": 8, "LEAF": 8, "SAMPLE": 128}.items():
        monkeypatch.setattr(vantage, name, value)
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 8)) / 2
    rows = []
    for i in range(600):
        v = centers[rng.integers(6)] * rng.uniform(0.3, 1.2) + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.3])
        rows.append((i, int(rng.integers(4)), [float(np.float32(x)) for x in v]))
    rows += [(600 + i, i % 3, rows[0][2]) for i in range(60)]  # copies
    rows += [(700 + i, i % 2, [0.0] * 8) for i in range(10)]
    rows = [r for r in rows if r[1] is not None]
    out = got(vantage.hard_negatives(table(spark, rows).repartition(5), F.col("id") % 7 == 0))
    want = expected(rows, lambda i: i % 7 == 0)
    assert out == want and len(want) > 300


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.0]), (2, 2, [0.7, 0.1]), (3, 2, [0.8, 0.0]), (3, 2, [0.8, 0.0]), (3, 5, [9.0, 0.0]), (4, None, [0.7, 0.0]), (5, 2, None), (6, 2, [nan, 0.0]), (7, 2, [inf, 0.0]), (8, 2, [None, 0.6]),
            (None, 2, [0.6, 0.0]), (9, 2, []), (10, 2, [0.75]), (11, 1, [-1.0, -3.0]), (12, 1, [0.9, 0.4, 0.3])]
    want = expected(rows, lambda i: i == 0)
    assert got(vantage.hard_negatives(table(spark, rows), F.col("id") == 0)) == want and want
    assert got(vantage.hard_negatives(table(spark, rows[:0] or [rows[4 + 2]]), F.col("id") == 0)) == []
    assert got(vantage.hard_negatives(table(spark, rows).limit(0), F.col("id") == 0)) == []
    assert got(vantage.hard_negatives(table(spark, rows), F.col("id") == 99)) == []
    assert got(vantage.hard_negatives(table(spark, rows), F.col("id") == 0, positives=1, negatives=1)) == expected(rows, lambda i: i == 0, 1, 1)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.choice([2.0**20, 2.0**20 + 1, 3.0, 2.0**19 + 0.25]) for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    assert got(vantage.hard_negatives(df, F.col("id") % 5 == 0)) == expected(rows, lambda i: i % 5 == 0)
    with pytest.raises(ValueError):
        vantage.hard_negatives(spark.createDataFrame([(0, 1, [1e30])], "id long, label int, vector array<double>"), F.col("id") == 0)


def test_bounds_hold_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 6)) * 100)
    largest = float((x * x).sum(1).max())
    tree = vantage.fitted(x[:256], largest)
    added = vantage.raised(x, largest)
    d = tree.distances(x, added)
    direct = np.linalg.norm(np.c_[x, added][:, None] - np.c_[tree.points, tree.added][None], axis=2)
    margin = vantage.MARGIN * np.sqrt(2 * largest)
    assert np.allclose(d, direct, atol=margin)
    cell = tree.cells(d)
    assert len(set(cell)) == 2**tree.levels
    q = np.floor(rng.normal(size=(20, 6)) * 100)
    own = np.linalg.norm(np.c_[q, np.zeros(20)][:, None] - np.c_[x, added][None], axis=2)
    for c in set(cell):
        low, high = d[cell == c].min(0)[None], d[cell == c].max(0)[None]
        lower, upper = vantage.reach(tree.distances(q, np.zeros(20)), low, high)
        assert (lower[:, 0] <= own[:, cell == c].min(1) + margin).all() and (upper[:, 0] >= own[:, cell == c].max(1) - margin).all()


def test_per_cent(spark):
    scores = [-201, -200, -199, -1, 0, 1, 7, 99, 100, 101, 2**62]
    df = spark.createDataFrame([(s,) for s in scores], "s long").select("s", vantage.per_cent(F.col("s"), 50, True).alias("a"), vantage.per_cent(F.col("s"), 95, False).alias("b"))
    for r in df.collect():
        assert (r.a, r.b) == (-(-r.s * 50 // 100), r.s * 95 // 100)


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op12_vantage_negatives"](spark, sf)) == expected(rows, lambda i: i % 50 == 0)


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Requests, pages and results meet in joins that send no side through the driver, however small they are."""
    plans, staged = [], vantage.staged
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(vantage, "staged", lambda df, label: (planned(df), staged(df, label))[1])
    rng = random.Random(5)
    out = vantage.hard_negatives(table(spark, [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]), F.col("id") % 50 == 0, "id", "vector", "label")
    planned(out)
    assert out.count() and sum("SortMergeJoin" in p for p in plans) >= 6
    assert not [p for p in plans if "Broadcast" in p]
