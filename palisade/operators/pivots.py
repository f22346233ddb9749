"""Exact cosine search over an index of centroids: triangle bounds leave out what cannot be among the nearest.

Vectors of length 1 are as near as their cosine is high (the squared distance is 2 - 2 cos).
Centroids are fitted on a sample; every vector goes to its nearest one's
cell, and the rows of a cell to pages by their distance from it. Cells and
pages know their least and largest distance from each centroid, so a query's own
distances bound those of their rows. A query looks into its nearest
cell first; then only into cells and pages that may hold something better.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.sources.scratch import staged

#: Rows that centroids are fitted on, rows of it for each, centroids at most, and rounds of the fit.
SAMPLE, EACH, CENTROIDS, ROUNDS = 4096, 32, 64, 8
#: Rows of a page, pages of a part of a cell, and queries that meet a page at once.
PAGE, PART, ASKED = 512, 64, 1024
#: More than distances may be off by rounding.
MARGIN = 1e-6


class PivotIndex(NamedTuple):
    """Pages of rows, centroids, each cell's bounds and number of parts, and the first rows of zero length."""

    pages: DataFrame
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: list[int]
    zeros: list[int]


def unit(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors of length 1 (zeros stay), filled up with zeros or cut to ``dims``; missing components are zeros."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    values = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, keep = np.repeat(np.arange(len(lists)), sizes), place < dims
    out = np.zeros((len(lists), dims))
    out[row[keep], place[keep]] = values[keep]
    # large and tiny components are brought to one size before they are squared
    out /= np.maximum(np.abs(out).max(1, initial=0, keepdims=True), 1e-300)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def fitted(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a sample, by a few rounds of Lloyd's method from rows spread over it."""
    n = int(np.clip(len(x) // EACH, 1, CENTROIDS))
    centers = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = distances(x, centers).argmin(1)
        for c in range(n):
            if (own == c).any():
                centers[c] = x[own == c].mean(0)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * x @ centers.T, 0))


def reach(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance (queries x places) that a row of a place can have, from the queries' and the places' distances to the centroids."""
    least = np.zeros((len(d), len(low)))
    for c in range(d.shape[1]):
        least = np.maximum(least, np.maximum(low[:, c][None] - d[:, c][:, None], d[:, c][:, None] - high[:, c][None]))
    return least


def _paged(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (cell, shell, ordinal, vector bytes), sorted, as pages of one cell each; at most a few pages are held."""
    held: list[pa.RecordBatch] = []

    def page(rows: pa.Table) -> pa.RecordBatch:
        b = rows.combine_chunks().to_batches()[0]
        vectors = b"".join(b.column(3).to_pylist())
        d = distances(np.frombuffer(vectors).reshape(b.num_rows, -1), centers)
        columns = [pa.array([b.column(0)[0].as_py()]), pa.array([b.column(2).to_numpy().tobytes()], pa.binary()), pa.array([vectors], pa.binary()), *(pa.array([x], pa.list_(pa.float64())) for x in (d.min(0), d.max(0)))]
        return pa.RecordBatch.from_arrays(columns, ["cell", "ordinals", "vectors", "low", "high"])

    def cut(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        cells, at, out = rows.column(0).to_numpy(), 0, []
        while at < rows.num_rows:
            end = int(np.searchsorted(cells, cells[at], "right"))
            size = min(PAGE, end - at)
            if not last and end == rows.num_rows and size < PAGE:
                break
            out.append(page(rows.slice(at, size)))
            at += size
        return out, rows.slice(at)

    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= 4 * PAGE:
            out, rest = cut(pa.Table.from_batches(held), False)
            yield from out
            held = rest.to_batches()
    if sum(h.num_rows for h in held):
        yield from cut(pa.Table.from_batches(held), True)[0]


def build(vectors: DataFrame, top_k: int) -> PivotIndex | None:
    """An index of ``vectors(ordinal, vector)`` in scratch tables, for searches of up to ``top_k`` rows; none without rows.

    Rows with a null ordinal or vector are left out. Of rows of zero length, whose
    cosine is 0 with everything, the first ``top_k`` by ordinal are kept apart. Of equal
    vectors any number may be there: they are pages like others.
    """
    rows = vectors.where("ordinal is not null and vector is not null").select(F.col("ordinal").cast("long").alias("ordinal"), F.col("vector").cast("array<double>").alias("vector"))
    empty = F.forall("vector", lambda x: F.coalesce(x, F.lit(0.0)) == 0)
    zeros = [r.ordinal for r in rows.where(empty).orderBy("ordinal").limit(top_k).select("ordinal").collect()]
    rows = rows.where(~empty)
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return PivotIndex(rows, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), [], zeros) if zeros else None
    sample = rows.withColumn("h", F.xxhash64("ordinal", "vector")).orderBy("h").limit(SAMPLE).select("vector").collect()
    centers = fitted(unit(pa.array([r.vector for r in sample], pa.list_(pa.float64())), dims))
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column(1), dims)
            d = distances(x, shared.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d[np.arange(len(d)), cell]), b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["cell", "shell", "ordinal", "v"])

    order = ("cell", "shell", "ordinal")
    sorted_ = rows.mapInArrow(placed, "cell long, shell double, ordinal long, v binary").repartitionByRange(*order).sortWithinPartitions(*order)
    pages = sorted_.mapInArrow(lambda batches: _paged(batches, shared.value), "cell long, ordinals binary, vectors binary, low array<double>, high array<double>")
    pages = staged(pages.withColumn("page", F.monotonically_increasing_id()), "pages")
    n = len(centers)
    low, high, parts = np.full((n, n), np.inf), np.full((n, n), -np.inf), [0] * n
    # at most as many rows as the square of CENTROIDS
    for r in pages.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("c", "b")).groupBy("cell", "c").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"), F.count("*").alias("pages")).collect():
        low[r.cell, r.c], high[r.cell, r.c], parts[r.cell] = r.low, r.high, -(-r.pages // PART)
    return PivotIndex(pages, centers, low, high, parts, zeros)


def _cells(queries: DataFrame, index: PivotIndex, first: bool) -> DataFrame:
    """``(cell, number, v, worst)``: of ``queries(number, v, worst)`` the nearest cell (``first``), or all others that may hold a score of ``worst`` or more."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.low, index.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, low, high = shared.value
        used = np.flatnonzero(np.isfinite(low[:, 0]))
        for whole in batches:
            for at in range(0, whole.num_rows, ASKED):
                b = whole.slice(at, ASKED)
                x = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1)
                d = distances(x, centers)
                least = reach(d, low[used], high[used])
                order = np.lexsort((d[:, used], least), axis=1)
                if first:
                    who, which = np.arange(b.num_rows), order[:, 0]
                else:
                    far = np.sqrt(np.maximum(2 - 2 * (b.column(2).to_numpy(zero_copy_only=False).astype(float) - 1e-6), 0))
                    open_ = ~(least > np.nan_to_num(far, nan=np.inf)[:, None] + MARGIN)
                    open_[np.arange(b.num_rows), order[:, 0]] = False
                    who, which = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([pa.array(used[which]), *(b.column(c).take(pa.array(who)) for c in range(3))], ["cell", "number", "v", "worst"])

    return queries.select("number", "v", "worst").mapInArrow(run, "cell long, number long, v binary, worst double")


def _best(number: np.ndarray, score: np.ndarray, ordinal: np.ndarray, top_k: int) -> tuple[np.ndarray, ...]:
    """The first ``top_k`` of each number, by falling score, then ordinal."""
    by = np.lexsort((ordinal, -score, number))
    n = number[by]
    keep = by[np.arange(len(n)) - np.searchsorted(n, n, "left") < top_k]
    return number[keep], score[keep], ordinal[keep]


def _scored(visits: DataFrame, index: PivotIndex, top_k: int, digits: int, visited: Accumulator | None) -> DataFrame:
    """``(number, score, ordinal)``: the first ``top_k`` of a query among the pages that a task reads for it."""
    shared = visits.sparkSession.sparkContext.broadcast(index.centroids)
    parts = F.get(F.array(*map(F.lit, index.parts)), F.col("cell").cast("int")).cast("long")
    blocks = visits.groupBy("cell", F.floor(F.col("number") / ASKED).alias("stretch")).agg(F.collect_list(F.struct("number", "v", "worst")).alias("asked"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    # queries, pages and results grow with the rows: none of these joins may send a side through the driver
    both = blocks.hint("merge").join(index.pages.withColumn("part", F.pmod("page", parts)), ["cell", "part"]).select("asked", "ordinals", "vectors", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            for n in range(b.num_rows):
                asked = b.column("asked").slice(n, 1).flatten()
                q = np.frombuffer(b"".join(asked.field("v").to_pylist())).reshape(len(asked), -1)
                ordinals = np.frombuffer(b.column("ordinals")[n].as_py(), np.int64)
                x = np.frombuffer(b.column("vectors")[n].as_py()).reshape(len(ordinals), -1)
                worst = asked.field("worst").to_numpy(zero_copy_only=False).astype(float)
                far = np.nan_to_num(np.sqrt(np.maximum(2 - 2 * (worst - 1e-6), 0)), nan=np.inf)
                bounds = [b.column(c).slice(n, 1).flatten().to_numpy().reshape(1, -1) for c in ("low", "high")]
                open_ = np.flatnonzero(reach(distances(q, shared.value), *bounds)[:, 0] <= far + MARGIN)
                if visited is not None:
                    visited.add(len(open_) * len(ordinals))
                s = np.round(q[open_] @ x.T, digits) + 0.0
                fit = ~(s < np.nan_to_num(worst[open_], nan=-np.inf)[:, None])
                who, which = np.nonzero(fit)
                held.append(list(_best(asked.field("number").to_numpy()[open_][who], s[who, which], ordinals[which], top_k)))
                rows += len(held[-1][0])
                if rows > 4 * ASKED * max(top_k, 1) and len(held) > 1:
                    held = [list(_best(*map(np.concatenate, zip(*held)), top_k))]
                    # what cannot be cut is passed on
                    if (rows := len(held[0][0])) > 2 * ASKED * max(top_k, 1):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["number", "score", "ordinal"])
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(*map(np.concatenate, zip(*held)), top_k)], ["number", "score", "ordinal"])

    return both.mapInArrow(run, "number long, score double, ordinal long")


def search(queries: DataFrame, index: PivotIndex | None, top_k: int = 5, digits: int = 6, visited: Accumulator | None = None) -> DataFrame:
    """``(query_id, rank, ordinal, score)``: the first ``top_k`` rows for each of ``queries(query_id, vector)``, by falling cosine (``digits``), then ordinal.

    Exact for any number of queries, which stay in tables. Queries of zero length
    have a cosine of 0 with every row: all pages are looked through for them. A null id or vector has no
    row. ``visited`` counts the pairs of query and row that were compared.
    """
    spark = queries.sparkSession
    kind = dict(queries.dtypes)["query_id"]
    if index is None or not top_k:
        return spark.createDataFrame([], f"query_id {kind}, rank int, ordinal long, score double")
    asked = queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")).withColumn("number", F.monotonically_increasing_id())
    asked = staged(asked, "queries")
    dims = index.centroids.shape[1]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in unit(b.column(1), dims)], pa.binary())], ["number", "v"])

    zero = F.array(*map(F.lit, index.zeros)).cast("array<long>")
    found = asked.select("number", F.lit(0.0).alias("score"), F.explode(zero).alias("ordinal"))
    by = W.partitionBy("number").orderBy(F.col("score").desc(), "ordinal")
    cut = lambda rows: rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)
    if dims:
        own = staged(asked.select("number", "vector").mapInArrow(packed, "number long, v binary"), "query-vectors")
        near = own.withColumn("worst", F.lit(None).cast("double"))
        first = staged(cut(found.unionByName(_scored(_cells(near, index, True), index, top_k, digits, visited))), "nearest").drop("rank")
        worst = first.groupBy("number").agg(F.when(F.count("*") >= top_k, F.min("score")).alias("worst"))
        rest = _scored(_cells(own.join(worst.hint("merge"), "number", "left"), index, False), index, top_k, digits, visited)
        found = first.unionByName(rest)
    best = staged(cut(found), "winners")
    return best.join(asked.select("number", "query_id").hint("merge"), "number").select("query_id", "rank", "ordinal", "score")
