"""Hard negatives by a vantage-point tree: windows of inner products as distance annuli, nearest first.

A row x is taken as (x, sqrt(M - |x|^2)) and an anchor q as (q, 0), with M the
largest squared norm. Then |q - x|^2 = |q|^2 + M - 2 qx: the nearest rows are those of
highest score, and a window of scores is an annulus about the anchor. A tree of
vantage points, fitted on a sample, deals all rows into cells; each cell, and each page of
its rows, knows its least and largest distance from every vantage point, so
the triangle inequality tells which of them an annulus can meet. Requests visit their
cells nearest first, more of them each round, and leave out what lies beyond the
rows that they have. Distances only leave things out (with a margin for
rounding); scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import short_batches
from palisade.sources.scratch import discard, staged

#: Rows that the tree is fitted on; rows of the sample in a cell, at least; levels, at most.
SAMPLE, LEAF, LEVELS = 4096, 32, 7
#: Rows of a page, pages of a part of a cell that one task reads together, and requests that meet a page at once.
PAGE, PART, ASKED = 512, 64, 1024
#: Cells visited by the end of each round; the last one visits all that are left.
ROUNDS = (1, 9)
SCALE = 256
REQUEST = ("request", "id", "label", "v", "low", "high", "least")


class Tree(NamedTuple):
    """Vantage points (with their last, added, coordinate) in the order of a heap; rows nearer than the radius go left."""

    points: np.ndarray
    added: np.ndarray
    radius: np.ndarray
    levels: int
    largest: float

    def distances(self, x: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Distance of each row from each vantage point."""
        own = (x * x).sum(1) + added * added
        square = own[:, None] + self.largest - 2 * (x @ self.points.T + np.outer(added, self.added))
        return np.sqrt(np.maximum(square, 0))

    def cells(self, distances: np.ndarray) -> np.ndarray:
        node = np.zeros(len(distances), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (distances[np.arange(len(node)), node] > self.radius[node])
        return node - (2**self.levels - 1)


def raised(x: np.ndarray, largest: float) -> np.ndarray:
    """The added coordinate, which makes all squared norms the largest."""
    return np.sqrt(np.maximum(largest - (x * x).sum(1), 0))


def fitted(x: np.ndarray, largest: float) -> Tree:
    """A tree on sample rows: each node's vantage point is the one of a few that spreads its rows most, its radius their median distance."""
    levels = int(min(LEVELS, max(1, np.log2(max(len(x), 1) / LEAF))))
    n, added = 2**levels - 1, raised(x, largest)
    points, heights, radius = np.zeros((n, x.shape[1])), np.full(n, np.sqrt(largest)), np.zeros(n)
    member = {0: np.arange(len(x))}
    for node in range(n):
        rows = member.pop(node)
        if len(rows):
            few = rows[np.linspace(0, len(rows) - 1, min(len(rows), 8)).astype(int)]
            d = Tree(x[few], added[few], radius, levels, largest).distances(x[rows], added[rows])
            best = int(np.argmax(d.std(0)))
            points[node], heights[node], radius[node] = x[few[best]], added[few[best]], np.median(d[:, best])
            far = d[:, best] > radius[node]
        else:
            far = np.zeros(0, bool)
        member[2 * node + 1], member[2 * node + 2] = rows[~far], rows[far]
    return Tree(points, heights, radius, levels, largest)


def unpacked(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """Vectors of a binary column, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def quantised(rows: DataFrame, id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``(id, label, v)`` of the rows that take part, components as ``floor(scale * x)``.

    Those with a null id, label, vector or component, or one that is not finite, do not.
    Of rows that share an id the one of least label and vector does.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = rows.where(fine).select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


class Forest(NamedTuple):
    """The stored index: pages of rows, the tree, what cells are bounded by, and how vectors are packed."""

    pages: DataFrame
    tree: Tree
    low: np.ndarray
    high: np.ndarray
    parts: list[int]
    kind: str
    dims: int


def packed(v: Column, kind: str, dims: int, rows: DataFrame) -> DataFrame:
    """``rows`` with the integer array ``v`` as bytes, filled up with zeros to ``dims``."""
    names = [f.name for f in rows.schema.fields]
    schema = ", ".join(f"{f.name} {'binary' if f.name == 'v' else f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(names.index("v"))
            sizes = own.value_lengths().to_numpy()
            full = np.zeros((b.num_rows, dims), kind)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            full[np.repeat(np.arange(b.num_rows), sizes), place] = own.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in full], pa.binary()) if n == "v" else b.column(n) for n in names], names)

    return rows.withColumn("v", v).mapInArrow(run, schema)


def indexed(rows: DataFrame, copies: int) -> Forest | None:
    """A forest over staged ``rows(id, label, v)``; none without rows.

    Of rows that are equal in label and vector the ``copies`` of least id are
    kept, which are all that a search for fewer can return.
    """
    size = F.size("v")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    top = rows.agg(F.max(norm).alias("norm"), F.max(size).alias("dims"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))).alias("most")).first()
    if top.dims is None:
        return None
    dims, most, largest = max(top.dims, 1), top.most or 0.0, top.norm or 0.0
    if dims * most * most >= 2**63:
        raise ValueError("scores of these vectors do not fit a long")
    kind = "<i4" if most < 2**31 else "<i8"
    first = W.partitionBy("label", "v").orderBy("id")
    # equal vectors are cut down before they are shuffled: Spark limits ranked groups in each partition first
    own = packed(F.col("v"), kind, dims, rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= copies).drop("n"))
    own = staged(own, "vectors")
    sample = own.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).collect()
    tree = fitted(np.array([np.frombuffer(r.v, kind) for r in sample], float).reshape(-1, dims), largest)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column(2), kind, dims).astype(float)
            d = shared.value.distances(x, raised(x, largest))
            cell = shared.value.cells(d)
            last = (cell + 2**tree.levels - 2) // 2
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d[np.arange(len(d)), last]), *b.columns], ["cell", "shell", "id", "label", "v"])

    dealt = own.mapInArrow(placed, "cell long, shell double, id long, label long, v binary")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def page(rows: pa.RecordBatch) -> pa.RecordBatch:
            x = unpacked(rows.column(4), kind, dims)
            f = x.astype(float)
            d = shared.value.distances(f, raised(f, largest))
            columns = [[rows.column(0)[0].as_py()], [rows.num_rows], *([rows.column(n).to_numpy().astype("<i8").tobytes()] for n in (2, 3)), [x.tobytes()], [d.min(0)], [d.max(0)]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cell", "n", "ids", "labels", "vectors", "low", "high"])

        def full(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            """Pages of the cells that have ended, and whole pages of the one that goes on."""
            out, cells, at = [], rows.column(0).to_numpy(), 0
            while at < rows.num_rows:
                end = int(np.searchsorted(cells, cells[at], "right"))
                size = min(PAGE, end - at)
                if not last and end == rows.num_rows and size < PAGE:
                    break
                out.append(page(rows.slice(at, size).combine_chunks().to_batches()[0]))
                at += size
            return out, rows.slice(at)

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= 4 * PAGE:
                out, rest = full(pa.Table.from_batches(held), False)
                yield from out
                held = rest.to_batches()
        if sum(h.num_rows for h in held):
            yield from full(pa.Table.from_batches(held), True)[0]

    order = ("cell", "shell", "id")
    pages = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(bound, "cell long, n long, ids binary, labels binary, vectors binary, low array<double>, high array<double>")
    pages = staged(pages.withColumn("page", F.monotonically_increasing_id()), "pages")
    low, high = np.full((2**tree.levels, len(tree.points)), np.inf), np.full((2**tree.levels, len(tree.points)), -np.inf)
    # at most cells times vantage points
    for r in pages.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("n", "b")).groupBy("cell", "n").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")).collect():
        low[r.cell, r.n], high[r.cell, r.n] = r.low, r.high
    counted = {r.cell: r["count"] for r in pages.groupBy("cell").count().collect()}
    discard(own)
    return Forest(pages, tree, low, high, [-(-counted.get(c, 0) // PART) for c in range(2**tree.levels)], kind, dims)


def annuli(low: np.ndarray, high: np.ndarray, least: np.ndarray, square: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and farthest distance that windows ``low..high`` of scores allow, given the score ``least`` that more rows must reach (all as doubles, nan for none)."""
    far = np.fmax(low, least)
    near = np.sqrt(np.maximum(square + largest - 2 * high, 0))
    return np.nan_to_num(near, nan=0.0), np.nan_to_num(np.sqrt(np.maximum(square + largest - 2 * far, 0)), nan=np.inf)


def reach(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (requests x places) of the distance to any row of a place, from distances to vantage points and the place's bounds."""
    lower, upper = np.zeros((len(d), len(low))), np.full((len(d), len(low)), np.inf)
    for v in range(d.shape[1]):
        lower = np.maximum(lower, np.maximum(low[:, v][None] - d[:, v][:, None], d[:, v][:, None] - high[:, v][None]))
        upper = np.minimum(upper, d[:, v][:, None] + high[:, v][None])
    return lower, upper


def _numbers(b: pa.RecordBatch | pa.StructArray, name: str) -> np.ndarray:
    column = b.column(name) if isinstance(b, pa.RecordBatch) else b.field(name)
    return column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


#: Part of the distances by which rounding may be off, and more; scores that are no bound.
MARGIN = 1e-6
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _visits(requests: DataFrame, forest: Forest, start: int, end: int | None) -> DataFrame:
    """``(cell, *REQUEST)``: the cells from the ``start``-th to the ``end``-th nearest that each request's annulus may meet."""
    kinds = dict(requests.dtypes)
    schema = "cell long, " + ", ".join(f"{c} {kinds[c]}" for c in REQUEST)
    shared = requests.sparkSession.sparkContext.broadcast((forest.tree, forest.low, forest.high))
    kind, dims = forest.kind, forest.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, low, high = shared.value
        used = np.flatnonzero(np.isfinite(low[:, 0]))
        for whole in batches:
            for at in range(0, whole.num_rows, ASKED):
                b = whole.slice(at, ASKED)
                x = unpacked(b.column("v"), kind, dims).astype(float)
                square = (x * x).sum(1)
                lower, upper = reach(tree.distances(x, np.zeros(len(x))), low[used], high[used])
                least = np.full(len(x), np.nan)
                near, far = annuli(_numbers(b, "low"), _numbers(b, "high"), least, square, tree.largest)
                order = np.argsort(np.maximum(lower, near[:, None]), axis=1, kind="stable")
                now = order[:, start:end]
                _, far = annuli(_numbers(b, "low"), _numbers(b, "high"), _numbers(b, "least"), square, tree.largest)
                slack = MARGIN * (1 + np.sqrt(square + tree.largest))[:, None]
                meets = np.take_along_axis((lower <= far[:, None] + slack) & (upper >= near[:, None] - slack), now, 1)
                who, which = np.nonzero(meets)
                yield pa.RecordBatch.from_arrays([pa.array(used[now[who, which]]), *(b.column(c).take(pa.array(who)) for c in REQUEST)], ["cell", *REQUEST])

    return requests.select(*REQUEST).mapInArrow(run, schema)


def _scored(visits: DataFrame, forest: Forest, k: int, same: bool) -> DataFrame:
    """``(request, score, id)``: of each page that is visited, the first ``k`` rows of a request's window."""
    kind, dims, tree = forest.kind, forest.dims, forest.tree
    shared = visits.sparkSession.sparkContext.broadcast(tree)
    parts = F.get(F.array(*map(F.lit, forest.parts)), F.col("cell").cast("int"))
    # a block is as many requests as have numbers in a stretch of ASKED
    blocks = visits.groupBy("cell", F.floor(F.col("request") / ASKED).alias("stretch")).agg(F.collect_list(F.struct(*REQUEST)).alias("asked"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    pages = forest.pages.withColumn("part", F.pmod("page", parts.cast("long")))
    # requests, pages and results grow with the rows: none of these joins may send a side through the driver
    both = blocks.hint("merge").join(pages, ["cell", "part"]).select("asked", "ids", "labels", "vectors", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                asked = b.column("asked").slice(n, 1).flatten()
                v = unpacked(asked.field("v"), kind, dims)
                f = v.astype(float)
                square = (f * f).sum(1)
                low, high, least = (_numbers(asked, c) for c in ("low", "high", "least"))
                near, far = annuli(low, high, least, square, tree.largest)
                bounds = [np.array(b.column(c).slice(n, 1).flatten()).reshape(1, -1) for c in ("low", "high")]
                lower, upper = reach(shared.value.distances(f, np.zeros(len(f))), *bounds)
                slack = MARGIN * (1 + np.sqrt(square + tree.largest))
                open_ = np.flatnonzero((lower[:, 0] <= far + slack) & (upper[:, 0] >= near - slack))
                if not len(open_):
                    continue
                ids, labels = (np.frombuffer(b.column(c)[n].as_py(), "<i8") for c in ("ids", "labels"))
                rows = np.frombuffer(b.column("vectors")[n].as_py(), kind).reshape(-1, dims)
                most = max(int(np.abs(rows).max(initial=0)), int(np.abs(v).max(initial=0)))
                exact = float if dims * most * most < 2**53 else np.int64
                score = (v[open_].astype(exact) @ rows.T.astype(exact)).astype(np.int64)
                own = asked.field("label").to_numpy()[open_][:, None] == labels[None]
                fit = (own & (asked.field("id").to_numpy()[open_][:, None] != ids[None])) if same else ~own
                for name, none, keep in (("low", LOWEST, np.greater_equal), ("least", LOWEST, np.greater_equal), ("high", HIGHEST, np.less_equal)):
                    fit &= keep(score, asked.field(name).fill_null(none).to_numpy()[open_][:, None])
                who, which = np.nonzero(fit)
                if not len(who):
                    continue
                s, i = score[who, which], ids[which]
                order = np.lexsort((i, -s, who))
                who, s, i = who[order], s[order], i[order]
                first = np.searchsorted(who, who, "left")
                keep = np.arange(len(who)) - first < k
                request = asked.field("request").to_numpy()[open_]
                yield pa.RecordBatch.from_arrays([pa.array(request[who[keep]]), pa.array(s[keep]), pa.array(i[keep])], ["request", "score", "id"])

    return short_batches(both).mapInArrow(run, "request long, score long, id long")


def nearest(requests: DataFrame, forest: Forest, k: int, same: bool) -> DataFrame:
    """``(request, rank, id, score)``: the first ``k`` rows in the window of each of ``requests(request, id, label, v, low, high)``.

    Rows are those of the request's label (``same``, its own id not among them) or of
    another; by falling score, then id. A null ``low`` or ``high`` is no bound.
    Exact: a round leaves out only cells and pages that hold nothing better than the
    ``k`` rows that a request has.
    """
    found, starts = None, (0, *ROUNDS)
    by = W.partitionBy("request").orderBy(F.col("score").desc(), "id")
    for start, end in zip(starts, (*ROUNDS, None)):
        now = requests.withColumn("least", F.lit(None).cast("long"))
        if found is not None:
            have = found.groupBy("request").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            now = requests.join(have.hint("merge"), "request", "left")
        hits = _scored(_visits(now, forest, start, end), forest, k, same)
        every = hits if found is None else hits.unionByName(found.select("request", "score", "id"))
        old, found = found, staged(every.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "nearest")
        discard(*([] if old is None else [old]))
        if end is not None and end >= 2**forest.tree.levels:
            break
    return found.select("request", "rank", "id", "score")


def per_cent(score: Column, share: int, up: bool) -> Column:
    """``share`` hundredths of an integer, rounded up or down; exact, and within a long for shares up to 100."""
    rest = F.pmod(score, F.lit(100).cast("long"))
    whole = F.call_function("div", score - rest, F.lit(100).cast("long"))
    return whole * share + F.call_function("div", rest * share + (99 if up else 0), F.lit(100).cast("long"))


def hard_negatives(
    rows: DataFrame, anchors: Column, id: str = "id", vector: str = "vector", label: str = "label", positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = SCALE
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors among ``rows``.

    A row's score is its integer inner product with the anchor. An anchor (a row where ``anchors``,
    a condition on ``id``, holds) has as positives its first other rows of the same label; for each, the negatives
    are the first rows of another label whose score is from ``window[0]`` to ``window[1]`` per cent
    of the positive's. Ties go to the smaller id. Vectors of different lengths are
    filled up with zeros; see ``quantised`` for the rows that take part. Scores must fit a long.
    """
    own = staged(quantised(rows, id, vector, label, scale), "quantised")
    empty = own.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    forest = indexed(own, max(positives + 1, negatives))
    if forest is None:
        return empty
    none = F.lit(None).cast("long")
    asking = packed(F.col("v"), forest.kind, forest.dims, own.where(anchors)).withColumn("request", F.monotonically_increasing_id())
    asking = staged(asking.select("request", "id", "label", "v", none.alias("low"), none.alias("high")), "anchors")
    better = nearest(asking, forest, positives, True).select(F.col("request").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = asking.drop("low", "high").withColumnRenamed("request", "anchor").join(better.hint("merge"), "anchor")
    pairs = pairs.withColumns({"low": per_cent(F.col("positive_score"), window[0], True), "high": per_cent(F.col("positive_score"), window[1], False)})
    pairs = staged(pairs.withColumn("request", F.monotonically_increasing_id()).withColumnRenamed("id", "anchor_id"), "windows")
    found = nearest(pairs.select("request", F.col("anchor_id").alias("id"), "label", "v", "low", "high"), forest, negatives, False)
    out = pairs.select("request", "anchor_id", "positive_id", "positive_score").join(found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).hint("merge"), "request")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
