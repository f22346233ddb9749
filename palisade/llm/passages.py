"""Repeated passages: runs of words that occurred earlier, wherever they start within a line.

The unit is the sliding window of ``WORDS`` words. All windows of a corpus are
too many to shuffle, so each has one anchor, chosen by its content alone (its
smallest hash of ``GRAM`` words). Equal windows have equal anchors, and only
windows whose anchor's hash occurs more than once are looked at:

1. find the anchors of every text, and the windows that belong to each;
2. count anchor hashes (only hashes are shuffled);
3. digest the windows of repeated anchors, one row an anchor;
4. bring equal anchor hashes together and keep each digest's earliest window.

Hashes with more than ``LARGE`` windows are not gathered: their windows are
reduced to the earliest one by partial aggregation. Copies of a whole text
repeat wherever their first copy does not, so they skip all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import common_keys, sliced
from palisade.sources.scratch import staged

#: Words of a window: passages of over 50 words are found.
WORDS = 51
#: Words that are hashed at an anchor.
GRAM = 8
#: Windows of one anchor hash that are brought together at most, about 30 MB.
LARGE = 2_000_000
#: Words that are looked at in one go; longer texts are read in overlapping pieces.
PIECE = 1 << 20
#: Rows and windows that are compared in one go.
CHUNK = 200_000

_RNG = np.random.default_rng(20240301)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**63, 8, dtype=np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a hash that give way to the position, so that the leftmost of equal hashes is chosen.
_PLACE = np.uint64((1 << 23) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and hash of each word; A-Z count as a-z."""
    raw = np.frombuffer(text, np.uint8)
    blank = _BLANK[raw]
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    own = np.zeros(len(raw), np.int64)
    own[start] = start
    place = (np.arange(len(raw)) - np.maximum.accumulate(own)).astype(np.uint64)
    h = _mix(_BYTE[_LOWER[raw]] + place * _STEP)
    h[blank] = 0
    total = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]
    return start, end, _mix(total[end] - total[start] + (end - start).astype(np.uint64) * _STEP)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` word hashes that start at each place."""
    out, width, k = h, 1, 0
    while width * 2 <= n:
        out, width, k = _mix(out[:-width] * _ODD[k] + out[width:]), width * 2, k + 1
    if width < n:
        m = len(h) - n + 1
        out = _mix(out[:m] * _ODD[7] + out[n - width : n - width + m])
    return out


def anchors(h: np.ndarray, n: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, first window, last window)`` of each anchor of a text's word hashes; windows are named by their first word.

    Anchors of one hash that follow each other, as in a text that repeats a word, are one.
    """
    out: list[list[np.ndarray]] = [[], [], []]
    for lo in range(0, max(0, len(h) - n + 1), PIECE - n + 1):
        grams = runs(h[lo : lo + PIECE], gram)
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span, width = n - gram + 1, 1
        while width * 2 <= span:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        own = grams[(low & _PLACE).astype(np.int64)]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for o, x in zip(out, (own[first].view(np.int64), first + lo, np.r_[first[1:], len(own)] - 1 + lo)):
            o.append(x)
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in out)  # type: ignore[return-value]


def order(prefix: str = "") -> list[Column]:
    """Documents from the earliest on: by doc_id, null last, then by ``rank``."""
    return [F.col(f"{prefix}doc_id").isNull(), F.col(f"{prefix}doc_id"), F.col(f"{prefix}rank")]


def copies(rows: DataFrame) -> DataFrame:
    """``(doc_id, rank)`` of the rows whose whole text an earlier row has; ``rank`` is a hash of the text."""
    own = rows.where("text is not null").select("doc_id", "rank", F.unhex(F.md5("text")).alias("digest"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    first = own.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    return common_keys(own, staged(first, "first-copies"), "digest").where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "rank")


def _anchors_of(rows: DataFrame, n: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "rank", "h", "first", "last"]
        for b in sliced(batches):
            ids, found = [], [[np.empty(0, np.int64)] for _ in range(3)]
            for i, t in enumerate(b.column(2)):
                own = anchors(words(t.as_py().encode())[2], n, gram)
                ids += [i] * len(own[0])
                for f, x in zip(found, own):
                    f.append(x)
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(np.concatenate(f), pa.int64()) for f in found)], names)

    long = rows.where(F.octet_length("text") >= 2 * n - 1).select("doc_id", "rank", "text")
    return long.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, rank long, h long, first long, last long")


def _windows(rows: DataFrame, wanted: DataFrame, late: DataFrame, n: int) -> DataFrame:
    """``(h, doc_id, rank, first, digests)``: the windows of ``wanted`` anchors, without those of later copies."""
    per_doc = wanted.groupBy("doc_id", "rank").agg(F.collect_list(F.struct("h", "first", "last")).alias("found"))
    gone = late.withColumnsRenamed({"doc_id": "i", "rank": "r"})
    per_doc = per_doc.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("rank") == F.col("r")), "left_anti")
    per_doc = per_doc.withColumnsRenamed({"doc_id": "i", "rank": "r"})
    both = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("rank") == F.col("r"))).select("doc_id", "rank", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "doc_id", "rank", "first", "digests"]
        for b in sliced(batches):
            for i in range(b.num_rows):
                found = b.column(3)[i].as_py()
                digests = runs(words(b.column(2)[i].as_py().encode())[2], n).view(np.int64)
                for k in range(0, len(found), 2000):
                    part = found[k : k + 2000]
                    take = pa.array([i] * len(part), pa.int64())
                    columns = [pa.array([f["h"] for f in part], pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array([f["first"] for f in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([digests[f["first"] : f["last"] + 1] for f in part], pa.list_(pa.int64()))], names)

    return both.mapInArrow(run, f"h long, doc_id {dict(rows.dtypes)['doc_id']}, rank long, first long, digests array<long>")


def _later(h: np.ndarray, digest: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which windows are not the earliest of their digest, for windows in rising order; one that overlaps the earliest is part of it."""
    by = np.lexsort((np.arange(len(h)), digest, h))
    new = np.r_[True, (h[by][1:] != h[by][:-1]) | (digest[by][1:] != digest[by][:-1])]
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    gone = np.empty(len(h), bool)
    gone[by] = (doc[by] != doc[first]) | (at[by] >= at[first] + n)
    return gone


def _ranges(gone: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window) of each run of marked windows of a row."""
    hit = np.flatnonzero(gone)
    if not len(hit):
        return hit, hit, hit
    new = np.r_[True, (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])]
    first = hit[new]
    last = hit[np.r_[np.flatnonzero(new)[1:], len(hit)] - 1]
    return row[first], at[first], at[last]


def _small(found: DataFrame, n: int) -> DataFrame:
    """Ranges of repeated windows, from anchors that are brought together by hash and read in order."""
    kind = dict(found.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = b.column(4)
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            first = np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(b.column(3).to_numpy(), size) + np.arange(len(row)) - first
            rank, ids = b.column(2).to_numpy(), b.column(1)
            same = np.r_[False, rank[1:] == rank[:-1]] & np.r_[False, pc.fill_null(pc.equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)] if b.num_rows else np.zeros(0, bool)
            # rows of one document follow each other within an anchor's hash; a copy's id differs or its rank does
            doc = np.cumsum(~same)
            gone = _later(np.repeat(b.column(0).to_numpy(), size), lists.flatten().to_numpy(), doc[row], at, n)
            r, lo, hi = _ranges(gone, row, at)
            take = pa.array(r, pa.int64())
            return pa.RecordBatch.from_arrays([ids.take(take), b.column(2).take(take), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["doc_id", "rank", "first", "last"])

        for b in batches:
            held.append(b)
            if sum(len(x.column(4).values) for x in held) < CHUNK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = whole.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last hash may go on
            if cut:
                yield done(pa.Table.from_batches([whole.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = [whole.slice(cut)]
            else:
                held = [whole]
        if held:
            for b in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield done(b)

    return found.repartition("h").sortWithinPartitions("h", *order(), "first").mapInArrow(run, f"doc_id {kind}, rank long, first long, last long")


def _large(found: DataFrame, n: int) -> DataFrame:
    """Ranges of repeated windows of anchors that very many rows share, without gathering one."""
    each = found.select("h", "doc_id", "rank", F.posexplode("digests").alias("k", "digest"), "first")
    each = each.select("h", "digest", "doc_id", "rank", (F.col("first") + F.col("k")).alias("at"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rank", "at")
    first = each.groupBy("h", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    both = common_keys(each, staged(first, "first-windows"), "h", "digest")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rank") == F.col("first.rank"))
    return both.where(~same | (F.col("at") >= F.col("first.at") + n)).select("doc_id", "rank", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated(rows: DataFrame, n: int = WORDS, gram: int = GRAM, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """What of ``rows(doc_id, rank, text)`` occurred earlier, as ranges of windows and as whole copies.

    A window of ``n`` words counts as repeated if an equal one starts in an
    earlier row (doc_id, null last, then rank), or at least ``n`` words earlier in
    the same. ``rank`` is a hash of the text, so equal keys have equal texts.

    Returns ``(doc_id, rank, first, last)``, first and last window of a run
    of repeated ones in texts that are no later copy, and ``(doc_id, rank)`` of
    the later copies. Null texts have no words.
    """
    late = staged(copies(rows), "copies")
    found = staged(_anchors_of(rows, n, gram), "passage-anchors")
    windows = F.col("last") - F.col("first") + 1
    # a single anchor that has few windows cannot repeat itself
    often = found.groupBy("h").agg(F.sum(windows).alias("n"), F.count("*").alias("rows"), F.max(windows).alias("most")).where((F.col("rows") > 1) | (F.col("most") > n))
    often = staged(often.select("h", "n"), "passage-counts")
    most = often.agg(F.max("n")).first()[0] or 0
    out = _small(_windows(rows, found.join(often.where(F.col("n") <= large).drop("n"), "h"), late, n), n)
    if most > large:
        out = out.union(_large(_windows(rows, found.join(often.where(F.col("n") > large).drop("n"), "h"), late, n), n))
    return out, late


def spans(text: str, ranges: list[tuple[int, int]], whole: bool, n: int = WORDS) -> list[tuple[int, int]]:
    """Half-open character ranges, from the first to the last word of each run of words that ``ranges`` of windows (or a whole copy) cover."""
    if not ranges and not whole:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    start, end, _ = words(raw)
    if whole:
        ranges = [(0, len(start) - n)] if len(start) >= n else []
    cover: list[list[int]] = []
    for a, z in sorted(ranges):
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], z + n)
        else:
            cover.append([a, z + n])
    if len(raw) == len(text):
        return [(int(start[a]), int(end[z - 1])) for a, z in cover]
    place = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(place[start[a]]) - 1, int(place[end[z - 1] - 1])) for a, z in cover]
