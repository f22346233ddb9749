"""Suffix-array dedup of long repeated byte strings, across and within documents.

A full suffix array of the corpus does not fit a shuffle budget, so the array is
sparse. Each window of ``LENGTH`` bytes has one anchor, chosen by its content
alone (the position of its smallest 32-gram hash), so equal windows have equal
anchors at equal offsets, and about one byte in 185 is an anchor:

1. find the anchors of every document and the windows that belong to each;
2. keep anchors whose hash occurs more than once (only hashes are shuffled);
3. cut the bytes those anchors' windows span and bring equal hashes together;
4. sort what follows the anchors into a suffix array with its common-prefix
   array, scan that with a stack into its interval tree, and in each interval
   test how far the members also agree to the left. Left contexts that branch
   are where a repeat is maximal; all members of an interval are reported at
   once, not neighbour pairs.

A text that repeats a short period has an anchor each period, all with one
context. Such a chain is proved on the spot, byte by byte, and leaves its first
anchor: the rest has no windows that the first has not.

Equal contexts are one class with a count before any sorting, so thousands of
exact copies cost one entry. Hashes that more than ``LARGE`` anchors share are
not gathered at all: their windows are counted one by one by aggregation, which
is exact for a group of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import merged, short_batches, sliced
from palisade.sources.scratch import staged

#: Bytes of a string that may not repeat.
LENGTH = 400
#: Bytes hashed at an anchor.
GRAM = 32
#: Anchors of one hash that are brought together at most; larger groups are counted window by window.
LARGE = 20_000
#: Parts over which the rows of one very common context are dealt.
SALTS = 64
#: Bytes looked at in one go; longer texts are read in overlapping pieces.
PIECE = 1 << 22

SPAN_NAMES = ["doc_id", "rank", "start", "end"]
SPAN_SCHEMA = "doc_id long, rank int, start long, end long"

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**63, 8, dtype=np.uint64)]
#: Low bits of a hash that give way to the position, so that the leftmost of equal hashes is chosen.
_PLACE = np.uint64((1 << 23) - 1)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) that start at each position."""
    h, width, k = _BYTE[raw], 1, 0
    while width < gram:
        h = h[:-width] * _ODD[k] + h[width:]
        h ^= h >> np.uint64(29)
        width, k = width * 2, k + 1
    h = h * _ODD[6]
    return h ^ (h >> np.uint64(32))


def _pieces(text: bytes, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """Where each piece of a text starts, its bytes, and ``(hash, position, first window, last window)`` of its anchors."""
    for lo in range(0, max(0, len(text) - length + 1), PIECE - length + 1):
        raw = np.frombuffer(text, np.uint8, min(PIECE, len(text) - lo), lo)
        h = gram_hashes(raw, gram)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, width = length - gram + 1, 1
        while width * 2 <= span:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        at = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield lo, raw, (h[at[first]].view(np.int64), at[first], first, np.r_[first[1:], len(at)] - 1)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, position, first window, last window)`` of each anchor; windows are named by their start."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
    for lo, _, (h, *places) in _pieces(text, length, gram):
        for o, x in zip(out, (h, *(p + lo for p in places))):
            o.append(x)
    return tuple(map(np.concatenate, out))  # type: ignore[return-value]


def chain_heads(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """As ``anchors``, without those whose context is that of the one before; and where the bytes of each such chain end (0: no chain).

    All windows of a chain repeat, since each is found again one anchor on or back.
    """
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
    for lo, raw, (h, at, first, last) in _pieces(text, length, gram):
        step = np.diff(at)
        like = np.flatnonzero((h[1:] == h[:-1]) & (np.diff(first) == step) & (np.diff(last) == step))
        again = np.zeros(len(at), bool)
        for run in np.split(like, np.flatnonzero((np.diff(like) != 1) | (np.diff(step[like]) != 0)) + 1) if len(like) else ():
            d, start, end = step[run[0]], first[run[0]], last[run[-1]] + length
            wrong = np.r_[0, np.cumsum(raw[start:end] != raw[start + d : end + d])]
            again[run + 1] = wrong[last[run] + length - start] == wrong[first[run] - start]
        heads = np.flatnonzero(~again)
        tails = np.r_[heads[1:], len(at)] - 1
        ends = np.where(tails > heads, last[tails] + length + lo, 0)
        for o, x in zip(out, (h[heads], at[heads] + lo, first[heads] + lo, last[heads] + lo, ends)):
            o.append(x)
    return tuple(map(np.concatenate, out))


def _prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _neighbour_prefixes(s: list[bytes]) -> list[int]:
    return [0] + [_prefix(a, b) for a, b in zip(s, s[1:])]


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """``(depth, parent depth, first, last)`` of each interval of a common-prefix array, children first."""
    stack: list[list[int]] = [[0, 0]]  # depth, first
    for i in range(1, len(lcp) + 1):
        now, left = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            yield depth, max(now, stack[-1][0] if stack else 0), left, i - 1
        if not stack or stack[-1][0] < now:
            stack.append([now, left])


def maximal_repeats(left: list[bytes], right: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each different context of one anchor, the offsets of its repeated windows.

    ``left[i]`` is what precedes the anchor, reversed; ``right[i]`` starts with
    the anchor. A window at offset t is t bytes of left and ``length`` - t of
    right; it repeats if another context has the same. The result has ranges
    ``(first t, last t)`` for each context.
    """
    n = len(right)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n < 2:
        return found
    if n == 2:
        t, most = length - _prefix(right[0], right[1]), _prefix(left[0], left[1])
        if t <= most:
            found[0].append((max(t, 0), most))
            found[1].append((max(t, 0), most))
        return found
    suffixes = sorted(range(n), key=right.__getitem__)
    lcp = _neighbour_prefixes([right[i] for i in suffixes])
    by_left = sorted(range(n), key=left.__getitem__)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    left_lcp = np.array([*_neighbour_prefixes([left[i] for i in by_left])], np.int64)
    ranks = rank[suffixes]
    for depth, parent, first, last in intervals(lcp):
        low = length - min(depth, length)
        high = length - parent - 1
        if depth <= 0:
            continue
        if parent >= length:
            continue
        r = np.sort(ranks[first : last + 1])
        # agreement to the left with the nearest other member, on either side
        agree = _between(left_lcp, r)
        most = np.maximum(np.r_[agree, -1], np.r_[-1, agree])
        most = np.minimum(most, high)
        for k in np.flatnonzero(most >= low):
            found[by_left[r[k]]].append((low, int(most[k])))
    return found


def _between(lcp: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Common prefix of consecutive ranks ``r`` (sorted): the least of ``lcp`` between them."""
    if r[-1] - r[0] == len(r) - 1:
        return lcp[r[1:]]
    return np.minimum.reduceat(lcp[: r[-1] + 1], r[:-1] + 1)


def _group(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Repeated byte ranges ``(doc_id, rank, start, end)`` of one anchor's occurrences.

    Rows are (doc_id, rank, position, reversed left context, right context).
    """
    classes: dict[tuple[bytes, bytes], list[int]] = {}
    for i, r in enumerate(rows):
        classes.setdefault((r[3], r[4]), []).append(i)
    keys = list(classes)
    ranges = maximal_repeats([k[0] for k in keys], [k[1] for k in keys], length)
    for key, spans in zip(keys, ranges):
        members = classes[key]
        if len(members) > 1:  # all windows of the context repeat
            spans = [(length - len(key[1]), len(key[0]))]
        if spans:
            for i in members:
                for t0, t1 in spans:
                    yield rows[i][0], rows[i][1], rows[i][2] - t1, rows[i][2] - t0 + length


def _anchors_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "rank", "h", "pos", "first", "last", "until"]
        for b in sliced(batches):
            ids, found = [np.empty(0, np.int64)], [[np.empty(0, np.int64)] for _ in range(5)]
            for i, t in enumerate(b.column(2)):
                own = chain_heads(t.as_py(), length, gram)
                ids.append(np.full(len(own[0]), i))
                for f, x in zip(found, own):
                    f.append(x)
            take = pa.array(np.concatenate(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(np.concatenate(f), pa.int64()) for f in found)], names)

    return docs.where(F.octet_length("bytes") >= length).select("doc_id", "rank", "bytes").mapInArrow(run, "doc_id long, rank int, h long, pos long, first long, last long, until long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes that an anchor's windows span: ``(h, n, doc_id, rank, pos, first, before, after)``."""
    per_doc = wanted.groupBy("doc_id", "rank").agg(F.collect_list(F.struct("h", "pos", "first", "last")).alias("found"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "i", "rank": "r"})
    both = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("rank") == F.col("r"))).select("doc_id", "rank", "bytes", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "doc_id", "rank", "pos", "before", "after"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for b in sliced(batches):
            for i in range(b.num_rows):
                doc, rank, text = (b.column(k)[i].as_py() for k in range(3))
                found = b.column(3)[i].values
                for k in range(0, len(found), 2000):
                    h, pos, first, last = (found.field(j).slice(k, 2000).to_pylist() for j in range(4))
                    before, after = [text[f:p][::-1] for f, p in zip(first, pos)], [text[p : z + length] for p, z in zip(pos, last)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h, [doc] * len(h), [rank] * len(h), pos, before, after), kinds)], names)

    return both.mapInArrow(run, "h long, doc_id long, rank int, pos long, before binary, after binary")


def _spans_of_groups(cut: DataFrame, length: int) -> DataFrame:
    """Repeated ranges, from groups that are brought together by hash and read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        out: list[tuple] = []
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())

        def full(force: bool = False) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], SPAN_NAMES)
                out.clear()

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(6)]
            for h, *row in zip(*columns):
                if h != now:
                    if len(held) > 1:
                        out.extend(_group(held, length))
                        yield from full()
                    held, now = [], h
                held.append(tuple(row))
        if len(held) > 1:
            out.extend(_group(held, length))
        yield from full(True)

    return cut.repartition("h").sortWithinPartitions("h").mapInArrow(run, SPAN_SCHEMA)


def _spans_of_windows(cut: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of very large groups, without gathering one.

    Equal contexts become one class with a count by partial aggregation; the
    windows of each class are hashed and counted; what counts to more than one
    goes back to the class and from there to its rows.
    """
    cut = cut.select("doc_id", "rank", "h", "pos", "before", "after", F.md5(F.concat(F.md5("before"), F.md5("after"))).alias("context"))
    classes = cut.groupBy("h", "context").agg(F.count("*").alias("c"), F.first("before").alias("before"), F.first("after").alias("after"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, context, c, before, after in zip(*(b.column(k).to_pylist() for k in range(5))):
                text = before[::-1] + after
                w = [hashlib.blake2b(text[s : s + length], digest_size=16).digest() for s in range(len(text) - length + 1)]
                n = len(w)
                columns = [pa.array([h] * n, pa.int64()), pa.array([context] * n, pa.string()), pa.array([c] * n, pa.int64()), pa.array(range(len(before), len(before) - n, -1), pa.int64()), pa.array(w, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "context", "c", "t", "w"])

    windows = classes.mapInArrow(split, "h long, context string, c long, t long, w binary")
    often = windows.groupBy("w").agg(F.sum("c").alias("times")).where("times > 1").drop("times")
    # a context of its own has one row to go back to; one that several rows share repeats whole, and they need no list
    hits = windows.where("c = 1").join(often, "w").groupBy("h", "context").agg(F.collect_set("t").alias("ts"))
    shared = classes.where("c > 1").select("h", "context", F.lit(True).alias("many"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = cut.withColumn("salt", F.pmod(F.hash("doc_id", "rank", "pos"), F.lit(SALTS))).join(shared, ["h", "context", "salt"], "left")
    whole = marked.where("many").select("doc_id", "rank", (F.col("pos") - F.octet_length("before")).alias("start"), (F.col("pos") + F.octet_length("after")).alias("end"))
    alone = marked.where("many is null").select("doc_id", "rank", "h", "pos", "context").join(hits, ["h", "context"]).select("doc_id", "rank", "pos", "ts")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, r, a, z) for d, r, pos, ts in zip(*(b.column(k).to_pylist() for k in range(4))) for a, z in merged([(pos - t, pos - t + length) for t in ts])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], SPAN_NAMES)

    return alone.mapInArrow(ranges, SPAN_SCHEMA).union(whole)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """``(doc_id, rank, start, end)``: byte ranges of ``docs(doc_id, rank, bytes)`` covered by repeated strings.

    Ranges may overlap. ``rank`` tells rows of one doc_id apart.
    """
    found = staged(_anchors_of(docs, length, gram), "anchors")
    often = staged(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    most = often.agg(F.max("n")).first()[0] or 0
    spans = _spans_of_groups(_contexts(docs, found.join(often.where(F.col("n") <= large).drop("n"), "h"), length), length)
    if most > large:
        spans = spans.union(_spans_of_windows(_contexts(docs, found.join(often.where(F.col("n") > large).drop("n"), "h"), length), length))
    return spans.union(found.where("until > 0").select("doc_id", "rank", F.col("first").alias("start"), F.col("until").alias("end")))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """Cut every byte that a ``length``-byte string covers which also starts elsewhere.

    Texts of ``docs(doc_id, text)`` are UTF-8 bytes; strings are judged on the
    input, overlaps count, and strings never cross documents.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary, what remains,
    joined), ``kept_text`` (the same as text, without the parts of a character
    that a cut has left) and ``spans`` (maximal removed runs, as byte offsets).

    A null text is an empty one. Rows are documents of their own even if they
    share a doc_id (null included); rows that share doc_id and text are copies
    of each other, so all they have in common goes. Texts shorter than
    ``length`` are kept. Extra columns are not looked at; an empty table gives
    no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("bytes"), F.hash(text).alias("rank"))
    spans = repeated_spans(rows, length, gram, large)
    per_doc = spans.groupBy("doc_id", "rank").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "i", "rank": "r"})
    both = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("rank") == F.col("r")), "left").select("doc_id", "bytes", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sizes, removed, kept, runs = [], [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = merged([(x["start"], x["end"]) for x in s or ()])
                edges = [0, *(x for g in gone for x in g), len(t)]
                kept.append(b"".join(t[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
                runs.append([{"start": a, "end": z} for a, z in gone])
                sizes.append(len(t))
                removed.append(len(t) - len(kept[-1]))
            counts = [pa.array(x, pa.int64()) for x in (sizes, removed, [len(r) for r in runs])]
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(kept, pa.binary()), texts, pa.array(runs, kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "spans"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, spans array<struct<start:bigint,end:bigint>>")
