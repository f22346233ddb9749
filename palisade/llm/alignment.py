"""Alignment of two tokenizers over a corpus: which tokens of one overlap which of the other, and how often.

Both token lists of a text cut the same bytes, so they are aligned by walking
along both; where both end at once, a group ends. How often two ids meet is
counted over documents, and each document is told how many of its meetings are
those that its first tokenizer's ids have most often.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import short_batches, sliced
from palisade.sources.scratch import staged

#: Units, of at most so many characters, whose alignment a worker remembers.
SHORT, REMEMBERED = 48, 1 << 17
#: Pairs of ids that have more than one in so many postings go to the postings; so at most so many do.
OFTEN = 1 << 16
#: How the byte-level tokenizer splits a text (a fixed value of its library).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Neither tokenizer looks across a space between two characters that are none: units are what stands between such spaces.
UNIT_EDGE = re.compile(r"(?<=\S) (?=\S)")


MISSING = object()


def units_of(text: str) -> list[str]:
    """The units of a text, without the space before each (the first one's is put there)."""
    parts = text.split(" ")
    if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
        return parts
    first, *others = UNIT_EDGE.split(f" {text}")
    return [first[1:], *others]


class Unit(NamedTuple):
    """The alignment of one unit: counts, groups as text, and the id pairs that overlap (first << 32 | second)."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: tuple[int, ...]


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that a byte-level vocabulary writes it as: visible bytes stand for themselves, the others for characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [n for n in range(256) if n not in set(visible)]
    return {chr(n): n for n in visible} | {chr(256 + k): n for k, n in enumerate(hidden)}


class Aligner:
    """Two tokenizers: a byte-level one of library ``tokenizers``, and a ``sentencepiece`` model that puts a space before the text."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(bytes_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.a_bytes = {n: bytes(map(alphabet.__getitem__, t)) for t, n in model["vocab"].items()}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.quick = None
        if made == sorted(made):  # merges in the order of ids: ids are ranks, and a library for those is faster
            self.quick = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks={b: n for n, b in self.a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on after a space: texts cannot be taken apart at spaces")
        self._known: dict[str, Unit | None] = {}
        self._older: dict[str, Unit | None] = {}

    def a_ids(self, unit: str) -> list[int]:
        """The first tokenizer's ids of a space and the unit."""
        if self.quick and len(unit) <= SHORT:
            return self.quick.encode_ordinary(f" {unit}")
        return self.a.encode(f" {unit}", add_special_tokens=False).ids

    def b_ids(self, units: list[str]) -> list[list[int]]:
        """The second tokenizer's ids of units, which it puts a space before itself."""
        found = self.b.encode(units, num_threads=1)
        return [f if u else [self.space] for u, f in zip(units, found)]

    def aligned(self, unit: str, a: list[int], b: list[int]) -> Unit | None:
        """The alignment of a space and the unit; none if the tokens' bytes are not the text's."""
        a_bytes, b_bytes = [self.a_bytes[n] for n in a], [self.b_bytes[n] for n in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + unit.encode("utf-8", "replace"):
            return None
        links, groups = [], []
        i = j = i_from = j_from = 0
        ahead = len(a_bytes[0]) - len(b_bytes[0])  # bytes that the first one's tokens, with the current, are longer than the second's
        while i < len(a):
            links.append(a[i] << 32 | b[j])
            if ahead == 0:
                one = i == i_from and j == j_from
                groups.append(f"{a[i]}|{b[j]}" if one else f"{','.join(map(str, a[i_from : i + 1]))}|{','.join(map(str, b[j_from : j + 1]))}")
                i, j = i + 1, j + 1
                i_from, j_from = i, j
                if i < len(a):
                    ahead = len(a_bytes[i]) - len(b_bytes[j])
            elif ahead < 0:
                i += 1
                ahead += len(a_bytes[i])
            else:
                j += 1
                ahead -= len(b_bytes[j])
        return Unit(len(a), len(b), len(groups), ";".join(groups), tuple(links))

    def texts(self, texts: list[str | None]) -> list[list[Unit]]:
        """The aligned units of whole texts; none for a null or empty one, and for one whose tokens' bytes differ."""
        split = [units_of(t) if t else [] for t in texts]
        found: dict[str, Unit | None] = {}
        new = []
        for units in split:
            for u in set(units).difference(found):
                known = self._known.get(u, MISSING)
                if known is MISSING:
                    known = self._older.get(u, MISSING)
                    if known is MISSING:
                        known = None
                        new.append(u)
                    else:
                        self._known[u] = known
                found[u] = known
        for u, b in zip(new, self.b_ids(new) if new else []):
            found[u] = self.aligned(u, self.a_ids(u), b)
            if len(u) <= SHORT:
                self._known[u] = found[u]
        if len(self._known) >= REMEMBERED:
            self._older, self._known = self._known, {}
        out = [list(map(found.__getitem__, units)) for units in split]
        return [[] if None in units else units for units in out]


@lru_cache(2)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """A worker reads the vocabularies once."""
    return Aligner(bytes_path, pieces_path)


def alignments(docs: DataFrame, bytes_path: str, pieces_path: str, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups, links, times)`` of every whole text of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids between places where both end; with
    ``digest`` its SHA-256 (of a text with tokens) instead. ``links`` are the
    different overlapping pairs (first id << 32 | second), ``times`` how often each
    occurs. Texts that are null, empty, or whose tokens' bytes are not the text's
    (with a space before it) have zeros and empty values. Rows keep to themselves;
    ids may be null or repeated, and other columns are left out.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        both = aligner(bytes_path, pieces_path)
        for b in sliced(batches):
            numbers, groups, links, times, ends = [], [], [], [], [0]
            for units in both.texts(b.column(1).to_pylist()):
                n_a, n_b, n_groups, texts, pairs = zip(*units) if units else [()] * 5
                joined = ";".join(texts)
                groups.append(sha256(joined.encode()).hexdigest() if digest and units else joined)
                pairs, n = np.unique(np.fromiter(chain.from_iterable(pairs), np.int64), return_counts=True)
                numbers.append((sum(n_a), sum(n_b), sum(n_groups), int(n.sum())))
                links.append(pairs)
                times.append(n)
                ends.append(ends[-1] + len(n))
            offsets = pa.array(ends, pa.int32())
            listed = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(k))) for x, k in ((links, np.int64), (times, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*numbers)), pa.array(groups, pa.string()), *listed], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"])

    kind = rows.schema["id"].dataType.simpleString()
    return short_batches(rows).mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>").withColumnRenamed("id", id)


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(pair, n, best)``: in how many of ``postings(row, pair, times)`` a pair is, and whether no other pair of its first id is in more.

    Pairs are counted before they are shuffled, and the maximum of an id is taken over counts, at
    most as many as the second vocabulary has ids.
    """
    counts = postings.groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def contributions(postings: DataFrame, counts: DataFrame, often: int = OFTEN) -> DataFrame:
    """``(row, n_best, count_sum)`` of ``postings(row, pair, times)``, from staged ``counts(pair, n, best)``.

    Postings and counts meet as streams that are shuffled by their ids, sorted,
    and spill. Pairs with more than one in ``often`` of all postings, which are
    at most ``often``, do not take part in that: their counts go to the postings,
    so no id is too large for a task, however common. A document's sums
    are made before and after they are shuffled by document.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > total / often)
    sums = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    served = postings.join(F.broadcast(hot), "pair").groupBy("row").agg(*sums)
    other = postings.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
    met = other.hint("merge").join(counts.where(F.col("n") <= total / often), "pair").groupBy("row").agg(*sums)
    return served.unionByName(met).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, bytes_path: str, pieces_path: str, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of every whole text of ``docs``; see ``alignments``.

    A pair's count is the number of rows of ``docs`` in which it is linked.
    ``n_best`` counts the links whose pair has the highest count of all pairs of
    its first id (ties included); ``count_sum`` adds the counts over all links.
    """
    own = staged(alignments(docs, bytes_path, pieces_path, id, text, digest).withColumn("row", F.monotonically_increasing_id()), "alignments")
    postings = own.select("row", F.explode(F.arrays_zip("links", "times")).alias("p")).select("row", F.col("p.links").alias("pair"), F.col("p.times").alias("times"))
    counts = staged(pair_counts(postings), "pair-counts")
    out = own.drop("links", "times").join(contributions(postings, counts), "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(id, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
