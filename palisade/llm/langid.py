"""Language ID with bit-sliced Bloom filters over character n-grams.

One Bloom filter holds all languages: each position has a bit mask with one bit
per language, and the AND of the masks at an n-gram's positions is the set of
languages that contain it. A text's n-grams give a popcount per language;
subtracting what the filter's measured false-positive rate would give by chance
leaves the evidence that decides.

The filter is fitted on a bounded sample and has a fixed size bound, so
prediction is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import short_batches, sliced
from palisade.sources.scratch import staged

#: Lengths of the n-grams, in characters; words are padded with one space.
ORDERS = (2, 3, 4)
#: Texts of a language that the filter is fitted on, in expectation.
SAMPLE = 4_000
#: A language contains an n-gram that makes up at least this share of its n-grams of that length,
#: so a language has at most 1 / SHARE n-grams of a length.
SHARE = 1e-5
#: Positions that an n-gram sets in the filter.
HASHES = 3
#: Filter positions for each stored n-gram.
ROOM = 12
UNKNOWN = "und"
#: N-grams that a worker holds before it counts them.
HELD = 1 << 22

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(text: str) -> dict[int, np.ndarray]:
    """Hashes of the n-grams of a text, by length.

    The text is lower-cased; everything but letters (and the marks that belong
    to them) becomes a space, and runs of spaces one. N-grams do not run over a
    space other than at their ends.
    """
    low = text.lower()
    kept = "".join(c if c.isalpha() else " " for c in set(low))
    table = {ord(a): b for a, b in zip(set(low), kept) if a != b}
    words = low.translate(table).split()
    if not words:
        return {}
    x = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = x == 32
    out = {}
    for n in ORDERS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        inside = np.zeros(len(h), bool)
        for k in range(n):
            h = h * _MULTIPLY + x[k : len(x) - n + 1 + k] + np.uint64(1)
            if 0 < k < n - 1:
                inside |= blank[k : len(x) - n + 1 + k]
        keep = ~inside
        if n == 2:
            keep &= ~(blank[:-1] & blank[1:])
        out[n] = _mix(h[keep])
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Filter:
    """A bit-sliced Bloom filter; ``slices[word, position]`` has 8 languages a word, or 64 if there are more."""

    languages: list[str]
    slices: np.ndarray
    #: Chance that an absent n-gram appears to be in each language.
    false: np.ndarray

    def bits(self) -> list[tuple[int, np.unsignedinteger]]:
        """Word and bit of each language."""
        kind, wide = self.slices.dtype.type, self.slices.dtype.itemsize * 8
        return [(i // wide, kind(1 << (i % wide))) for i in range(len(self.languages))]

    def positions(self, h: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(self.slices.shape[1])
        second = _mix(h * _MULTIPLY) | np.uint64(1)
        return [((h + np.uint64(k) * second) % size).astype(np.int64) for k in range(HASHES)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Per n-gram the languages that contain it: words of 64 bits by n-gram."""
        at = self.positions(h)
        out = self.slices[:, at[0]]
        for p in at[1:]:
            out &= self.slices[:, p]
        return out

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams it seems to contain."""
        m = self.masks(h)
        out = [np.count_nonzero(m[w] & bit) for w, bit in self.bits()]
        return np.array(out, float)

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> Filter:
        languages = sorted(members)
        size = max(1024, ROOM * sum(map(len, members.values())))
        kind, wide = (np.uint8, 8) if len(languages) <= 8 else (np.uint64, 64)
        f = cls(languages, np.zeros((max(1, -(-len(languages) // wide)), size), kind), np.zeros(len(languages)))
        for lang, (w, bit) in zip(languages, f.bits()):
            for p in f.positions(members[lang]):
                f.slices[w, p] |= bit
        f.false = np.array([(np.count_nonzero(f.slices[w] & bit) / size) ** HASHES for w, bit in f.bits()])
        return f

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        share = np.zeros(len(self.languages))
        for n, h in grams(text).items():  # type: ignore[arg-type]
            true = np.maximum(0, self.counts(h) - len(h) * self.false) / (1 - np.minimum(self.false, 0.99))
            share += true / len(h) * n
        total = share.sum()
        if total <= 0:
            return self.languages[0], 0.0
        # the margin of the best over an even split grows with how much of the text it explains
        odds = np.exp(12 * (share - share.max()) / sum(ORDERS))
        best = int(share.argmax())
        return self.languages[best], float(odds[best] / odds.sum() * min(1.0, share[best] / sum(ORDERS)) ** 0.5)


def fit(labelled: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> Filter:
    """A filter from ``labelled(doc_id, text, lang)``; rows with a null in text or lang are left out.

    About ``sample`` texts of each language are learnt from, those whose seeded
    hash is below a cut set by the language's count. Their n-gram counts are
    summed for each partition before they are shuffled, and only n-grams of at
    least ``share`` reach the driver: at most len(ORDERS) / share a language.
    """
    rows = short_batches(labelled).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filter.build({})
    top = 1 << 30
    cut = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(top, int(top * sample / n))))))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(top)) < cut[F.col("lang")])
    picked = picked.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[np.ndarray]] = {}
        held = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for (lang, n), parts in found.items():
                h, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h), pa.string()), pa.array([n] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["lang", "n", "h", "c"]
                )
            found.clear()

        for b in sliced(batches):
            for lang, text in zip(b.column(0), b.column(1)):
                for n, h in grams(text.as_py()).items():
                    found.setdefault((lang.as_py(), n), []).append(h)
                    held += len(h)
                if held > HELD:
                    yield from summed()
                    held = 0
        yield from summed()

    counts = picked.mapInArrow(count, "lang string, n int, h long, c long").groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    counts = staged(counts, "grams")
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    often = counts.join(totals, ["lang", "n"]).where(F.col("c") >= F.greatest(F.lit(2), share * F.col("total")))
    kept = often.select("lang", "h").toPandas()
    return Filter.build({k: g["h"].to_numpy(np.int64).view(np.uint64) for k, g in kept.groupby("lang")})


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 4, is 2 (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """Predict the language of each row of ``docs(doc_id, text[, lang])``.

    Without a ``model``, one is fitted on the rows that are not held out and
    have a lang. Returns ``doc_id, held_out, lang_pred, score``. Predictions
    read the whole text and nothing else.

    A null text, and one without any letter, is ``und`` with score 0; so is
    everything if nothing could be learnt. A null doc_id is not held out and is
    kept; equal texts get equal predictions; ties go to the first language in
    code point order; extra columns are not looked at; an empty table gives no
    rows.
    """
    rows = docs.select("doc_id", "text", *(["lang"] if model is None else []))
    if model is None:
        model = fit(rows.where(~held_out(F.col("doc_id"))))
    rows = predicted(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return rows.drop("text")


def predicted(docs: DataFrame, model: Filter) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` at the end; columns of these names are replaced."""
    rows = short_batches(docs).drop("lang_pred", "score")
    at = rows.columns.index("text")
    schema = rows.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [model.predict(t.as_py()) for t in b.column(at)]
            more = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
