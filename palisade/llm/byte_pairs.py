"""Byte-level BPE over a rank table: encoding by prefix, decoding, exact appends and edits.

A byte string's merges end in one token list, and every prefix of the string has
a list of its own. The last token of a prefix decides it: it is the only token
that ends there and that, put after the last token of the prefix before it, is
left alone by the merges. So one table, the last token of each byte prefix, holds
the lists of all prefixes. It grows by appending, and after an edit only prefixes
near the edit change.

Texts are first split by a pattern, and each match is a byte string of its own;
a match depends on no character before it and on at most two after it, so an edit
reaches few matches.
"""

from __future__ import annotations

import base64
import bisect
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import short_batches, sliced

#: Characters after a match that may have decided where it ends.
LOOK_AHEAD = 2
#: Matches of at most so many bytes, and so many of them, whose tokens a worker remembers.
SHORT, REMEMBERED = 48, 1 << 18
#: Bytes of a match's beginning whose prefixes a worker remembers, since many words share one; and how many of them.
HEAD, HEADS = 7, 1 << 17

#: First and last of the letters and numbers that Unicode added after version 16.
#: The library whose results are to be met splits them off as other characters.
ADDED_SINCE = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_ADDED = regex.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in ADDED_SINCE) + "]")
_FIRST_ADDED = chr(ADDED_SINCE[0][0])
#: A character of no Unicode version, to stand for those while a text is split.
_UNASSIGNED = "͸"


def latin(pattern: str) -> re.Pattern | regex.Pattern:
    """The pattern for texts of the first 256 characters: classes of letters, numbers and white space written out, for the faster library."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(name, chr(c)))
        pattern = regex.sub(rf"(\[[^\]]*){regex.escape(name)}", lambda m, x=inside: m[1] + x, pattern).replace(name, f"[{inside}]")
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{inside}]")
    # other classes differ between the libraries
    return regex.compile(pattern) if regex.search(r"\\[^x]", pattern) else re.compile(pattern)


class Encoded(NamedTuple):
    """A text's token ids, and of each match the characters and tokens it has."""

    ids: list[int]
    chars: list[int]
    tokens: list[int]


def _list(packed: list[bytes]) -> list[int]:
    return array("i", b"".join(packed)).tolist()


def _counts(packed: list[bytes]) -> list[int]:
    return [len(p) // 4 for p in packed]


class Encoder:
    """Encodes by the ranks of a ``.tiktoken`` file (base64 token and rank a line) and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {n: b for b, n in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.pattern = regex.compile(pattern)
        self.latin = latin(pattern)
        self.never = len(self.rank) + 256
        self.stays = lru_cache(1 << 18)(self._stays)
        self._edges: dict[bytes, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]] = {}
        # token ids are remembered as the bytes of 32-bit numbers, which join at once
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._heads: dict[bytes, list[int]] = {}
        self._places: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merged(self, b: bytes, down_to: int = 1) -> list[bytes]:
        """The parts that the merges leave of ``b``: again and again the pair of least rank, the first of equals."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > down_to:
            ranks = [self.rank.get(x + y, self.never) for x, y in zip(parts, parts[1:])]
            at = ranks.index(min(ranks))
            if parts[at] + parts[at + 1] not in self.rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: bytes) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts that ``token`` ends with, and those that it begins with, while it is merged, each with the rank of the merge that takes it in."""
        found = self._edges.get(token)
        if found is None:
            ends, begins = [], []
            if len(token) > 1:
                left, right = self.merged(token, 2)
                taken = self.rank[token]
                ends = [(part, min(by, taken)) for part, by in self.edges(right)[0]]
                begins = [(part, min(by, taken)) for part, by in self.edges(left)[1]]
            found = self._edges[token] = ([*ends, (token, self.never)], [*begins, (token, self.never)])
        return found

    def _stays(self, before: int, token: int) -> bool:
        """Whether two tokens are what the merges make of their bytes: no merge across their border comes before those on its sides.

        Of merges of one rank the first in the text comes first.
        """
        for end, taken in self.edges(self.bytes_of[before])[0]:
            for begin, taken_too in self.edges(self.bytes_of[token])[1]:
                across = self.rank.get(end + begin)
                if across is not None and across < taken and across <= taken_too:
                    return False
        return True

    def _grow(self, b: bytes, last: list[int], until: int) -> None:
        """Append the last tokens of the prefixes of ``b`` up to ``until`` to those of the shorter ones."""
        rank, stays, longest = self.rank.get, self.stays, self.longest
        for end in range(len(last), until + 1):
            for at in range(end - 1, max(-1, end - longest - 1), -1):
                token = rank(b[at:end])
                if token is not None and (at == 0 or stays(last[at], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the rank table lacks single bytes")

    def prefixes(self, b: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of ``b`` (first that of none, -1); ``last`` are those of a beginning of ``b``."""
        last = [-1] if last is None else list(last)
        self._grow(b, last, len(b))
        return last

    def prefixes_after(self, b: bytes, last: list[int], start: int, removed: int, inserted: int) -> list[int]:
        """``prefixes(b)``, given those of the string that ``b`` was before ``removed`` bytes at ``start`` gave way to ``inserted``.

        Once as many prefixes in a row as the longest token has bytes are as before, all further ones are.
        """
        new, moved, alike = last[: start + 1], inserted - removed, 0
        self._grow(b, new, start + inserted)
        for end in range(start + inserted + 1, len(b) + 1):
            self._grow(b, new, end)
            alike = alike + 1 if new[end] == last[end - moved] else 0
            if alike >= self.longest:
                return new + last[end - moved + 1 :]
        return new

    def tokens_of(self, last: list[int]) -> list[int]:
        """The token list of the whole string, from the last tokens of its prefixes."""
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def _ids(self, match: str) -> bytes:
        """Token ids of a match that is not remembered, packed."""
        b = match.encode("utf-8", "replace")
        head = b[:HEAD]
        last = self._heads.get(head)
        if last is None:
            if len(self._heads) >= HEADS:
                self._heads.clear()
            last = self._heads[head] = self.prefixes(head)
        return array("i", self.tokens_of(self.prefixes(b, last))).tobytes()

    def ids_of(self, matches: list[str]) -> list[bytes]:
        """Token ids of each match, packed."""
        found = list(map(self._known.get, matches))
        if None in found:
            for n, ids in enumerate(found):
                if ids is None:
                    match = matches[n]
                    ids = self._older.get(match)
                    found[n] = ids = self._ids(match) if ids is None else ids
                    if len(match) <= SHORT:
                        self._known[match] = ids
            if len(self._known) >= REMEMBERED:
                self._older, self._known = self._known, {}
        return found

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        most = "" if text.isascii() else max(text)
        if most < "\u0100":
            return self.latin.findall(text)
        if most < _FIRST_ADDED or not _ADDED.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_ADDED.sub(_UNASSIGNED, text))]

    def encode(self, text: str) -> Encoded:
        matches = self.split(text)
        found = self.ids_of(matches)
        return Encoded(_list(found), list(map(len, matches)), _counts(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many tokens, and where each one's end."""
        if self._places is None:
            sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
            for n, b in self.bytes_of.items():
                sizes[n] = len(b)
            self._places = np.frombuffer(b"".join(self.bytes_of.get(n, b"") for n in range(len(sizes))), np.uint8), np.cumsum(sizes) - sizes, sizes
        table, first, size = self._places
        sizes = size[ids]
        if len(ids) and not sizes.all():
            raise ValueError("an id is not in the rank table")
        ends = np.cumsum(sizes)
        return table[np.repeat(first[ids] - ends + sizes, sizes) + np.arange(sizes.sum())], ends

    def edit(self, text: str, done: Encoded, start: int, removed: int, inserted: str) -> tuple[str, Encoded]:
        """``text`` with ``inserted`` in place of ``removed`` characters at ``start``, and ``encode`` of it.

        An append is an edit at the end. Matches that ended ``LOOK_AHEAD`` characters
        before the edit stay; those after it are taken over from where a match
        begins at the same character as before.
        """
        start = min(max(start, 0), len(text))
        removed = min(max(removed, 0), len(text) - start)
        new = text[:start] + inserted + text[start + removed :]
        ends, first = [0], [0]
        for c, t in zip(done.chars, done.tokens):
            ends.append(ends[-1] + c)
            first.append(first[-1] + t)
        stay = max(bisect.bisect_right(ends, start - LOOK_AHEAD) - 1, 0)
        ids, chars, tokens = done.ids[: first[stay]], done.chars[:stay], done.tokens[:stay]
        at, moved = ends[stay], len(inserted) - removed
        # a window of the new text, longer each time, until a match in its safe part begins where one began before
        width = len(inserted) + 256
        while True:
            rest, whole = new[at : at + width], at + width >= len(new)
            out, place = [], at
            for m in self.split(rest):
                old = place - moved
                n = bisect.bisect_left(ends, old)
                if place >= start + len(inserted) and n < len(ends) - 1 and ends[n] == old:
                    found = self.ids_of(out)
                    return new, Encoded(ids + _list(found) + done.ids[first[n] :], [*chars, *map(len, out), *done.chars[n:]], tokens + _counts(found) + done.tokens[n:])
                if not whole and place + len(m) + LOOK_AHEAD > at + width:
                    break
                out.append(m)
                place += len(m)
            else:
                if whole:
                    found = self.ids_of(out)
                    return new, Encoded(ids + _list(found), [*chars, *map(len, out)], tokens + _counts(found))
            width *= 4


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """A worker reads a rank table once."""
    return Encoder(path, pattern)


#: What ``encode`` gives beside the id.
ENCODED = "ids array<int>, match_chars array<int>, match_tokens array<int>"
_INTS = pa.list_(pa.int32())


def _lists(found: list[Encoded]) -> list[pa.Array]:
    return [pa.array([f[n] for f in found], _INTS) for n in range(3)]


def _listed(rows: list[np.ndarray]) -> pa.Array:
    """Rows of numbers as one array of lists."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", matches: bool = True) -> DataFrame:
    """``(id, ids, match_chars, match_tokens)`` of every whole text of ``docs``; a null text is an empty one.

    ``match_chars`` and ``match_tokens`` (left out without ``matches``) are the characters and tokens of each
    match of the pattern, by which ``edit`` finds its place. Special tokens'
    strings are ordinary text. Rows keep to themselves (no shuffle), ids may be
    null or repeated, and other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in sliced(batches):
            split = list(map(e.split, b.column(1).to_pylist()))
            found = list(map(e.ids_of, split))
            columns = [_listed([np.frombuffer(b"".join(f), "i4") for f in found])]
            if matches:
                columns += [_listed([np.fromiter(map(len, m), np.int32, len(m)) for m in split]), _listed([np.fromiter(map(len, f), np.int32, len(f)) // 4 for f in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "ids", "match_chars", "match_tokens"][: 1 + len(columns)])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, {ENCODED if matches else ENCODED.split(',')[0]}"
    return short_batches(rows).mapInArrow(run, schema).withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its tokens; null for null ids. An id that is not in the table is an error."""
    schema = encoded.drop("decoded").withColumn("decoded", F.lit(None).cast("binary")).schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in sliced(batches):
            own = b.column(ids)
            sizes = pc.fill_null(own.value_lengths(), 0).to_numpy()
            decoded, byte_ends = e.decode_all(own.flatten().to_numpy())
            ends = np.r_[0, byte_ends][np.r_[0, np.cumsum(sizes)]]
            made = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded)])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-1]), pc.if_else(own.is_valid(), made, None)], names)

    return short_batches(encoded.drop("decoded")).mapInArrow(run, schema)


def edit(encoded: DataFrame, edits: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text, ids, match_chars, match_tokens)`` after ``edits(id, start, removed, inserted)`` of encoded texts.

    ``encoded`` has the id, the text and what ``encode`` gives. The result is what
    ``encode`` gives of the new text, but only matches near the edit are encoded.
    Places count characters and are kept within the text; nulls are 0 or an empty
    string; an append starts at the text's end or beyond (``removed`` 0). A row
    of ``encoded`` without an edit is passed on; with several, each gives a row.
    """
    rows = encoded.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), "ids", "match_chars", "match_tokens")
    change = edits.select(F.col(id).alias("_id"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("start", "removed")), F.coalesce("inserted", F.lit("")).alias("inserted"))
    both = rows.join(change, F.col("id") == F.col("_id"), "left").drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in sliced(batches):
            out = []
            for r in b.to_pylist():
                done = Encoded(r["ids"], r["match_chars"], r["match_tokens"])
                out.append((r["text"], done) if r["start"] is None else e.edit(r["text"], done, r["start"], r["removed"], r["inserted"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), *_lists([d for _, d in out])], ["id", "text", "ids", "match_chars", "match_tokens"])

    return short_batches(both).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, {ENCODED}").withColumnsRenamed({"id": id, "text": text})


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text of ``docs``, encoded and decoded again."""
    out = decode(encode(docs, path, pattern, matches=False), path, pattern)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
