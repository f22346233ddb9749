"""Hits of many queries in a block of passages, by counting in bits.

A token's passages are a row of bits. The rows of a query's tokens are added by
full adders, 64 passages a word, into planes: plane ``p`` has bit ``p`` of each
passage's number of hits. The first passages are read off the planes from the top.
Where it is known how many hits a query's first passages have at least, few passages
can have as many: they are listed by the query's rarest tokens, and looked up in the
rows of the others. Everything here is a step on one block; Spark deals blocks and queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words that a step works on (what a core's cache holds), and queries whose rare tokens get their rows of bits together.
STEP_WORDS, CHUNK = 1 << 14, 256
#: A token that one passage in so many has keeps its row of bits.
DENSE = 128
#: Listed places of queries that go together, and the share of a block's passages up to which listing is less work than counting.
LISTED, SHARE = 1 << 20, 1 / 4

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(rows: np.ndarray, lists: np.ndarray) -> list[np.ndarray]:
    """Planes (queries x words, lowest first) of the sums of ``rows[lists[:, n]]`` over ``n``."""
    waiting: list[list[np.ndarray]] = [[]]

    def add(x: np.ndarray, level: int) -> None:
        while True:
            if level == len(waiting):
                waiting.append([])
            own = waiting[level]
            own.append(x)
            if len(own) < 3:
                return
            a, b, c = own
            half = a ^ b
            x = (a & b) | (half & c)
            waiting[level] = [half ^ c]
            level += 1

    for n in range(lists.shape[1]):
        add(rows.take(lists[:, n], axis=0), 0)
    level = 0
    while level < len(waiting):
        if len(waiting[level]) == 2:
            a, b = waiting[level]
            waiting[level] = [a ^ b]
            add(a & b, level + 1)
        level += 1
    return [w[0] for w in waiting if w]


def first(found: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, passage, hits) of each query's first ``k`` passages by falling hits, then place, and of few more; passages without a hit are not among them."""
    above, level = np.zeros_like(found[0]), np.full_like(found[0], ONES)
    n_above, any_ = np.zeros(len(above), np.int64), np.zeros(len(above), bool)
    for plane in reversed(found):
        both = level & plane
        n = n_above + np.bitwise_count(both).sum(1, dtype=np.int64)
        enough = n >= k
        mask = np.where(enough, ONES, np.uint64(0))[:, None]
        above |= both & ~mask
        level &= ~(plane ^ mask)
        n_above = np.where(enough, n_above, n)
        any_ |= enough
    # of those that have just as many hits as the last, as many as are wanted, from the front
    before = np.bitwise_count(level).cumsum(1, dtype=np.int64)
    level[:, 1:][before[:, :-1] >= (k - n_above)[:, None]] = 0
    level[~any_] = 0
    above |= level
    who, word = np.nonzero(above)
    one, bit = np.nonzero(above[who, word][:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
    who, word = who[one], word[one]
    hits = np.zeros(len(who), np.int64)
    for p, plane in enumerate(found):
        hits |= (plane[who, word] >> bit.astype(np.uint64) & np.uint64(1)).astype(np.int64) << p
    return who, word * 64 + bit, hits


class Block:
    """The tokens of ``size`` passages: ``(token, place)`` of each that a query may ask for, tokens as numbers below ``n_tokens``."""

    def __init__(self, token: np.ndarray, place: np.ndarray, size: int, n_tokens: int):
        shift = max(size - 1, 1).bit_length()
        # in place: a block of long passages has millions of tokens
        both = np.left_shift(token, shift, dtype=np.int64)
        both |= place
        both.sort()
        self.place = both.astype(np.uint32)
        self.place &= np.uint32((1 << shift) - 1)
        both >>= shift
        self.words = -(-size // 64)
        self.count = np.bincount(both, minlength=n_tokens)
        del both
        self.start = np.r_[0, np.cumsum(self.count)]
        often = np.flatnonzero(self.count * DENSE >= max(size, DENSE))
        self.row = np.full(n_tokens + 1, -1)
        self.row[often] = np.arange(len(often))
        # the last row is of ones
        self.dense = np.concatenate([self.bits(often), np.full((1, self.words), ONES)])
        self.bytes = self.dense.astype("<u8", copy=False).view(np.uint8).reshape(-1)

    def bits(self, tokens: np.ndarray) -> np.ndarray:
        """A row of bits for each of ``tokens``, which differ."""
        out = np.zeros(len(tokens) * self.words, np.uint64)
        n = self.count[tokens]
        if n.sum():
            at = np.arange(n.sum()) + np.repeat(self.start[tokens] - np.r_[0, np.cumsum(n)[:-1]], n)
            place = self.place[at]
            word = np.repeat(np.arange(len(tokens)), n) * self.words + (place >> np.uint32(6))
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[begin]] = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint32(63)).astype(np.uint64), begin)
        return out.reshape(len(tokens), self.words)

    def best(self, tokens: np.ndarray, sizes: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, place, hits), as ``first`` gives them, of queries with ``sizes`` tokens each; ``tokens`` may have -1 for those that no passage has."""
        query = np.repeat(np.arange(len(sizes)), sizes)
        known = (tokens >= 0) & (self.count[tokens] > 0)
        query, tokens = query[known], tokens[known]
        n = np.bincount(query, minlength=len(sizes))
        start = np.r_[0, np.cumsum(n)]
        # queries of about as many tokens go together
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        for a in range(0, len(order), CHUNK):
            yield from self._chunk(order[a : a + CHUNK], tokens, n, start, k)

    def at_least(self, tokens: np.ndarray, sizes: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As ``best``, of those that have ``floor`` hits or more (one for each query); others may be among them.

        A passage with so many hits has one of the query's tokens when ``floor - 1`` are left out. The
        most frequent are, so those that have another are few, and these are looked up in the
        rows of the left out ones, rarest first, until they cannot reach ``floor`` any more.
        """
        query = np.repeat(np.arange(len(sizes)), sizes)
        known = (tokens >= 0) & (self.count[np.maximum(tokens, 0)] > 0)
        query, tokens = query[known], tokens[known]
        order = np.lexsort((tokens, self.count[tokens], query))
        tokens = tokens[order]
        n, need = np.bincount(query, minlength=len(sizes)), np.maximum(floor, 1)
        start = np.r_[0, np.cumsum(n)]
        # what has no row is listed
        sparse = np.bincount(query, weights=self.row[tokens] < 0, minlength=len(sizes)).astype(np.int64)
        n_listed = np.maximum(n - need + 1, sparse)
        total = np.r_[0, np.cumsum(self.count[tokens])]
        listed = np.where(n >= need, total[start[:-1] + np.minimum(n_listed, n)] - total[start[:-1]], 0)
        often = np.flatnonzero(listed > self.words * 64 * SHARE)
        if len(often):
            at = np.arange(n[often].sum()) + np.repeat(start[often] - np.r_[0, np.cumsum(n[often])[:-1]], n[often])
            for who, place, hits in self.best(tokens[at], n[often], k):
                yield often[who], place, hits
        few = np.flatnonzero((listed > 0) & (listed <= self.words * 64 * SHARE))
        ends = np.cumsum(listed[few])
        a = 0
        while a < len(few):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LISTED, "right")))
            own = few[a:z]
            yield self._listed(own, tokens, start[own], n[own], n_listed[own], need[own])
            a = z

    def _listed(self, own: np.ndarray, tokens: np.ndarray, start: np.ndarray, n: np.ndarray, n_listed: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shift = max(self.words * 64 - 1, 1).bit_length()
        kind = np.uint32 if len(own) << shift < 1 << 32 else np.uint64
        # the rows that are looked up, and one of ones where there are no more
        n_left = n - n_listed
        rows = np.full((len(own), n_left.max() + 1), len(self.dense) - 1)
        at = np.arange(n_left.sum()) - np.repeat(np.cumsum(n_left) - n_left, n_left)
        who = np.repeat(np.arange(len(own)), n_left)
        rows[who, at] = self.row[tokens[(start + n_listed)[who] + at]]
        rows *= self.words * 8
        at = np.arange(n_listed.sum()) + np.repeat(start - np.r_[0, np.cumsum(n_listed)[:-1]], n_listed)
        some, who = tokens[at], np.repeat(np.arange(len(own), dtype=kind) << kind(shift), n_listed)
        both = np.concatenate([self.place[a:z] for a, z in zip(self.start[some].tolist(), self.start[some + 1].tolist())], dtype=kind, casting="unsafe")
        both |= np.repeat(who, self.count[some])
        both.sort()
        begin = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        hits = np.diff(begin, append=len(both))
        both = both[begin]
        # how many of those left a passage may still lack
        spare = hits + (n_left - need)[both >> kind(shift)]
        for step in range(rows.shape[1]):
            keep = np.flatnonzero(spare >= 0)
            both, spare = both[keep], spare[keep]
            who, place = both >> kind(shift), both & kind((1 << shift) - 1)
            bits = self.bytes[rows[who, step] + (place >> kind(3))]
            spare -= 1 - (bits >> (place & kind(7)).astype(np.uint8) & 1).astype(np.int64)
        who = (both >> kind(shift)).astype(np.int64)
        return own[who], (both & kind((1 << shift) - 1)).astype(np.int64), spare + need[who]

    def _chunk(self, own: np.ndarray, tokens: np.ndarray, n: np.ndarray, start: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = np.arange(n[own].sum()) + np.repeat(start[own] - np.r_[0, np.cumsum(n[own])[:-1]], n[own])
        asked = np.unique(tokens[at])
        rare = asked[self.row[asked] < 0]
        # rare tokens by the chunk, in as many queries as rows of bits fit
        if len(own) > 1 and len(rare) * self.words > 64 * STEP_WORDS * 4:
            half = len(own) // 2
            yield from self._chunk(own[:half], tokens, n, start, k)
            yield from self._chunk(own[half:], tokens, n, start, k)
            return
        rows = np.concatenate([self.dense[self.row[asked[self.row[asked] >= 0]]], self.bits(rare), np.zeros((1, self.words), np.uint64)])
        number = np.concatenate([asked[self.row[asked] >= 0], rare])
        by = np.argsort(number)
        step = max(1, STEP_WORDS // self.words)
        for a in range(0, len(own), step):
            some = own[a : a + step]
            lists = np.full((len(some), n[some].max()), len(number))
            size = n[some]
            who = np.repeat(np.arange(len(some)), size)
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            lists[who, nth] = by[np.searchsorted(number, tokens[np.repeat(start[some], size) + nth], sorter=by)]
            q, place, hits = first(planes(rows, lists), k)
            yield some[q], place, hits
