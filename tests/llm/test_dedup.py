"""SimHash, line and suffix-array dedup against brute force."""

import hashlib
import os
import random
import time
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palisade.llm import lines, passages, simhash, substrings
from palisade.llm.common import connected_components
from tests.llm.data import LONG, awkward, documents


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps):
    """Smallest member reachable at 3 bits or fewer, for each different fingerprint."""
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {x: find(x) for x in u}


def test_simhash_rows(spark):
    rows = awkward()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    root = linked(fps)
    low = {}
    for (i, *_), f in zip(rows, fps):
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    want = Counter((i, f"{f:016x}", low.get(root[f])) for (i, *_), f in zip(rows, fps))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect())
    assert got == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_ball_links_lose_nothing(spark, seed):
    """Chains, balls and near misses around a few centres."""
    rng = random.Random(seed)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            y = x
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])) if rng.random() < 0.7 else [rng.choice([5, 6, 7]), 30, 31, 50][: rng.randint(1, 4)]:
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    signed = [(simhash._signed(x),) for x in fps]
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.ball_links(spark.createDataFrame(signed, "fp long")).collect()}
    groups: dict = {}
    for x, r in linked(fps).items():
        groups.setdefault(r, set()).add(x)
    mine: dict = {}
    for x in fps:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def similar(texts, least):
    """Smallest id that pairs of at least that Jaccard similarity reach."""
    root, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    groups = similar({n: t for n, (_, t, *_) in enumerate(awkward())}, 0.8)
    assert len(rows) == len(set(groups.values())) and len({r.text for r in rows}) == len(rows)
    assert not {20, 21, 22, 23, 25, 27} & {r.doc_id for r in rows} and {26, 30, 31} <= {r.doc_id for r in rows}
    assert simhash.keep_one(documents(spark, [])).count() == 0


def edited(rng, words, n):
    """A copy with n words changed, dropped or put in."""
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[f"new{rng.randrange(10**6)}"], [], [out[at], f"more{rng.randrange(10**6)}"]])
    return out


def test_near_copies_go_and_others_stay(spark):
    """Copies well above the similarity go, texts well below it stay, in groups from two to hundreds."""
    rng = random.Random(7)
    vocabulary = [f"w{n}" for n in range(3000)]
    texts = {}
    for size in [2] * 60 + [12, 300]:
        base = rng.choices(vocabulary, k=rng.randint(80, 400))
        for n in range(size):
            texts[len(texts)] = " ".join(edited(rng, base, len(base) // 60 if n else 0))
    passage = rng.choices(vocabulary, k=60)
    for _ in range(150):  # a shared passage is no copy
        texts[len(texts)] = " ".join(rng.choices(vocabulary, k=70) + passage + rng.choices(vocabulary, k=50))
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    high, low = similar(texts, 0.83), similar(texts, 0.7)
    copies = {i for i in texts if high[i] != i}
    assert len(copies) > 300 and len(copies - kept) / len(copies) > 0.97
    assert {i for i in texts if low[i] == i} <= kept


def test_copies_within_a_family_go(spark, monkeypatch):
    """Texts on one template are no copies, and do not hide the copies among them."""
    monkeypatch.setattr(simhash, "CELL", 40)
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(3000)]
    template, texts = rng.choices(vocabulary, k=280), {}
    for n in range(150):
        one = template + rng.choices(vocabulary, k=72)
        texts[2 * n], texts[2 * n + 1] = " ".join(one), " ".join(edited(rng, one, 3))
    high, low = similar(texts, 0.85), similar(texts, 0.75)
    copies = {i for i in texts if high[i] != i}
    assert len(copies) == 150 and high == low
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert len(copies - kept) / len(copies) > 0.97
    assert len({i for i in texts if low[i] == i} & kept) > 145


def test_near_others():
    rng = random.Random(4)
    sizes = [0, 1, 2, 5, 31, 32, 33, 70, 0]
    at, n = np.cumsum([0, *sizes]), sum(sizes)
    base = [rng.getrandbits(64) for _ in range(3)]
    fp = [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 9))) % 2**64 for _ in range(n)]
    comp = [rng.randrange(6) for _ in range(n)]
    want = [any((fp[i] ^ fp[j]).bit_count() <= 9 and comp[i] != comp[j] for a, z in zip(at, at[1:]) if a <= i < z for j in range(a, z)) for i in range(n)]
    got = simhash.near_others(at, np.array(fp, np.uint64).view(np.int64), np.array(comp), 9)
    assert got.tolist() == want and 0 < sum(want) < n


def test_bands():
    assert simhash.bits_for(0) == simhash.bits_for(100) == 16 and simhash.bits_for(10**9) == 30 + simhash.SPARE
    assert simhash.bands_for(30) > simhash.bands_for(24) > simhash.bands_for(24, 0.9) and simhash.bands_for(24, recall=0.99) > simhash.bands_for(24)
    assert abs(simhash.differing(1.0)) < 1e-6 and 0.15 < simhash.differing(0.8) < 0.153


def test_other_documents_change_no_decision(spark):
    """With bits given: families at similarities from 0.6 to 0.95, alone and among many unlike texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = []
    for family in range(40):
        base = [word() for _ in range(120)]
        for copy in range(3):
            own.append((1000 * family + copy, " ".join(w if rng.random() > 0.002 * family else word() for w in base), "en", "s"))
    others = [(10**6 + n, " ".join(word() for _ in range(30)), "en", "s") for n in range(3000)]
    alone = {r.doc_id for r in simhash.keep_one(documents(spark, own), bits=24).collect()}
    among = {r.doc_id for r in simhash.keep_one(documents(spark, own + others), bits=24).collect()}
    assert 40 < len(alone) < 120
    assert {d for d in among if d < 10**6} == alone and len(among) == len(alone) + 3000


def plain_lines(rows):
    """Kept text and removed line numbers of each row; rows of one id and text count once."""
    order = sorted({(r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1]).encode(), 42) if r[1] is not None else 0, r[0], r[1]) for r in rows}, key=lambda x: x[:2] + (x[2] - 2**64 if x[2] >> 63 else x[2],))
    seen, out = set(), {}
    for *_, i, t in order:
        gone = []
        for n, u in enumerate(t.split("\n") if t is not None else []):
            k = re.sub(r"[\x20\x09-\x0D]+", " ", u.lower()).strip(" ")
            if k and k in seen:
                gone.append(n)
            seen.add(k)
        out[i, t] = gone
    return out


def plain_passages(rows, n):
    """Words of each row that an equal run of n words covers which starts earlier; rows of one id and text count once."""
    rank = lambda t: (lambda x: x - 2**64 if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted({(r[0] is None, r[0] or 0, rank(r[1]), r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: x[:3])
    first, out = {}, {}
    for k, (*_, i, t) in enumerate(order):
        found = [(m.start(), m.end(), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        hit = [False] * len(found)
        for p in range(len(found) - n + 1):
            d, q = first.setdefault(tuple(w for *_, w in found[p : p + n]), (k, p))
            if d != k or p >= q + n:
                hit[p : p + n] = [True] * n
        spans = []
        for p, h in enumerate(hit):
            if h and p and hit[p - 1]:
                spans[-1][1] = found[p][1]
            elif h:
                spans.append([*found[p][:2]])
        out[i, t] = [tuple(s) for s in spans]
    return out


def within(seed):
    """Texts with passages that start and end within a line, copies, near copies and periodic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéX") for _ in range(rng.randint(1, 3)))
    some = lambda a, z: [word() + rng.choice(["", "", "", "\n", ",\t "]) for _ in range(rng.randint(a, z))]
    shared = [some(10, 40) for _ in range(5)]
    out = []
    for _ in range(60):
        parts = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(shared) if rng.random() < 0.5 else some(0, 30))]
        if out and rng.random() < 0.3:
            parts = rng.choice(out).split(" ")
            parts[rng.randrange(len(parts))] = word()
        out.append(" ".join(parts))
    return out + ["a b " * 60, "a b " * 59 + "c", "x " * 11, "x " * 12, "x\n" * 90, out[3], out[3], "  " + out[4].upper()]


@pytest.mark.parametrize(("seed", "n", "large"), [(0, 12, 5000), (1, 9, 5000), (2, 12, 20), (3, 9, 1)])
def test_passages(spark, seed, n, large, monkeypatch):
    """Every word of a repeated run goes, and no other."""
    monkeypatch.setattr(passages, "CHUNK", 50)
    rows = [(i if i % 17 else None, t, "en", "s") for i, t in enumerate(within(seed), 1)]
    docs = documents(spark, rows).select("doc_id", F.xxhash64("text").alias("rank"), "text")
    found, late = passages.repeated(docs, n, min(n, 8), large)
    ranges, whole = {}, {(r.doc_id, r.rank) for r in late.collect()}
    for r in found.collect():
        ranges.setdefault((r.doc_id, r.rank), []).append((r["first"], r["last"]))
    text = {(r.doc_id, r.rank): r.text for r in docs.collect()}
    got = {(i, t): passages.spans(t, ranges.get((i, k), []), (i, k) in whole, n) for (i, k), t in text.items()}
    want = plain_passages(rows, n)
    assert got == {k: v for k, v in want.items()} and sum(map(len, want.values())) > 30


def plain_cut(rows, n):
    """Kept text, removed lines and passages of each (id, text), character by character."""
    gone, again, out = plain_lines(rows), plain_passages(rows, n), {}
    for (i, t), drop in gone.items():
        if t is None:
            continue
        keep, at, parts = [True] * len(t), 0, t.split("\n")
        for k, p in enumerate(parts):
            if k in drop:
                z = at + len(p)
                tail = all(x in drop for x in range(k, len(parts)))
                for c in range(max(0, at - 1) if tail else at, min(len(t), z if tail else z + 1)):
                    keep[c] = False
            at += len(p) + 1
        for a, z in again[i, t]:
            keep[a:z] = [False] * (z - a)
        out[i, t] = "".join(c for c, k in zip(t, keep) if k), drop, again[i, t]
    return out


def test_lines_and_passages(spark):
    """What both take away, on the whole text."""
    rows = [*awkward(), *((100 + i, t, "en", "s") for i, t in enumerate(within(9)))]
    want, seen = {i: (t, w) for (i, t), w in plain_cut(rows, 12).items() if sum(x[0] == i for x in rows) == 1}, 0
    for r in lines.dedup(documents(spark, rows), passage=12).collect():
        if r.doc_id in want:
            t, (kept, drop, again) = want[r.doc_id]
            assert r.kept_text == kept == "".join(t[s.start : s.start + s.length] for s in r.kept_spans)
            assert r.n_removed == len(drop) and [(s.start, s.start + s.length) for s in r.passage_spans] == again and r.n_passages == len(again)
            seen += 1
    assert seen == len(want)


def test_lines(spark):
    rows = [*awkward(), (50, "line two\nfresh", "en", "s"), (51, "fresh\r\nFRESH \n", "en", "s")]
    want = plain_lines(rows)
    got = lines.dedup(documents(spark, rows), passage=None).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if sum(x[0] == r.doc_id for x in rows) == 1}
    for (i, t), gone in want.items():
        if i in by_id:
            r = by_id[i]
            parts = t.split("\n") if t is not None else []
            assert r.n_removed == len(gone) and r.n_units == len(parts)
            assert r.kept_text == (None if t is None else "\n".join(p for n, p in enumerate(parts) if n not in gone))
            assert [t[s.start : s.start + s.length] for s in r.removed_spans] == [parts[n] for n in gone]
            assert "".join(t[s.start : s.start + s.length] for s in r.kept_spans) == (r.kept_text or "")
    assert lines.dedup(documents(spark, [])).count() == 0
    paragraphs = {r.doc_id: r.kept_text for r in lines.dedup(documents(spark, [(1, "a\nb\n\nc", "en", "s"), (2, "x\n\na\nb", "en", "s")]), "paragraph").collect()}
    assert paragraphs == {1: "a\nb\n\nc", 2: "x"}


def test_cut(spark):
    docs = documents(spark, [(1, "a b\nc", "en", "s"), (2, "A  b\nd", "en", "s"), (3, "a b", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s")])
    out = lines.cut(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "a b\nc", 2: "d", 4: None, 5: ""}


def plain_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                hit[p : p + length] = True
        out.append((len(b), int(hit.sum()), int((np.diff(np.r_[False, hit].astype(int)) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


def deduped(spark, rows, **k):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in substrings.dedup(documents(spark, rows), **k).collect())


def noisy(seed):
    """Copies, edited copies, shifted passages and periodic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = []
    for _ in range(50):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 4))]
        t = "".join(parts)
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(["", "zz", "q"]) + t[at + rng.randint(0, 2) :]
        out.append(t)
    return out + ["ab" * 300, "ab" * 290 + "c", "x" * 900, "x" * 399, out[0], out[0]]


@pytest.mark.parametrize(("seed", "length", "large"), [(0, 64, 20_000), (1, 100, 20_000), (2, 64, 3), (3, 130, 2)])
def test_substrings(spark, seed, length, large):
    texts = noisy(seed)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    want = Counter((i, *w) for i, w in enumerate(plain_substrings(texts, length)))
    assert deduped(spark, rows, length=length, gram=16, large=large) == want


def test_substrings_awkward(spark):
    rows = awkward()
    want = Counter((r[0], *w) for r, w in zip(rows, plain_substrings([r[1] for r in rows], 400)))
    assert deduped(spark, rows) == want
    assert deduped(spark, []) == Counter()


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = (LONG + LONG[::-1]).encode()
    whole = substrings.anchors(text)
    monkeypatch.setattr(substrings, "PIECE", 5000)
    cut = substrings.anchors(text)
    spans = lambda a: {(h, p, w) for h, p, f, z in zip(*map(list, a)) for w in range(f, z + 1)}
    assert spans(whole) == spans(cut) and len({w for *_, w in spans(cut)}) == len(text) - 399


def periodic(seed):
    """Texts that repeat short periods: alone, at their ends, within others, and shifted."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    out = ["a" * 5000, "ab" * 2500, "a" * 130, "b" * 129 + "a" * 140 + "b" * 3]
    for p in (3, 17, 60, 90, 131):
        unit = word(p)
        out += [word(200) + unit * 9 + word(150), unit * 4, (unit * 9)[p // 2 :] + word(40) + unit * 3 + "x" + unit * 2]
    return out + [word(90) + "a" * 135 + word(9), word(400), "é" * 300, "é" * 70]


@pytest.mark.parametrize("piece", [1 << 22, 700])
def test_periodic_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    texts = periodic(5)
    want = Counter((i, *w) for i, w in enumerate(plain_substrings(texts, 128)))
    assert deduped(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], length=128, gram=16) == want
    for i in (0, 1, 7):  # alone: no other text repeats it
        assert deduped(spark, [(i, texts[i], "en", "s")], length=128, gram=16) == Counter([(i, *plain_substrings([texts[i]], 128)[0])])


def test_chains_take_time_by_their_length(spark):
    for unit in ("x", "ab", "abc" * 50 + "d"):
        text = (unit * 4_000_000)[:4_000_000]
        began = time.process_time()
        assert len(substrings.chain_heads(text.encode())[0]) < 20 and time.process_time() - began < 8
        ((_, n, gone, runs, _),) = deduped(spark, [(1, text, "en", "s")])
        assert (n, gone, runs) == (len(text), len(text), 1)


def test_intervals():
    """The interval tree of a small suffix array: every set of suffixes that share a longer prefix than their parent."""
    s = sorted(["banana"[i:] for i in range(6)])
    lcp = [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(s, s[1:]))]
    assert {(d, tuple(s[f : z + 1])) for d, _, f, z in substrings.intervals(lcp) if d} == {(3, ("ana", "anana")), (1, ("a", "ana", "anana")), (2, ("na", "nana"))}
