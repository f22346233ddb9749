"""Byte-pair encoding by prefixes, held against the public library and against the merges themselves."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from palisade.llm import byte_pairs
from palisade.llm.queries import QUERIES
from tests.llm import data

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CHARS = "ab  \n\t'sretvml19é中文ß🙂՘-.,　\x00 abcdefg"


@pytest.fixture(scope="module")
def own():
    return byte_pairs.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def some(rng, n, chars=CHARS):
    return "".join(rng.choice(chars) for _ in range(rng.randint(0, n)))


def test_encode_and_edit_against_the_library(own, library):
    rng = random.Random(1)
    for k in range(4000):
        text = some(rng, 30) if k % 3 else some(rng, 200).replace(" ", "")
        done = own.encode(text)
        assert done.ids == library.encode_ordinary(text)
        assert own.decode(done.ids) == text.encode()
        start, removed, inserted = rng.randint(0, len(text) + 2), rng.randint(0, 8), some(rng, 6)
        new, again = own.edit(text, done, start, removed, inserted)
        assert new == text[:start] + inserted + text[start + removed :]
        assert again == own.encode(new)


def test_edit_of_a_long_text_stops_near_the_edit(own, monkeypatch):
    text = " ".join(f"word{n}" for n in range(20000))
    done, seen = own.encode(text), []
    split = own.split
    monkeypatch.setattr(own, "split", lambda t: seen.append(len(t)) or split(t))
    new, again = own.edit(text, done, 70000, 3, "other words")
    assert sum(seen) < 2000
    assert again == own.encode(new)


def test_every_prefix_has_one_valid_last_token(own):
    rng = random.Random(2)
    for _ in range(300):
        b = bytes(rng.choice(b"etaonihs \xc3\xa9\xe4\xb8\xad0") for _ in range(rng.randint(1, 60)))
        last = own.prefixes(b)
        for end in range(1, len(b) + 1):
            fit = [own.rank[b[a:end]] for a in range(max(0, end - own.longest), end) if b[a:end] in own.rank and (a == 0 or own.stays(last[a], own.rank[b[a:end]]))]
            assert fit == [last[end]]
            assert [own.bytes_of[t] for t in own.tokens_of(last[: end + 1])] == own.merged(b[:end])
        more = bytes(rng.choice(b"etaon") for _ in range(rng.randint(0, 70)))
        assert own.prefixes(b + more, last) == own.prefixes(b + more)
        at = rng.randint(0, len(b))
        removed = rng.randint(0, len(b) - at)
        new = b[:at] + more[:5] + b[at + removed :] + more
        assert own.prefixes_after(new, own.prefixes(b + more), at, removed, len(more[:5])) == own.prefixes(new)


def test_pairs_stay_as_the_merges_say(own):
    rng = random.Random(3)
    ids = list(own.bytes_of)
    short = [i for i in ids if len(own.bytes_of[i]) <= 2 or set(own.bytes_of[i]) <= set(b" -=*\n")]
    for _ in range(3000):
        a, b = (rng.choice(rng.choice((ids, short))) for _ in range(2))
        pair = [own.bytes_of[a], own.bytes_of[b]]
        assert own.stays(a, b) == (own.merged(pair[0] + pair[1]) == pair)


def test_characters_are_split_as_the_library_splits_them(own):
    """The ends of each range that newer Unicode versions added, and their neighbours: a merge with what stands before shows one match."""
    ranks = {bytes([n]): n for n in range(256)} | {b"a" + bytes([n]): 256 + n for n in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for a, z in byte_pairs.ADDED_SINCE:
        for c in {a - 1, a, z, z + 1}:
            if c < 0x110000:
                assert (len(own.split("a" + chr(c))) == 1) == (probe.encode_ordinary("a" + chr(c))[0] >= 256), hex(c)


def test_latin_texts_are_split_alike(own):
    rng = random.Random(4)
    assert type(own.latin) is not type(own.pattern)
    every = "".join(map(chr, range(256)))
    for _ in range(3000):
        text = some(rng, 30, every + "  'sll" + "  \n\t\xa0\x85" * 4)
        assert own.latin.findall(text) == own.pattern.findall(text)


def test_awkward_rows(spark, library):
    docs = data.documents(spark)
    out = byte_pairs.round_trip(docs, PATH, P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(out) == order(want)
    assert byte_pairs.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_special_tokens_are_plain_text(spark, library):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert byte_pairs.encode(docs, PATH, P.PATTERN).first().ids == library.encode_ordinary("a<|endoftext|>b")


def test_decode_of_nulls_and_unknown_ids(spark, own):
    df = spark.createDataFrame([(1, [64, 172]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_pairs.decode(df, PATH, P.PATTERN).collect()} == {1: own.decode([64, 172]), 2: None, 3: b""}
    with pytest.raises(Exception, match="not in the rank table|out of bounds"):
        byte_pairs.decode(spark.createDataFrame([(1, [50_400])], "doc_id long, ids array<int>"), PATH, P.PATTERN).collect()


def test_edited_table(spark):
    docs = data.documents(spark).select("doc_id", "text").where("doc_id between 0 and 22")
    encoded = byte_pairs.encode(docs, PATH, P.PATTERN).join(docs, "doc_id")
    edits = encoded.select("doc_id", (F.col("doc_id") * 3).alias("start"), F.lit(4).alias("removed"), F.lit(" in between").alias("inserted")).where("doc_id % 2 = 0")
    edits = edits.unionByName(encoded.where("doc_id % 2 = 1").select("doc_id", F.lit(10**6).alias("start"), F.lit(None).cast("int").alias("removed"), F.lit("ly, appended").alias("inserted")))
    out = byte_pairs.edit(encoded, edits.where("doc_id <> 3"), PATH, P.PATTERN)
    fresh = byte_pairs.encode(out.select("doc_id", "text"), PATH, P.PATTERN)
    same = out.join(fresh.withColumnsRenamed({c: f"{c}_" for c in ("ids", "match_chars", "match_tokens")}), "doc_id")
    assert same.count() == encoded.count() == 10
    assert same.where("ids <> ids_ or match_chars <> match_chars_ or match_tokens <> match_tokens_").count() == 0
    texts = {r.doc_id: r.text for r in out.collect()}
    before = {r.doc_id: r.text or "" for r in encoded.collect()}
    assert texts[3] == before[3] and texts[5] == before[5] + "ly, appended" and texts[4] == before[4][:12] + " in between" + before[4][16:]


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_byte_pair_prefixes"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
