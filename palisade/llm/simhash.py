"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits the variants within half the radius, a shuffle on the
variants brings together fingerprints whose balls meet, and what meets is
linked. Radius 3 is odd, so its last bit is met by deleting one bit:

* full variants (at most one flip, 65 of them): whatever shares one lies within
  2 bits. At most 65 fingerprints can share a full variant, so a list of them
  is bounded.
* block variants: blank one of three blocks and flip at most one bit elsewhere.
  Two fingerprints 3 bits apart either have a block with exactly one differing
  bit (the other two bits then meet in the middle), or one block with all three.
  Only variants met by two different components go on; those rows delete one
  bit of the blank block, after which sharing a key again proves a distance of
  at most 3.

So links are proved by shared keys alone: a group of any size becomes a star on
its smallest member, never a list of pairs, and no partner is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import connected_components, short_batches, sliced
from palisade.sources.scratch import release, staged, written

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 3
#: Bit ranges blanked by block variants.
BLOCKS = ((0, 22), (22, 43), (43, 64))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


#: For each byte, its bits as the bytes of a 64-bit integer.
_SPREAD = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.uint8).view(np.uint64).ravel()


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the rows of ``h`` (uint64) have each bit, column after column."""
    wide = _SPREAD[np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1)]
    # byte counters hold 255 rows
    return np.add.reduceat(wide, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 8 * wide.shape[1]).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text over word shingles, as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 1 << 15):
        part = grams[at : at + (1 << 15)]
        ones += _ones(np.fromiter((digest(g, seed) for g in part), "<u8", len(part)))
    set_bits = np.packbits(2 * ones > len(grams), bitorder="little")
    return int.from_bytes(set_bits.tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)``: a signed long for each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = [_signed(fingerprint(t.as_py(), shingle, seed)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(rows: list[tuple[int, ...]], *names: str):
    """A literal array of structs of longs, to be exploded beside a row."""
    return F.array(*(F.struct(*(F.lit(_signed(v)).cast("long").alias(n) for v, n in zip(r, names))) for r in rows))


def _full() -> list[tuple[int, ...]]:
    return [(0,)] + [(1 << i,) for i in range(BITS)]


def _blanked() -> list[tuple[int, ...]]:
    """(keep, flip, block, flips): the variant is (fp & keep) ^ flip."""
    out = []
    for b, (lo, hi) in enumerate(BLOCKS):
        keep = ((1 << BITS) - 1) ^ (((1 << hi) - 1) ^ ((1 << lo) - 1))
        out.append((keep, 0, b, 0))
        out += [(keep, 1 << i, b, 1) for i in range(BITS) if not lo <= i < hi]
    return out


def _star(df: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Edges from each different ``node`` of a key to the key's smallest node."""
    low = F.min(node).over(W.partitionBy(*keys))
    return df.select(F.col(node).alias("src"), low.alias("dst")).where("src <> dst").distinct()


def ball_links(fps: DataFrame) -> DataFrame:
    """``(node, root)`` over different fingerprints ``fps(fp)`` linked at 3 bits or fewer.

    Fingerprints without any partner are not listed.
    """
    # a fixed number of partitions: a few bytes a row grow to many rows, which adaptive coalescing does not foresee
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.select("fp").where("fp is not null").distinct().repartition(parts, F.xxhash64("fp"))
    met = (
        fps.select("fp", F.explode(_masks(_full(), "flip")).alias("m"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("m.flip")).alias("v"))
        .groupBy("v")
        .agg(F.min("fp").alias("dst"), F.collect_list("fp").alias("all"))
        .where(F.size("all") > 1)
        .select(F.explode("all").alias("src"), "dst")
        .where("src <> dst")
    )
    near = connected_components(met)
    comp = staged(
        fps.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp")),
        "ball-comp",
    )
    variants = comp.repartition(parts, "fp").select("fp", "comp", F.explode(_masks(_blanked(), "keep", "flip", "block", "flips")).alias("m")).select(
        F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("v"),
        F.col("m.block").cast("int").alias("block"),
        F.col("m.flips").cast("int").alias("flips"),
        "fp",
        "comp",
    )
    group = W.partitionBy("v", "block")
    met = staged(
        variants.withColumn("lo", F.min("comp").over(group)).withColumn("hi", F.max("comp").over(group)).where("lo <> hi").drop("lo", "hi"),
        "ball-met",
    )

    deleted = [(b, 1 << p) for b, (lo, hi) in enumerate(BLOCKS) for p in range(lo, hi)]
    by_block = F.filter(_masks(deleted, "block", "bit"), lambda x: x["block"] == F.col("block"))
    one = met.select("v", "comp", "fp", "block", F.explode(by_block).alias("m"))
    # what is left of the blank block once the deleted bit is gone
    span = F.element_at(F.array(*(F.lit(_signed(((1 << hi) - 1) ^ ((1 << lo) - 1))).cast("long") for lo, hi in BLOCKS)), F.col("block") + 1)
    # variants have no bits in the blank block, so both fit in one long; the deleted bit tells which block it is
    rest = F.col("fp").bitwiseAND(F.bitwise_not(F.col("m.bit"))).bitwiseAND(span)
    links = _star(one.select(F.col("v").bitwiseOR(rest).alias("left"), F.col("m.bit").alias("bit"), "comp"), ["left", "bit"], "comp")

    inside = [(b, 1 << p, (1 << q) if q != p else 0) for b, (lo, hi) in enumerate(BLOCKS) for p in range(lo, hi) for q in range(lo, hi)]
    by_block = F.filter(_masks(inside, "block", "bit", "flip"), lambda x: x["block"] == F.col("block"))
    three = met.where("flips = 0").select("v", "comp", "fp", "block", F.explode(by_block).alias("m"))
    rest = F.col("fp").bitwiseXOR(F.col("m.flip")).bitwiseAND(F.bitwise_not(F.col("m.bit"))).bitwiseAND(span)
    links = links.union(_star(three.select(F.col("v").bitwiseOR(rest).alias("left"), F.col("m.bit").alias("bit"), "comp"), ["left", "bit"], "comp"))
    joined = connected_components(near.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(links))
    return joined


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)`` with its component.

    Returns ``doc_id, fingerprint`` (16 hex digits) ``, component_id``: the
    smallest doc_id that links of at most 3 differing bits reach, itself
    included.

    Null or wordless texts have fingerprint zero and are linked like others.
    Rows with a null doc_id are kept; they link, but never name a component
    (null if nothing else is reachable). Repeated rows stay repeated. Columns
    other than doc_id and text are not looked at. An empty table gives no rows.
    """
    fp = staged(fingerprints(docs, shingle, seed), "simhash")
    roots = staged(ball_links(fp), "simhash-roots")
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.select("fp", "root").join(low, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- similarity of shingle sets, for filtering -----------------------------------

#: Near copies share at least this part of their different shingles of ``WIDE_SHINGLE`` words.
SIMILARITY = 0.8
WIDE_SHINGLE = 5
#: Chance that a pair of exactly that similarity meets.
RECALL = 0.97
#: Fingerprints of a text that a pair is verified on, at least.
VERIFIED = 24
#: Members of a shared variant that are compared with each other in one piece, about.
CELL = 4096
#: Members of a shared variant beyond which they count as a family.
FAMILY = 16
#: Members up to which pieces are compared many at a time.
FEW = 32
#: Bits of a band beyond the logarithm of the number of fingerprints: strangers share a variant about once in 2 ** SPARE / bits.
SPARE = 6


def differing(similarity: float = SIMILARITY) -> float:
    """Share of bits in which two SimHashes of sets of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_for(n: int) -> int:
    """Bits of a band by which n fingerprints share variants with about as many strangers each, however large n is."""
    return min(BITS, max(16, n.bit_length() + SPARE))


def bands_for(bits: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Number of bands of so many bits by which a pair of that similarity meets with a chance of ``recall``.

    A band meets if at most two of its bits differ (one flip from either side).
    """
    p = differing(similarity)
    meets = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def wide(text: bytes | None, n: int, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> list[int]:
    """``n`` independent 64-bit SimHashes of the set of a text's shingles, as signed integers; zeros without words."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * n
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    base = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))
    turns = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(BITS * n, np.int64)
    for at in range(0, len(base), 1 << 10):
        h = (base[at : at + (1 << 10), None] ^ turns) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        ones += _ones(h ^ (h >> np.uint64(29)))
    return np.packbits(2 * ones > len(base), bitorder="little").view(np.int64).tolist()


def similar_links(nodes: DataFrame, bits: int, bands: int, similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``(src, dst)`` between similar rows of ``nodes(fp, words)``, words being independent SimHashes.

    The first words are one band each, which emits its variants with at most one
    flip. Within a variant every fingerprint is first compared with one leader, so
    a group of any size gives a line a member, and another one in each band. What is near its leader
    in the first word is verified on all words. Copies of one text may be like
    it and less like each other; so what was near a leader is compared once more,
    with the leader's own best connected neighbour. Members of a variant that are
    then in different components are compared with each other, see ``_across``:
    every pair that shares a variant is verified, or linked already.
    """
    limit = differing(similarity)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(_signed((1 << bits) - 1)).cast("long")
    flips = F.array(*(F.lit(_signed(x)).cast("long") for x in [0, *(1 << i for i in range(bits))]))
    banded = nodes.repartition(parts, F.xxhash64("fp")).select("fp", F.posexplode(F.slice("words", 1, bands)).alias("band", "word"))
    variants = banded.select("fp", "band", F.col("word").bitwiseAND(low).alias("word"), F.explode(flips).alias("flip"))
    keyed = variants.select("fp", F.xxhash64("band", F.col("word").bitwiseXOR(F.col("flip"))).alias("key"), F.xxhash64("band").alias("turn"))
    # the leader has the least fingerprint once bits are turned over, others in each band
    group = W.partitionBy("key")
    led = keyed.withColumn("leader", F.min(F.col("fp").bitwiseXOR(F.col("turn"))).over(group).bitwiseXOR(F.col("turn"))).withColumn("more", F.count("*").over(group) > 2).where("fp <> leader")
    # three standard deviations above the expected number of differing bits
    slack = math.floor(BITS * limit + 3 * math.sqrt(BITS * limit * (1 - limit)))
    led = led.withColumn("leader", F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= slack, F.col("leader")))
    met = staged(led.where("more or leader is not null").select(F.when(F.col("more"), F.col("key")).alias("key"), "fp", "leader"), "simhash-met")
    near = met.where("leader is not null").select(F.col("fp").alias("src"), F.col("leader").alias("dst")).distinct()
    near = staged(near, "simhash-near")

    def verified(pairs: DataFrame) -> DataFrame:
        left = nodes.select(F.col("fp").alias("src"), F.col("words").alias("a"))
        right = nodes.select(F.col("fp").alias("dst"), F.col("words").alias("b"))
        both = pairs.join(left, "src").join(right, "dst")
        apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        # half a standard deviation of leave, so that most pairs of exactly the similarity pass
        size = F.size("a") * BITS
        return both.where(apart <= limit * size + F.sqrt(limit * (1 - limit) * size) / 2).select("src", "dst")

    links = staged(verified(near), "simhash-links")
    ends = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = ends.groupBy("src").agg(F.count("*").alias("n"))
    hub = ends.join(degree.select(F.col("src").alias("dst"), "n"), "dst").groupBy(F.col("src").alias("leader")).agg(F.max_by("dst", F.struct("n", "dst")).alias("hub"))
    # what is not yet in its leader's component
    roots = staged(connected_components(links), "simhash-first")
    apart = near.join(roots.select(F.col("node").alias("src"), F.col("root").alias("r")), "src", "left").join(roots.select(F.col("node").alias("dst"), F.col("root").alias("q")), "dst", "left")
    apart = apart.where(F.coalesce("r", "src") != F.coalesce("q", "dst"))
    again = apart.join(hub, F.col("dst") == F.col("leader")).select("src", F.col("hub").alias("dst")).where("src <> dst").distinct()
    members = met.where("key is not null").select("key", "fp")
    return links.union(verified(again)).union(_across(members, roots, nodes, slack, limit))


def near_others(at: np.ndarray, fp: np.ndarray, comp: np.ndarray, slack: int) -> np.ndarray:
    """Which members of the pieces that ``at`` bounds are within ``slack`` bits of one in the same piece and another component."""
    out = np.zeros(len(fp), bool)
    if not len(fp):
        return out
    fp, at = fp.view(np.uint64), at - at[0]
    size = np.diff(at)
    piece = np.repeat(np.arange(len(size)), size)
    few = (size <= FEW)[piece]
    for d in range(1, min(FEW, int(size.max()))):
        k = np.flatnonzero((piece[d:] == piece[:-d]) & few[d:] & (comp[d:] != comp[:-d]))
        k = k[np.bitwise_count(fp[k] ^ fp[k + d]) <= slack]
        out[k] = out[k + d] = True
    for lo, hi in zip(at[:-1][size > FEW], at[1:][size > FEW]):
        for k in range(lo, hi - 1):
            near = (np.bitwise_count(fp[k + 1 : hi] ^ fp[k]) <= slack) & (comp[k + 1 : hi] != comp[k])
            if near.any():
                out[k] = True
                out[k + 1 : hi] |= near
    return out


def _across(members: DataFrame, roots: DataFrame, nodes: DataFrame, slack: int, limit: float) -> DataFrame:
    """Edges between similar ``members(key, fp)`` of a key that are in different components ``roots(node, root)``.

    Strangers share a key in twos and threes; keys that more than ``FAMILY``
    members share are those of a family of texts, whose members meet in many keys.
    So a family, all that such keys connect, is compared once instead of once a
    key. Members are dealt into blocks, and each two blocks meet in a
    cell of bounded size: the pairs of a large family are many small tasks and are
    never rows. A cell passes on members that are near another one in the
    first word, then links that hold on all words.
    """
    group = W.partitionBy("key")
    rest = members.join(roots.select(F.col("node").alias("fp"), F.col("root").alias("comp")), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    rest = rest.withColumn("lo", F.min("comp").over(group)).withColumn("hi", F.max("comp").over(group)).withColumn("n", F.count("*").over(group)).withColumn("least", F.min("fp").over(group))
    rest = staged(rest.where("lo <> hi").drop("lo", "hi"), "simhash-rest")
    large = rest.where(F.col("n") > FAMILY)
    rest = rest.where(F.col("n") <= FAMILY).select("key", "fp", "comp")
    if not large.isEmpty():
        # a member goes to the least of its keys' least, as do those; so it has one edge, however many keys it is in
        tied = large.select("fp", "least", F.min("least").over(W.partitionBy("fp")).alias("dst"))
        family = connected_components(tied.select(F.col("fp").alias("src"), "dst").distinct().union(tied.select(F.col("least").alias("src"), "dst").distinct()))
        family = large.select("fp", "comp").distinct().join(family.withColumnRenamed("node", "fp"), "fp")
        rest = rest.union(family.select(F.xxhash64(F.lit("family"), "root").alias("key"), "fp", "comp"))
    rest = rest.withColumn("blocks", F.ceil(F.count("*").over(group) / CELL).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rest.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("fp", "comp")).alias("all"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = b.column(3).offsets.to_numpy(), b.column(3).values
            fp, comp = (rows.field(k).to_numpy() for k in (0, 1))
            hit = np.flatnonzero(near_others(at, fp, comp, slack))
            cell = pa.array(np.searchsorted(at, hit, side="right") - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(cell) for k in range(3)), pa.array(fp[hit]), pa.array(comp[hit])], ["key", "i", "j", "fp", "comp"])

    close = staged(short_batches(cells).mapInArrow(pick, "key long, i int, j int, fp long, comp long"), "simhash-close")
    whole = close.join(nodes.select("fp", "words"), "fp").groupBy("key", "i", "j").agg(F.collect_list(F.struct("fp", "comp", "words")).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst = [], []
            at, rows = b.column(0).offsets.to_numpy(), b.column(0).values
            fp, comp = (rows.field(k).to_numpy() for k in (0, 1))
            words = rows.field(2).values.to_numpy().reshape(len(fp), -1) if len(fp) else None
            for lo, hi in zip(at[:-1], at[1:]):
                size = BITS * words.shape[1]
                most = limit * size + math.sqrt(limit * (1 - limit) * size) / 2
                for k in range(lo, hi - 1):
                    apart = np.bitwise_count((words[k + 1 : hi] ^ words[k]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    found = k + 1 + np.flatnonzero((apart <= most) & (comp[k + 1 : hi] != comp[k]))
                    src += [fp[k]] * len(found)
                    dst += fp[found].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return short_batches(whole).select("all").mapInArrow(run, "src long, dst long").distinct()


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, seed: int = SEED, recall: float = RECALL, bits: int | None = None) -> DataFrame:
    """``docs`` with one document of each group of near copies: the smallest doc_id (null last), then text hash.

    Near copies share ``similarity`` of their different word shingles, as
    estimated from all bits of several SimHashes; groups are what links reach.
    ``bits`` of a band follow the number of documents (``bits_for``), at the same ``recall``, so that the work
    grows with the table; which pairs at the limit are missed may then change with it. With
    ``bits`` given, documents that are unlike others change nothing between those.
    Needs ``doc_id, text``; all columns are passed on. Rows that share doc_id and
    text are one document and become one row. Null and wordless texts are copies
    of each other. An empty table gives no rows.
    """
    before = written()
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rank"), F.col("text").cast("binary").alias("text"))
    bits = bits or bits_for(docs.select("doc_id").count())
    bands = bands_for(bits, similarity, recall)
    n = max(bands, VERIFIED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = [wide(t.as_py(), n, shingle, seed) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([w[0] for w in words], pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "rank", "fp", "words"]
            )

    fp = staged(rows.mapInArrow(run, "doc_id long, rank long, fp long, words array<long>"), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rank")
    # one row a fingerprint, so that copies do not meet in one task
    first = staged(fp.groupBy("fp").agg(F.min(order).alias("first"), F.min("words").alias("words")), "simhash-nodes")
    roots = connected_components(similar_links(first.select("fp", "words"), bits, bands, similarity))
    groups = first.select("fp", "first").join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = staged(groups.select(F.col("first.doc_id").alias("_id"), F.col("first.rank").alias("_rank")), "kept")
    release(written() - before - {kept._scratch_path})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_rank"))
    return docs.drop("_id", "_rank").join(kept, same).dropDuplicates(["_id", "_rank"]).drop("_id", "_rank")
