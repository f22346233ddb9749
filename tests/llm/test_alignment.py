"""Alignment of two tokenizers, held against a plain version on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palisade.llm import alignment
from palisade.llm.queries import QUERIES
from tests.llm import data

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
CHARS = "ab  \n\t'sretvml19é中文ß🙂՘-.,　\x00 abcdefg▁<0x>\x1c\x85"


class Plain:
    """Both tokenizers on a whole text, by offsets."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        alphabet = alignment.byte_alphabet()
        self.a_bytes = {n: bytes(alphabet[c] for c in t) for t, n in self.a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}

    def b_bytes(self, n):
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        """Token ids, groups, and all overlapping pairs."""
        if not text:
            return [], [], [], []
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        spans = []
        for ids, of in ((a, self.a_bytes.__getitem__), (b, self.b_bytes)):
            at, own = 0, []
            for n in ids:
                own.append((at, at + len(of(n))))
                at += len(of(n))
            spans.append(own)
        if b"".join(map(self.a_bytes.__getitem__, a)) != f" {text}".encode() or b"".join(map(self.b_bytes, b)) != f" {text}".encode():
            return [], [], [], []
        cuts = [0, *sorted({z for _, z in spans[0]} & {z for _, z in spans[1]})]
        inside = lambda ids, own, s, e: ",".join(str(n) for n, (x, z) in zip(ids, own) if s <= x and z <= e)
        groups = [f"{inside(a, spans[0], s, e)}|{inside(b, spans[1], s, e)}" for s, e in zip(cuts, cuts[1:])]
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (t, f) in zip(b, spans[1]) if s < f and t < e]
        return a, b, groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, texts):
    rows = [plain(t) for t in texts]
    n = Counter(pair for *_, links in rows for pair in set(links))
    most = defaultdict(int)
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    out = []
    for a, b, groups, links in rows:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), digest))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_awkward_rows(spark, plain):
    rng = random.Random(5)
    rows = data.awkward()
    rows += [(100 + k, "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 40))), "en", "s") for k in range(150)]
    rows += [(300, "a▁b", "en", "s"), (301, "<s> <|endoftext|> <0x0A>", "en", "s"), (302, " ", "en", "s"), (303, "  two  spaces ", "en", "s")]
    rows = [r if r[1] is None or len(r[1]) < 3000 else (r[0], r[1][:3000], *r[2:]) for r in rows]  # the plain version is quadratic
    docs = data.documents(spark, rows)
    want = sorted((str(r[0]), *w) for r, w in zip(rows, expected(plain, [r[1] for r in rows])))
    out = alignment.align(docs, *PATHS, digest=True)
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in out.collect()) == want
    zeros = [w for w in want if w[1] == 0]
    assert ("300", 0, 0, 0, 0, 0, 0, "") in zeros and ("21", 0, 0, 0, 0, 0, 0, "") in zeros
    assert alignment.align(docs.limit(0), *PATHS).count() == 0


def test_pairs_that_go_to_the_postings_and_pairs_that_are_joined(spark, monkeypatch):
    """Same sums whichever way a pair's count comes."""
    rows = [(n, f"{'common words here' if n % 3 else 'rare'} word{n}", "en", "s") for n in range(60)]
    docs = data.documents(spark, rows)
    own = alignment.alignments(docs, *PATHS).collect()
    postings = spark.createDataFrame([(r.doc_id, p, t) for r in own for p, t in zip(r.links, r.times)], "row long, pair long, times int")
    counts = alignment.pair_counts(postings).cache()
    known = {r.pair: (r.n, r.best) for r in counts.collect()}
    want = sorted((r.doc_id, sum(t for p, t in zip(r.links, r.times) if known[p][1]), sum(t * known[p][0] for p, t in zip(r.links, r.times))) for r in own)
    for often in (1, 20, 1 << 16):
        assert sorted(map(tuple, alignment.contributions(postings, counts, often).collect())) == want


def test_quick_ids_are_the_tokenizers(plain):
    both = alignment.aligner(*PATHS)
    assert both.quick is not None
    rng = random.Random(6)
    for _ in range(5000):
        unit = "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 30)))
        assert both.a_ids(unit) == plain.a.encode(f" {unit}", add_special_tokens=False).ids
        assert "".join(f" {u}" for u in alignment.units_of(unit)) == f" {unit}"
    for c in range(0x80, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            unit = f"a{chr(c)}a {chr(c)}1"
            assert both.a_ids(unit) == plain.a.encode(f" {unit}", add_special_tokens=False).ids


def test_groups_as_text(spark, plain):
    docs = data.documents(spark, [(1, "Alignment überall, 中文!", "en", "s")])
    r = alignment.align(docs, *PATHS).first()
    a, b, groups, _ = plain("Alignment überall, 中文!")
    assert r.groups == ";".join(groups) and r.n_a == len(a) and r.n_b == len(b)


def test_query_against_the_plain_version(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(docs, expected(plain, [r.text for r in docs]))}
    got = QUERIES["op11_tokenizer_alignment"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in (*COLUMNS[:-1], "groups_sha256")) == want[r.doc_id]
