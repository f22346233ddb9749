"""Wrappers, latent retrieval, tool calls and the pipeline."""

import hashlib
import json
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import decontamination, mixing, queries, tool_calls, wrappers
from tests.llm.data import LONG, awkward, documents
from tests.llm.test_corpus import size_of, spoken
from tests.llm.test_dedup import plain_cut, similar

# --- wrappers ------------------------------------------------------------------


def page(title, paragraphs, menu=3, comments=0, aside=True):
    """An article page as a content system would write it."""
    items = "".join(f"<li><a href='/{n}'>menu {n}</a>" for n in range(menu))
    box = "<aside class=widget><h3>Popular</h3><p>side text</p></aside>" if aside else ""
    talk = f"<section id='comments'><h2>Comments</h2>{''.join(f'<div class=comment><p>reader says {n}</p></div>' for n in range(comments))}</section>" if comments else ""
    body = "".join(f"<p>{p}" for p in paragraphs)
    return (
        f"<!doctype html><html><head><title>{title} | site</title><style>p>a{{}}</style><script>if (a<b) document.write('<p>no</p>')</script></head><body>"
        f"<div class='cookie-notice'>We use cookies</div><header><h1>Site</h1></header><nav><ul>{items}</ul></nav>"
        f"<main><article><h1>{title}</h1>{body}<div class='ad-slot ad'>buy</div><form><input><p>Sign up</p></form></article>{talk}</main>{box}<footer>&copy; all</footer></body></html>"
    )


CASES = [
    ("http://a.com/1", page("One &amp; two", ["Fi<b>rst</b>  para", "Second<br>line &lt;x&gt; &amp;amp;"]), "One & two First para Second line <x> &amp;"),
    ("http://a.com/2", page("T", ["p"], menu=9, comments=4, aside=False), "T p"),
    ("http://a.com/3", page("T", [], comments=1), "T"),
    ("http://b.com/1", "<body><div id=menu>m</div><div class=post><h2>H</h2><p>" + "long text " * 9 + "</p><ul><li>x<li>y</ul></div><div class=sidebar><p>s</p></div>", "H " + "long text " * 9 + "x y"),
    ("http://b.com/2", None, ""),
    ("http://b.com/3", "", ""),
    (None, "plain text only", "plain text only"),
    ("no host", "<article>a<!-- <p>c</p> --><span class='advert'>ad</span> b</article>", "a b"),
    ("http://c.com/", "<article>open <p>never closed <b>bold <a href=\"x>y\">z", "open never closed bold z"),
    ("http://d.com/", f"<article><p>{LONG}</p></article>", LONG),
    ("http://e.com/", "<article><table><tr><td>a<td>b<tr><td>c</table><h2>t</h2>u</article>", "a b c t u"),
]


def test_extract(spark):
    pages = spark.createDataFrame([(n, u, h, "x") for n, (u, h, _) in enumerate(CASES)], "page_id long, url string, html string, content string")
    rows = wrappers.extract(pages).orderBy("page_id").collect()
    assert [r.text for r in rows] == [w for *_, w in CASES]
    assert all(r.n_chars == len(r.text) and r.url == CASES[r.page_id][0] for r in rows)
    assert wrappers.extract(pages.limit(0)).count() == 0
    assert wrappers.extract(pages.union(pages)).count() == 2 * len(CASES)


def test_pages_of_other_templates_keep_their_text(spark):
    """A smaller template, sibling sections, and a page whose only article is a teaser in an aside."""
    long = "of the large template " * 9
    cases = [(f"<body><div class=post><p>{long}{n}</p></div></body>", f"{long}{n}") for n in range(3)]
    cases += [("<body><section class=entry><h2>E</h2><p>small template</p></section></body>", "E small template")]
    cases += [("<body><div class=post><p>one</p></div><div class=rest><p>two</p></div></body>", "one two")]
    cases += [("<body><div class=post><p>body</p></div><aside><article><p>teaser</p></article></aside></body>", "body")]
    pages = spark.createDataFrame([(n, f"http://t.com/{n}", h) for n, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    assert [r.text for r in wrappers.extract(pages).orderBy("page_id").collect()] == [w for _, w in cases]


def texts(spark, html, host="t.com"):
    pages = spark.createDataFrame([(n, f"http://{host}/{n}", h) for n, h in enumerate(html)], "page_id long, url string, html string")
    return [r.text for r in wrappers.extract(pages).orderBy("page_id").collect()]


def test_template_text_goes_by_alignment(spark):
    """Lines that a host has on all pages at one place, in elements that nothing marks; the same lines stay where they are a page's own."""
    rng = random.Random(3)
    bodies = [spoken(rng, "en", 30 + n) for n in range(6)]
    sixfold = lambda b: f"<body><div class=x1>Home About Contact</div><div class=x2><p>{b}</p></div><div class=x3>All rights reserved</div></body>"
    assert texts(spark, map(sixfold, bodies)) == bodies
    plain = lambda b: f"<body><div>Home About Contact</div><div>{b}</div><div>All rights reserved</div></body>"
    assert texts(spark, map(plain, bodies)) == bodies
    # two pages, or copies of one, tell nothing about a host
    whole = [f"Home About Contact {b} All rights reserved" for b in bodies]
    assert texts(spark, map(plain, bodies[:2])) == whole[:2]
    assert texts(spark, map(plain, bodies[:1] * 6)) == whole[:1] * 6
    # an article element holds what is a page's own, whatever other pages say
    said = lambda b: f"<body><article><p>{b}</p><p>All rights reserved</p></article></body>"
    assert texts(spark, map(said, bodies)) == [f"{b} All rights reserved" for b in bodies]
    # a line that only some pages have is optional, and template where it is
    some = [plain(b) if n % 2 else f"<body><div>Home About Contact</div><div>{b}</div><p>Old page</p><div>All rights reserved</div></body>" for n, b in enumerate(bodies)]
    assert texts(spark, some) == bodies


def test_elements_in_doubt(spark):
    rng = random.Random(4)
    bodies, more = [spoken(rng, "en", 30 + n) for n in range(6)], [spoken(rng, "en", 9 + n) for n in range(6)]
    own = [f"<article><p>{b}</p><p class=notice>{m}</p></article>" for b, m in zip(bodies, more)]
    both = [f"{b} {m}" for b, m in zip(bodies, more)]
    assert texts(spark, own) == both
    assert texts(spark, [f"<article><p>{b}</p><p class=notice>We use cookies</p></article>" for b in bodies]) == bodies
    assert texts(spark, [f"<article><p>{b}</p><section class=discussion><p>{m}</p></section></article>" for b, m in zip(bodies, more)]) == both
    # records that repeat on one page make a discussion of all pages' sections, also where there is one record
    replies = lambda n, m: "".join(f"<div class=entry><p>{m} {k}</p></div>" for k in range(n))
    assert texts(spark, [f"<article><p>{b}</p><section class=discussion>{replies(n, m)}</section></article>" for n, (b, m) in enumerate(zip(bodies, more))]) == bodies
    assert texts(spark, [f"<article><p>{b}</p><div class=talkback><p>{m}</p></div></article>" for b, m in zip(bodies, more)]) == bodies
    assert texts(spark, [f"<p class=notice>{m}</p><div class=post><p>{b}</p></div>" for b, m in zip(bodies, more)]) == bodies
    assert texts(spark, [f"<div class=post><p>{b}</p><p class=notice>{m}</p></div>" for b, m in zip(bodies, more)]) == both


@pytest.mark.parametrize("seed", range(3))
def test_planted_templates(spark, seed):
    """Hosts of random templates without telling names, against what was planted: fixed lines, optional ones, and bodies."""
    rng = random.Random(seed)
    html, want = [], []
    for host in range(5):
        name = lambda: "".join(rng.choice("qxzvk") for _ in range(5))
        parts = [(rng.choice(["div", "section"]), name(), spoken(rng, "en", rng.randint(2, 6)), rng.random() < 0.3) for _ in range(rng.randint(2, 6))]
        at, body = rng.randint(0, len(parts)), name()
        for n in range(12):
            own = [spoken(rng, "en", rng.randint(8, 30)) for _ in range(rng.randint(2, 5))]
            shown = [f"<{t} class={c}>{x}</{t}>" if not some or n % 3 else "" for t, c, x, some in parts]
            shown.insert(at, f"<div class={body}>{''.join(f'<p>{p}</p>' for p in own)}</div>")
            html.append((f"http://h{host}.com/{n}", f"<html><body>{''.join(shown)}</body></html>"))
            want.append(" ".join(own))
    pages = spark.createDataFrame([(n, u, h) for n, (u, h) in enumerate(html)], "page_id long, url string, html string").repartition(7)
    assert [r.text for r in wrappers.extract(pages).orderBy("page_id").collect()] == want


def test_texts_of_a_place_against_brute_force():
    """What alignment keeps at a place is what all pages have there, in whichever order pages come."""
    rng = random.Random(8)
    for _ in range(30):
        pages = [[rng.choice("ab") for _ in range(3)] for _ in range(5)]
        html = ["".join(f"<h{k + 1}>{t}</h{k + 1}>" for k, t in enumerate(p)) + f"<p>{n} own</p>" for n, p in enumerate(pages)]
        for order in (range(5), reversed(range(5)), rng.sample(range(5), 5)):
            w = None
            for n in order:
                w = wrappers.skeleton(html[n]) if w is None else wrappers.align(w, wrappers.skeleton(html[n]))
            kept = {n[1]: set(n[2]) for n in wrappers.texts_of(w)}
            same = {f"h{k + 1}": {wrappers.digest(pages[0][k])} if len({p[k] for p in pages}) == 1 else set() for k in range(3)}
            assert kept == {**same, "p": set()}


def test_fold_and_align():
    assert wrappers.fold(list("abcbcbcd")) == ["a", ["+", "b", "c"], "d"]
    assert wrappers.fold(list("aab")) == [["+", "a"], "b"]
    w = wrappers.align(wrappers.fold(list("abcbcd")), wrappers.fold(list("abcxd")))
    assert w == ["a", ["+", "b", "c"], ["?", "x"], "d"]
    assert wrappers.align(w, wrappers.fold(list("ad"))) == ["a", ["?", ["+", "b", "c"]], ["?", "x"], "d"]
    assert wrappers.align(wrappers.align(list("abcd"), list("ad")), list("abd")) == ["a", ["?", "b"], ["?", "c"], "d"]
    assert wrappers.slots_of(["<a", "#p", ["+", "#q", ["?", "#r"]]]) == ["p", "q", "r"]


def fits(wrapper, nodes):
    """Whether a stream is of the wrapper's language, by plain regular expressions."""
    expr = lambda w: "".join(f"(?:{expr(n[1:])}){n[0]}" if isinstance(n, list) else re.escape(n) + "\n" for n in w)
    return re.fullmatch(expr(wrapper), "".join(x + "\n" for x in nodes)) is not None


@pytest.mark.parametrize("seed", range(4))
def test_wrapper_fits_its_pages(spark, seed):
    rng = random.Random(seed)
    html = [page("t", ["x"] * rng.randint(0, 5), rng.randint(1, 6), rng.randint(0, 3), rng.random() < 0.5) for _ in range(25)]
    pages = spark.createDataFrame([("http://h.com/", h) for h in html], "url string, html string")
    (row,) = wrappers.infer(pages).collect()
    for h in html:
        nodes = []
        for kind, name, text in wrappers.stream(h):
            if kind != "#" or text.strip() and (not nodes or nodes[-1] != "#" + name):
                nodes.append(kind + name)
        assert fits(json.loads(row.wrapper), nodes)


# --- decontamination -------------------------------------------------------------


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 80))]
        b = [rng.choice("abcdefg") for _ in range(rng.randint(0, 90))]
        assert decontamination.common_subsequence(decontamination.bit_masks(a), len(a), b) == plain_lcs(a, b)


def leaky(rng):
    """Items, and documents of which the first have an item, whole, reworded or not at all."""
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, ". ".join(text(rng.randint(8, 16)) for _ in range(rng.randint(2, 4))) + ".") for i in range(40)]
    docs, truth = [], set()
    for d in range(240):
        body = text(rng.randint(30, 300))
        if d < 120:
            i, t = items[d % 40]
            if d % 3 == 1:  # every sixth word of all but the answer is another
                head, _, tail = t[:-1].rpartition(". ")
                t = " ".join(word() if n % 6 == 5 else w for n, w in enumerate(head.split())) + ". " + tail
            at = rng.randrange(len(body))
            body = f"{body[:at]} {t.upper() if d % 5 == 0 else t} {body[at:]}"
            truth.add((d, i))
        docs.append((d, body, "en", "s"))
    return items, docs, truth


def test_leaks(spark):
    items, docs, truth = leaky(random.Random(9))
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (None, "x y z"), (902, "...")], "item_id long, text string")
    rows = documents(spark, [*docs, *awkward()[7:10]])
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(rows, bench).collect()}
    assert found == truth
    out = decontamination.search(rows, bench, "score")
    assert out.columns == [*(c for c in rows.columns if c != "score"), "score"] and out.count() == rows.count()
    assert decontamination.leaks(rows, bench.limit(0)).count() == decontamination.leaks(documents(spark, []), bench).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    items, docs, truth = leaky(random.Random(9))
    monkeypatch.setattr(decontamination, "BLOCK", 15)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(documents(spark, docs), bench).collect()} == truth


def test_few_windows_are_projected(spark):
    """Windows whose words' best products with any passage cannot reach the limit are left out, and no window that reaches it is."""
    rng = random.Random(13)
    items, docs, _ = leaky(rng)
    own = sorted({w for _, t in items for w in t.lower().replace(".", " ").split()})
    docs += [(1000 + k, " ".join(rng.choice(own) if rng.random() < 0.25 else f"z{rng.randrange(10**6)}" for _ in range(200)), "en", "s") for k in range(200)]
    space = decontamination.fit(documents(spark, docs), items)
    looked = able = near = 0
    for _, t, *_ in docs:
        words = decontamination.words_of(t)
        ids = np.array([space.vocabulary.get(w, -1) for w in words])
        got = {(int(a[i]), int(z[i])): c[i] for a, z, c in space.windows(ids) for i in range(len(a))}
        looked += len(got)
        for span in decontamination.SPANS:
            for a in range(0, max(1, -(-len(ids) // decontamination.STEP) - span + 1)):
                lo, hi = a * decontamination.STEP, min(len(ids), (a + span) * decontamination.STEP)
                part = ids[lo:hi]
                weight, known = space.mass[part, :2].sum(axis=0)
                if known < decontamination.COSINE**2 * weight:
                    continue
                able += 1
                cos = space.passages.astype(float) @ space.vectors[part[part >= 0]].astype(float).sum(axis=0) / math.sqrt(weight)
                if cos.max() >= decontamination.COSINE:
                    near += 1
                    assert np.allclose(got[lo, hi], cos, atol=1e-5)
    assert near > 500 and near <= looked < 0.6 * able


@pytest.mark.parametrize(("rank", "limits"), [(24, (0.5,)), (decontamination.RANK, (0.5, decontamination.COSINE))])
def test_candidates_recall(spark, rank, limits):
    """Windows whose exact TF-IDF cosine with an item is high are candidates in the latent space.

    From 0.5 on in a space of few dimensions, and from the operator's own limit on
    in one of its own rank; with its norms of windows, and with those by the true
    weights of all words, in the vocabulary or not.
    """
    items, docs, _ = leaky(random.Random(11))
    space = decontamination.fit(documents(spark, docs), items, rank=rank)
    n, df = decontamination.document_frequencies(documents(spark, docs), space.vocabulary)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    own = decontamination._matrix([w for _, w, _ in decontamination._passages(items)], space.vocabulary, idf)
    often = Counter(w for _, t, *_ in docs for w in set(decontamination.words_of(t)))
    near, found = Counter(), Counter()
    for _, t, *_ in docs:
        words = decontamination.words_of(t)
        ids = np.array([space.vocabulary.get(w, -1) for w in words])
        got = {(int(a[i]), int(z[i]), int(j)) for a, z, c in space.windows(ids) for i, j in zip(*np.nonzero(c >= decontamination.COSINE))}
        for span in decontamination.SPANS:
            for a in range(0, max(1, -(-len(ids) // decontamination.STEP) - span + 1)):
                lo, hi = a * decontamination.STEP, min(len(ids), (a + span) * decontamination.STEP)
                part = ids[lo:hi]
                x = np.zeros(len(idf))
                np.add.at(x, part[part >= 0], idf[part[part >= 0]])
                true = math.sqrt(sum((c * (math.log((n + 1) / (often[w] + 1)) + 0.1)) ** 2 for w, c in Counter(words[lo:hi]).items()))
                for norm in (math.sqrt(space.mass[part, 0].sum()), true):
                    for least in limits:
                        high = {(lo, hi, int(j)) for j in np.flatnonzero(own @ x / norm >= least)}
                        case = norm is true, least
                        near[case], found[case] = near[case] + len(high), found[case] + len(high & got)
    assert len(near) == 2 * len(limits) and all(near[c] > 100 and found[c] / near[c] >= 0.9 for c in near), (near, found)


# --- tool calls --------------------------------------------------------------------


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a ">' * 200_001, "<div>" * 200_000, "<ul><li>" * 100_000, "</div>" * 150_000, "<" * 1_000_000, "<p>x" * 200_000])
def test_hostile_pages_take_time_by_their_length(page):
    began = time.process_time()
    assert sum(1 for _ in wrappers.stream(page)) < 2_000_000 and time.process_time() - began < 5


def test_deep_and_broken_tags():
    read = lambda page: "".join(f"<{x}>" if k == "<" else f"</{x}>" if k == ">" else t for k, x, t in wrappers.stream(page))
    assert read('<p>a<p x="1>b</p>c') == "<p>a</p><p>b</p>c" and read("a < b <p>c") == "a < b <p>c</p>"
    assert read("<script>if (a) '<!--' </script><p>b</p>") == "<p>b</p>" and read("<p>a<!-- b") == "<p>a</p>"
    deep = read("<div>" * 600 + "x" + "</div>" * 600 + "<p>y</p>")
    assert deep.count("<div>") == wrappers.DEPTH == deep.count("</div>") and deep.endswith("</div><p>y</p>")


def test_no_arguments_stop_a_job(spark):
    """Broken, deep, huge and odd JSON has a defined result."""
    deep, wide = "[" * 3000 + "]" * 3000, '{"x":' * 5000 + "1" + "}" * 5000
    texts = ['{"x":"\\ud800"}', deep, wide, '{"x":1e400}', '{"x":-1e400}', '{"x":1e-7,"y":1E21,"z":-0.0,"w":100.0}', '{"x":true}', "", None, '{"\\udfff":2}', '{"x":1' + "0" * 4000 + "}"]
    calls = spark.createDataFrame([(str(i), "f", t) for i, t in enumerate(texts)], "call_id string, name string, arguments string")
    schema = {"f": {"type": "object", "properties": {"x": {"enum": [1, "\ud800"]}, "y": {}, "z": {}, "w": {}}, "additionalProperties": False}}
    out = {int(r.call_id): r for r in tool_calls.check(calls, schema).collect()}
    assert len(out) == len(texts) and out[0].canonical == '{"arguments":{"x":"\\ud800"},"id":"0","name":"f"}' and out[0].valid
    assert all(out[i].canonical is None and out[i].errors == ["$: nested too deeply"] for i in (1, 2))
    assert all(out[i].canonical is None and out[i].errors == ["$: no JSON"] for i in (3, 4, 7, 8))
    assert out[5].canonical.startswith('{"arguments":{"w":100,"x":1e-7,"y":1e+21,"z":0}')
    assert out[6].errors == ["$.x: not in enum"] and out[9].errors == ["$.\\udfff: unknown"] and not out[10].valid


def test_canonical():
    value = {"b": [1.0, 2.5, -0.0, 1e21, True, None], "a": {"é": " \n\"", "😀": 1, "דּ": 2}, "": "x"}
    text = tool_calls.canonical(value)
    assert text == '{"":"x","a":{"é":" \\n\\"","😀":1,"דּ":2},"b":[1,2.5,0,1e+21,true,null]}'
    assert tool_calls.canonical(json.loads(text)) == text
    for bad in ("{", "NaN", "", None, "[" * 100000):
        with pytest.raises(ValueError):
            tool_calls.parse(bad)


@pytest.mark.parametrize(
    ("value", "schema", "bad"),
    [
        (3, {"type": "integer", "minimum": 4}, 1), (3.0, {"type": "integer"}, 0), (True, {"type": "number"}, 1), ("ab", {"type": "string", "maxLength": 1, "pattern": "^c"}, 2),
        ({"a": 1, "z": 2}, {"required": ["a", "b"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}, 3), ([1, "x"], {"items": {"type": "integer"}, "maxItems": 1}, 2),
        ("x", {"enum": ["y"]}, 1), (None, {"type": ["null", "string"]}, 0),
    ],
)
def test_violations(value, schema, bad):
    assert len(tool_calls.violations(value, schema)) == bad


CALLS = "conv_id long, call_id string, position long, name string, arguments string, needs array<string>, content string"
RESULTS = "conv_id long, call_id string, position long, content string, level int"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}


def test_link(spark):
    calls = [
        (1, "a", 5, "f", '{"x": 1}', ["c"], "z"), (1, "b", 6, "f", "{}", [], None), (1, "c", 7, "g", "no", None, None), (1, "a", 9, "f", "{}", None, None),
        (2, "a", 1, "f", '{"x":2,"a":0}', ["gone", "a2"], None), (2, "a2", 0, "f", '{"x":3}', None, None), (None, "n", 1, "f", "{}", None, None), (3, None, 1, "f", "{}", None, None),
        (4, "p", 1, "f", '{"x":1}', ["q"], None), (4, "q", 2, "f", '{"x":1}', ["p"], None), (4, "r", 3, "f", '{"x":1}', ["q"], None), (4, "s", 4, "f", '{"x":1}', [], None), (5, "self", 1, "f", None, ["self"], None),
    ]
    results = [(1, "a", 6, "ra", 1), (1, "a", 8, "late", 1), (1, "b", 2, "rb", 1), (2, "o", 3, "ro", 1), (None, "a", 1, "x", 1), (2, "a", None, None, 1)]
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert len(out) == 11
    assert {k: r.status for k, r in out.items() if r.status != "unanswered"} == {(1, "a"): "linked", (1, "b"): "early", (2, "o"): "orphan", (2, "a"): "linked"}
    a = out[1, "a"]
    assert (a.content, a.n_calls, a.n_results, a.valid, a.canonical) == ("ra", 2, 2, True, '{"arguments":{"x":1},"id":"a","name":"f"}')
    assert [out[1, c].place for c in "bca"] == [1, 2, 3] and [out[1, c].level for c in "bca"] == [0, 0, 1]
    assert [out[2, c].place for c in ("a2", "a")] == [1, 2] and out[2, "o"].place is None
    assert out[4, "s"].place == 1 and all(out[4, c].level is None and out[4, c].place > 1 for c in "pqr") and out[5, "self"].level is None
    assert out[1, "b"].errors == ["$.x: missing"] and out[1, "c"].errors == ["$: no JSON"] and out[5, "self"].canonical is None
    empty = tool_calls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert empty.count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_places_are_topological(spark, seed):
    rng = random.Random(seed)
    calls, order = [], {}
    for conv in range(6):
        ids = [f"c{n}" for n in range(rng.choice([1, 20, 400]))]
        hidden = rng.sample(ids, len(ids)) if conv % 2 else ids
        for n, c in enumerate(hidden):
            needs = rng.sample(hidden[:n], min(n, rng.choice([0, 0, 1, 2])))
            if conv % 2:
                needs = [x for x in needs if hidden.index(x) // 100 == n // 100 or rng.random() < 0.1][:1] if len(ids) > 20 else needs
            order[conv, c] = needs
            calls.append((conv, c, ids.index(c), "f", "{}", needs, None))
    rows = tool_calls.ordered(spark.createDataFrame(calls, CALLS)).collect()
    place = {(r.conv_id, r.call_id): r.place for r in rows}
    assert len(place) == len(calls)
    for (conv, c), needs in order.items():
        assert all(place[conv, x] < place[conv, c] for x in needs)
    for conv in range(6):
        assert sorted(p for (k, _), p in place.items() if k == conv) == list(range(1, sum(k == conv for k, _ in place) + 1))


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, spoken(rng, "en", 30) + ". " + spoken(rng, "en", 6)) for i in range(5)]
    rows = [(i, "\n".join(spoken(rng, lang, rng.randint(10, 40)) for _ in range(rng.randint(1, 4))), lang, f"s{i % 4}") for i, lang in enumerate(["en", "de", "fr"] * 30)]
    shared = spoken(rng, "en", 60)
    rows += [(200 + i, f"{spoken(rng, 'en', 20)}\n{shared}\n{spoken(rng, 'en', 15)}", "en", "s1") for i in range(4)]
    rows += [(300 + i, rows[i][1], rows[i][2], "s2") for i in range(6)] + [(400 + i, f"{spoken(rng, 'en', 40)} {items[i][1]} {spoken(rng, 'en', 25)}", "en", "s3") for i in range(5)]
    middle = spoken(rng, "en", 55)
    rows += [(600 + i, f"{spoken(rng, 'en', 30)} {middle.upper() if i == 5 else middle} {spoken(rng, 'en', 45)}", "en", "s1") for i in range(7)]
    rows += [(500, None, "en", "s0"), (501, "", "en", "s0"), (502, "123 456", "en", None), (503, shared, None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mix_sources":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert set(kept["language_id"]) == {r[0] for r in rows} - {500, 501, 502}
    at = {r[0]: r[1] for r in rows}
    left = [i for i in at if i not in (500, 501, 502)]
    root = similar({i: at[i] for i in left}, 0.8)
    first = {}
    for i in sorted(left):
        first.setdefault(root[i], i)
    assert set(kept["near_duplicates"]) == set(first.values()) and not set(range(300, 306)) & set(first.values())
    cuts = plain_cut([(i, at[i]) for i in first.values()], 51)
    want = {i: text for (i, _), (text, drop, again) in cuts.items() if text.strip() or not (drop or again)}
    assert sum(middle in t for t in want.values()) == 1 and sum(bool(again) for _, _, again in cuts.values()) == 10
    assert {i: r.text for i, r in kept["substring_dedup"].items()} == want and 503 not in want and sum(shared in t for t in want.values()) == 1
    assert all(r.n_chars == len(r.text) for r in kept["substring_dedup"].values())
    assert set(kept["benchmark_decontamination"]) == set(want) - set(range(400, 405))
    last = kept["benchmark_decontamination"]
    mixed = kept["mix_sources"]
    assert set(mixed) <= set(last) and all(r.taken <= 3 * size_of(last[i].text) and r.text == last[i].text for i, r in mixed.items())
    assert sum(r.taken for r in mixed.values()) == pytest.approx(sum(size_of(r.text) for r in last.values()), abs=4)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)
    assert mixing.MAX_EPOCHS == 3


def test_stages_take_empty_and_awkward_documents(spark, tmp_path):
    spark.createDataFrame([(1, "some item text here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], awkward()):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, documents(spark, rows), str(tmp_path)).count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    assert F is not None


def test_calls_of_conversations_have_every_fault(spark):
    """Each status, broken and mistyped arguments, repeated identifiers of either side, and the query's SQL on the same turns."""
    rng = random.Random(2)
    word = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(n))
    rows = [(c, t, "system" if t == 0 and c % 3 else "assistant" if t % 2 else "user", word(rng.randint(3, 40))) for c in range(40) for t in range(rng.randint(0, 12))]
    rows += [(90, 0, "user", None), (90, 1, "assistant", None), (91, 0, "assistant", ""), (91, 2, "user", ""), (None, 1, "user", "a b"), (92, None, "user", "a b")]
    chats = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    calls, results = tool_calls.from_conversations(chats)
    out = tool_calls.link(calls, results, tool_calls.CHAT_SCHEMAS).collect()
    assert {r.status for r in out} == {"linked", "unanswered", "orphan", "early"} and {r.valid for r in out} == {True, False, None}
    errors = {e for r in out for e in r.errors or ()}
    assert {"$: no JSON", "$.words: not integer"} <= errors and all(r.canonical is None for r in out if r.errors == ["$: no JSON"])
    assert {2} <= {r.n_calls for r in out} and {2} <= {r.n_results for r in out}
    db = duckdb.connect()
    db.register("conversations", chats.toArrow())
    want = db.execute(f"SELECT conv_id, call_id, status, n_calls, n_results, level, place, errors, canonical_md5 FROM ({queries.ORACLES['op1_tool_call_linking']})").fetchall()
    digest = lambda x: None if x is None else hashlib.md5(x.encode()).hexdigest()
    own = [(r.conv_id, r.call_id, r.status, r.n_calls, r.n_results, r.level, r.place, None if r.errors is None else "; ".join(r.errors), digest(r.canonical)) for r in out]
    assert sorted(own, key=repr) == sorted(want, key=repr)
