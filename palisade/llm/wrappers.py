"""HTML main text by union-free regular-expression inference over pages of one host.

A page becomes a well-formed stream of block tags and runs of text; a run is
named by the path of its open elements and carries a digest. Adjacent repeats of
a page fold into repeated groups. Streams of one host are then aligned one after
another: a part that only one side has becomes optional, a part that the other
side repeats joins its repeated group, text that differs becomes a slot and text
that all pages share at one place stays part of the template. The result, a
sequence of tags, texts, slots, ``( )+`` and ``( )?`` without alternatives, is
the host's wrapper.

The wrapper decides what the article is. Template text goes, unless an article
element holds it. For pages without a marked element, the article is around the
element whose slots vary by most characters. Where a class word is in doubt (a
paragraph called notice, a section called discussion), the wrapper tells
template text and repeated records, which are no article, from text of its own.

Equal streams are put together before they are shuffled, and the streams of a
large host are aligned in salted parts whose wrappers are aligned in turn, so a
host with a third of all pages is no larger a task than others. Pages move only
if the wrappers are too many to be broadcast (Spark decides by their size).
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import short_batches, sliced
from palisade.llm.urls import host_of
from palisade.sources.scratch import staged

#: Parts in which the streams of one host are aligned first.
SALTS = 16
#: Longest sequence of tokens that is tried as a repeated group.
REPEAT = 16
#: Text that pages share at one place is template if at least so many of them differ in their longest text.
SUPPORT = 3

# HTML element names by their kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title object math canvas select noframes noembed xmp".split())
LEFT_OUT = frozenset("nav header footer aside form head dialog menu button fieldset label".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "summary"}
#: What a new element ends, up to the elements after it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, {"html"}),
}
#: Words of class, id or role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars rail widget widgets "
    "notice notices cookie cookies consent gdpr alert alerts popup modal overlay toast newsletter subscribe subscription signup login signin register search searchbox "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager toolbar copyright colophon "
    "contentinfo complementary form disclaimer paywall skip talkback talkbacks guestbook responses".split()
)
#: Words of class, id or role that still leave an article or body element alone.
COMMENT_WORDS = frozenset("comment comments talkback talkbacks reply replies related recommended teaser ad ads advert advertisement sponsored promo".split())
#: Words that, on text blocks and sections, leave it to the wrapper whether the element is of the article.
DOUBTFUL_WORDS = frozenset("notice notices alert alerts discussion disclaimer related".split())

_REST = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
_TOKEN = re.compile(_REST + r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: The same for tags with a quote that is never closed: they end at the first ``>``.
_PLAIN = re.compile(_REST + r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Elements deeper than this are not told from the one at that depth.
DEPTH = 512
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_WORDS = re.compile(r"[a-z]+")
_TEXT_BLOCK = re.compile(r"(p|h\d|li|ul|ol|blockquote|pre|dl|dd|dt|figure|figcaption|t[dhr]|tbody|table)\b")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def label(tag: str, attributes: str) -> str:
    """An element's name in paths: tag and words, then ``!`` if it is left out, ``~`` if that is in doubt, or ``*`` if it is marked as the article."""
    if tag in LEFT_OUT:
        return tag + "!"
    if not attributes.strip():
        return tag + ("*" if tag in ("article", "main") else "")
    found = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(attributes)}
    words = [w for k in ("class", "id", "role") for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found.get(k, "")))]
    own = "." + ".".join(dict.fromkeys(words)) if words else ""
    out: frozenset[str] = ASIDE_WORDS if tag not in ("html", "body", "main", "article") else COMMENT_WORDS if tag == "article" else frozenset()
    against = out.intersection(words)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", ""))
    if hidden or against:
        return tag + own + ("~" if not hidden and against <= DOUBTFUL_WORDS and (tag == "section" or _TEXT_BLOCK.match(tag)) else "!")
    marked = tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
    return tag + own + ("*" if marked else "")


def next_tag(page: str, at: int, last: int, pattern: re.Pattern[str]) -> tuple[re.Match[str] | None, re.Pattern[str]]:
    """The next tag, comment or declaration from ``at`` on, and the pattern to go on with; ``last`` is the place of the last ``>``.

    A whole page takes time that grows with its length: the pattern in which quotes
    pair up fails once at most.
    """
    while (at := page.find("<", at)) >= 0:
        if at <= last or page.startswith(("<!--", "<![CDATA["), at):
            if m := pattern.match(page, at):
                return m, pattern
            if pattern is _TOKEN and (m := _PLAIN.match(page, at)):
                return m, _PLAIN
        at += 1
    return None, pattern


def stream(page: str | None) -> Iterator[tuple[str, str, str]]:
    """Well-formed tokens ``(kind, name, text)``: ``<`` and ``>`` with a label, ``#`` with a path and its text.

    Only block elements open and close; elements within a line vanish, except
    that a line break is white space. Left out elements that are no blocks
    (such as a span of an advert) count as blocks. A tag whose quotes are not
    closed ends at the next ``>``, a ``<`` that starts no tag is text, and
    elements nested deeper than ``DEPTH`` belong to the one at that depth.
    """
    page = page or ""
    open_: list[tuple[str, str, str]] = []  # tag, label, path
    deeper: Counter = Counter()
    path = ""
    at = 0

    def ends(n: int) -> Iterator[tuple[str, str, str]]:
        nonlocal path
        while len(open_) > n:
            yield ">", open_.pop()[1], ""
        path = open_[-1][2] if open_ else ""

    last, pattern = page.rfind(">"), _TOKEN
    while True:
        m, pattern = next_tag(page, at, last, pattern)
        if text := page[at : m.start() if m else len(page)]:
            yield "#", path, entities.unescape(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                yield "#", path, " "
            if deeper[tag]:
                deeper[tag] -= 1
                continue
            for n in range(len(open_) - 1, -1, -1):
                if open_[n][0] == tag:
                    yield from ends(n)
                    break
            continue
        attributes = m[3] or ""
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                close = _CLOSE[tag].search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                yield "#", path, " "
            continue
        name = label(tag, attributes)
        if tag not in BLOCKS and not name.endswith("!"):
            continue
        if tag in CLOSES_P:
            for n in range(len(open_) - 1, -1, -1):
                if open_[n][0] == "p":
                    yield from ends(n)
                    break
                if open_[n][0] not in ("span", "a", "b", "i", "em", "strong"):
                    break
        if tag in ENDS:
            over, stop = ENDS[tag]
            first = None
            for n in range(len(open_) - 1, -1, -1):
                if open_[n][0] in stop:
                    break
                if open_[n][0] in over:
                    first = n
            if first is not None:
                yield from ends(first)
        if len(open_) == DEPTH:
            deeper[tag] += 1
            yield "#", path, " "
            continue
        path = f"{path}/{name}" if path else name
        open_.append((tag, name, path))
        yield "<", name, ""
    yield from ends(0)


def runs(page: str | None) -> Iterator[tuple[str, str, str]]:
    """The stream with all text between two tags in one token, without white space at its ends or doubled; blank text goes."""
    held: list[str] = []
    path = ""
    for kind, name, text in stream(page):
        if kind == "#":
            held.append(text)
            path = name
            continue
        if text := " ".join("".join(held).split()):
            yield "#", path, text
        held.clear()
        yield kind, name, ""
    if text := " ".join("".join(held).split()):
        yield "#", path, text


def digest(text: str) -> str:
    return xxhash.xxh64(text.encode("utf-8", "surrogatepass")).hexdigest()


def skeleton(page: str | None) -> list:
    """The folded stream of a page.

    Its texts are ``["#", path, {digest: characters}, bodies, characters, pages]``:
    what all pages have there (on one page: all that it has), digests of the
    pages' longest texts (``SUPPORT`` at most), all characters there, and the
    number of pages.
    """
    tokens = list(runs(page))
    longest = max((t for k, p, t in tokens if k == "#" and "!" not in p), key=lambda t: (len(t), t), default="")
    body = [digest(longest)]
    return fold([["#", name, {digest(text): len(text)}, body, len(text), 1] if kind == "#" else kind + name for kind, name, text in tokens])


def shape(node: str | list) -> str:
    """A node without what is known of its texts; nodes of one shape match."""
    if isinstance(node, str):
        return node
    return "#" + node[1] if node[0] == "#" else "[" + "\n".join(map(shape, node)) + "]"


def together(nodes: list, alike: bool) -> str | list:
    """One node of several of one shape: of other pages (``alike``: what all have stays), or of the same pages, where all that any has stays."""
    x = nodes[0]
    if isinstance(x, str):
        return x
    if x[0] != "#":
        return [x[0], *(together(list(inner), alike) for inner in zip(*(n[1:] for n in nodes)))]
    if alike:
        texts = {k: v for k, v in x[2].items() if all(k in n[2] for n in nodes)}
    else:
        texts = {k: v for n in nodes for k, v in n[2].items()}
    bodies = sorted({k for n in nodes for k in n[3]})[:SUPPORT]
    return ["#", x[1], texts, bodies, sum(n[4] for n in nodes), sum(n[5] for n in nodes) if alike else max(n[5] for n in nodes)]


def _row(nodes: list, at: int, width: int, n: int) -> list:
    """``n`` adjacent repeats of ``width`` nodes as one."""
    return [together(nodes[at + d : at + n * width : width], False) for d in range(width)]


def fold(nodes: list) -> list:
    """Adjacent repeats as repeated groups ``["+", ...]``, shortest first."""
    names = [shape(x) for x in nodes]
    for width in range(1, REPEAT + 1):
        out: list = []
        seen: list[str] = []
        i = 0
        while i < len(nodes):
            body = names[i : i + width]
            n = 1
            while len(body) == width and names[i + n * width : i + (n + 1) * width] == body:
                n += 1
            if n > 1:
                own = _row(nodes, i, width, n)
                group = own[0] if width == 1 and isinstance(own[0], list) and own[0][0] == "+" else ["+", *own]
                out.append(group)
                seen.append(shape(group))
                i += n * width
            else:
                out.append(nodes[i])
                seen.append(names[i])
                i += 1
        nodes, names = out, seen
    return nodes


def _gathered(nodes: list, groups: list[list]) -> list:
    """Occurrences of the bodies of ``groups`` become repeated groups."""
    for g in groups:
        body, names, out, i = [shape(x) for x in g[1:]], [shape(x) for x in nodes], [], 0
        while i < len(nodes):
            n = 0
            while names[i + n * len(body) : i + (n + 1) * len(body)] == body:
                n += 1
            out.append(["+", *_row(nodes, i, len(body), n)] if n else nodes[i])
            i += n * len(body) or 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """One wrapper that fits what either fits."""
    plain = lambda x: [n for n in x if isinstance(n, list) and n[0] == "+"]
    if [shape(x) for x in a] == [shape(x) for x in b]:
        return [together([x, y], True) for x, y in zip(a, b)]
    a, b = _gathered(a, plain(b)), _gathered(b, plain(a))
    fa, fb = _opened(a, "a"), _opened(b, "b")
    out: list[tuple[str | list, tuple | None]] = []  # node, optional part that it belongs to
    fate: dict[tuple, set] = {}
    for n, (op, i, j, k, m) in enumerate(SequenceMatcher(None, [shape(x) for x, _ in fa], [shape(x) for x, _ in fb], autojunk=False).get_opcodes()):
        if op == "equal":
            for d, (x, y) in enumerate(zip(fa[i:j], fb[k:m])):
                for own in (x[1], y[1]):
                    fate.setdefault(own, set()).add("met")
                # optional on both sides: neither part need come whole any more
                out.append((together([x[0], y[0]], True), (n, d, "both") if x[1] and y[1] else x[1] or y[1]))
        else:
            for side, part in (("a", fa[i:j]), ("b", fb[k:m])):
                for node, own in part:
                    fate.setdefault(own, set()).add("alone")
                    out.append((node, own or (n, side)))
    merged: list = []
    last = None
    for d, (node, part) in enumerate(out):
        if part is not None and len(fate.get(part, ())) > 1:
            part = (d, "split")  # only some of the optional part is on the other side
        if part is None:
            merged.append(node)
        elif part == last:
            merged[-1].append(node)
        else:
            merged.append(["?", node])
        last = part
    return merged


def _opened(nodes: list, side: str) -> list[tuple[str | list, tuple | None]]:
    """The nodes, with the optional part that each belongs to."""
    out: list[tuple[str | list, tuple | None]] = []
    for n, x in enumerate(nodes):
        inner, own = (x[1:], (n, side, "old")) if isinstance(x, list) and x[0] == "?" else ([x], None)
        out += [(y, own) for y in inner]
    return out


def expression(nodes: list) -> list:
    """A wrapper without what is known of its texts: tags, ``#path``, groups."""
    return [n if isinstance(n, str) else "#" + n[1] if n[0] == "#" else [n[0], *expression(n[1:])] for n in nodes]


def texts_of(nodes: list) -> Iterator[list]:
    """The texts of a wrapper, in order."""
    for n in nodes:
        if isinstance(n, list):
            yield from [n] if n[0] == "#" else texts_of(n[1:])


def slots_of(wrapper: list) -> list[str]:
    """The paths of a wrapper's text slots, in order."""
    out: list[str] = []
    for n in wrapper:
        if isinstance(n, list):
            out += [n[1]] if n[0] == "#" else slots_of(n[1:])
        elif n[0] == "#":
            out.append(n[1:])
    return list(dict.fromkeys(out))


MARKS = (lambda x: x.startswith("article") and x.endswith("*"), lambda x: x.endswith("*"))


def _explicit(path: str) -> bool:
    """Whether an element that says it is the article (more than the page's main part) holds the text."""
    return any(x.endswith("*") and not x.startswith("main") and ".main" not in x for x in path.split("/"))


def _doubtful(path: str) -> str:
    """The innermost element of a path that is in doubt, as a path; empty if there is none."""
    return path[: path.rindex("~") + 1] if "~" in path else ""


def template_of(wrapper: list) -> list[str]:
    """``digest path`` of the texts that are the host's and not a page's: equal on all pages that have the place, and these pages differ elsewhere.

    What an article element holds is a page's own, but for elements in doubt.
    """
    return [f"{k} {n[1]}" for n in texts_of(wrapper) if len(n[3]) >= SUPPORT and "!" not in n[1] and ("~" in n[1] or not _explicit(n[1])) for k in n[2]]


def varying(wrapper: list) -> Counter:
    """The characters of each path's slots, without template text."""
    chars: Counter = Counter()
    for n in texts_of(wrapper):
        chars[n[1]] += n[4] - (n[5] * sum(n[2].values()) if len(n[3]) >= SUPPORT else 0)
    return chars


def talks(wrapper: list) -> set[str]:
    """Elements in doubt that hold repeated records, such as the replies of a discussion: groups of more than single text blocks."""
    out: set[str] = set()
    for n in wrapper:
        if isinstance(n, list) and n[0] != "#":
            tags = [x[1:] for x in expression(n[1:]) if isinstance(x, str) and x[0] == "<"]
            if n[0] == "+" and tags and (not _TEXT_BLOCK.match(tags[0]) or tags[0].startswith("li") and len(tags) > 1):
                out.update(_doubtful(x[1]) for x in texts_of(n[1:]))
            out |= talks(n[1:])
    return out - {""}


def article_slots(wrapper: list) -> list[list[str]]:
    """The slots that hold article text, for three kinds of pages; the element of the third kind; template text.

    Slots in left out elements never do, nor do those of elements in doubt that
    hold records. First those in an article element, for pages that have one;
    then those in any element marked as the main text; last, for pages with
    neither, those around the element whose own blocks vary by the most
    characters on all pages together, see ``_body``.
    """
    talked = talks(wrapper)
    free = [p for p in slots_of(wrapper) if "!" not in p and _doubtful(p) not in talked]
    tiers = [[p for p in free if any(map(mark, p.split("/")))] for mark in MARKS]
    best, body = _body(free, varying(wrapper))
    return [*tiers, body, [] if best is None else [best], template_of(wrapper)]


def _body(free: list[str], chars: dict[str, int]) -> tuple[str | None, list[str]]:
    """Of unmarked slots, the element whose own blocks hold the most characters; and the slots in it, in its siblings of the same tag, and in their parent's own blocks.

    Elements in doubt count only within it.
    """
    weight: Counter = Counter()
    for p in free:
        if "~" not in p and not any(map(MARKS[1], p.split("/"))):
            weight[_holder(p)] += chars.get(p, 0)
    if not weight:
        return None, []
    best = max(sorted(weight), key=weight.__getitem__)
    parent, _, name = best.rpartition("/")
    above = parent + "/" if parent else ""
    tag = name.partition(".")[0]
    beside = lambda p: p.startswith(above) and p[len(above) :].partition("/")[0].partition(".")[0] == tag
    around = lambda p: not best or beside(p) or (parent and _holder(p) == parent)
    return best, [p for p in free if (best and _under(p, best)) or ("~" not in p and around(p))]


def _under(path: str, element: str) -> bool:
    return not element or path == element or path.startswith(element + "/")


def _holder(path: str) -> str:
    """The element that a text block belongs to."""
    return path.rpartition("/")[0] if _TEXT_BLOCK.match(path.rpartition("/")[2]) else path


def main_text(page: str | None, content: list[list[str]]) -> str:
    """The text of the slots that suit the page: one space between words and blocks.

    A page without a marked element outside left out ones, and without text in
    its host's heaviest element, is of another template: its own heaviest counts.
    """
    tokens = list(runs(page))
    opened, out = set(), []
    for kind, name, _ in tokens:
        if kind == "<":
            out.append(name.endswith("!") or bool(out and out[-1]))
            if not out[-1]:
                opened.add(name)
        elif kind == ">":
            out.pop()
    tier = next((n for n, mark in enumerate(MARKS) if any(map(mark, opened))), 2)
    own = frozenset(content[tier]) if content else frozenset()
    template = frozenset(content[4]) if content else frozenset()
    shared = {t.partition(" ")[2] for t in template}
    rest = [(p, t) for k, p, t in tokens if k == "#" and "!" not in p and not (p in shared and f"{digest(t)} {p}" in template)]
    if tier == 2 and content:
        chars: Counter = Counter()
        for p, t in rest:
            chars[p] += len(t)
        if not any(_under(p, best) for best in content[3] for p in chars):
            own = frozenset(_body(list(chars), chars)[1])
    return " ".join(t for p, t in rest if p in own)


STREAM = "host string, shape string, wrapper string"


def _merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each value of ``keys``, from rows (host, shape, wrapper, ...) read in key order, equal shapes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([""]), pa.array([json.dumps(wrapper)])], ["host", "shape", "wrapper"])

        for b in batches:
            for host, salt, w in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                key = (host, salt)
                if key != now:
                    if now is not None:
                        yield row()
                    now, wrapper = key, json.loads(w)
                else:
                    wrapper = align(wrapper, json.loads(w))
        if now is not None:
            yield row()

    own = rows if "salt" in rows.columns else rows.withColumn("salt", F.lit(0))
    return own.repartition(*keys).sortWithinPartitions(*keys, "shape", "wrapper").select("host", "salt", "shape", "wrapper").mapInArrow(run, STREAM)


def infer(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, content)`` from all of ``pages(url, html)``: the wrapper as JSON, its article slots as ``article_slots`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], list] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = skeleton(page)
                key = host, digest("\n".join(map(shape, nodes)))
                found[key] = [together([x, y], True) for x, y in zip(found[key], nodes)] if key in found else nodes
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "shape", "wrapper"]
            )

    streams = short_batches(pages).select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, STREAM)
    parts = streams.withColumn("salt", F.pmod(F.hash("shape"), F.lit(SALTS)).cast("int"))
    whole = _merge(_merge(parts, ["host", "salt"]), ["host"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [json.loads(w) for w in b.column(2).to_pylist()]
            content = pa.array([article_slots(w) for w in known], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(expression(w)) for w in known], pa.string()), content], ["host", "wrapper", "content"])

    return whole.mapInArrow(mark, "host string, wrapper string, content array<array<string>>")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages(page_id, url, html)``, by the wrapper of its host.

    Returns ``page_id, url, text, n_chars`` (code points). Character references
    are decoded once, white space within a block is one space, blocks are
    joined by one space in page order. Template text needs ``SUPPORT`` pages of
    the host that differ in their longest text, so copies alone make none.

    A null html is empty and has an empty text, as has a page without article
    text. Pages with a null url, or one without a host, share the wrapper of the
    empty host. Unclosed and stray tags are repaired as they come. Repeated rows
    and null ids are kept; extra columns are not looked at; an empty table gives
    no rows.
    """
    known = staged(infer(pages).select(F.col("host").alias("of_host"), "content"), "wrappers")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    both = rows.join(known, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", "host", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [main_text(page, content or []) for page, content in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {dict(both.dtypes)['page_id']}, url string, text string, n_chars long")
