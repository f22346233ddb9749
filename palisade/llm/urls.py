"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

The trees are fitted on a bounded sample of labelled URLs and are then a
constant-size model, so scoring is one pass over the URL column without a
shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
#: Most labelled URLs the trees are fitted on.
SAMPLE = 20_000
#: Parts of that sample; a row's statistics come from the parts that it is not in.
FOLDS = 5
TREES = 40
DEPTH = 4
RATE = 0.2
BINS = 32
L2 = 1.0
SEED = 29


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.lit(r.name if what == "name" else r.verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


FEATURES = (
    "length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "path_digit_ratio", "entropy", "host_entropy",
    "parameters", "hyphens", "has_fragment", "is_https", "longest_number", "first_digit", "segment_length", "suffix_share", "suffix_block_rate",
    "section_share", "section_block_rate",
)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def _parts(url: str, host: str, path: str) -> tuple[str, str]:
    """The host's last label, and it with the path's first segment."""
    suffix = host.rpartition(".")[2]
    return suffix, f"{suffix}/{path.split('/', 2)[1] if path.startswith('/') else ''}"


def features(url: str | None, host: str, path: str, stats: dict[str, tuple[float, float]]) -> list[float]:
    """One row of FEATURES. ``stats``: share and block rate of suffixes and sections among labelled URLs."""
    u = url or ""
    query = u.partition("#")[0].partition("?")[2]
    digits = sum(c.isdigit() for c in u)
    path_digits = sum(c.isdigit() for c in path)
    runs = [len(x) for x in "".join(c if c.isdigit() else " " for c in path).split()]
    segments = [x for x in path.split("/") if x]
    last = segments[-1] if segments else ""
    suffix, section = _parts(u, host, path)
    return [
        len(u), len(host), len(path), host.count(".") + bool(host), len(segments), digits / max(1, len(u)), path_digits / max(1, len(path)), _entropy(u), _entropy(host),
        query.count("&") + bool(query), u.count("-"), "#" in u, u[:8].lower() == "https://", max(runs, default=0), float(next((c for c in last if c in "0123456789"), -1)), len(last),
        *stats.get(suffix, (0.0, 0.5)), *stats.get(section, (0.0, 0.5)),
    ]


def suffix_stats(rows: list[tuple[str, str, str, int]]) -> dict[str, tuple[float, float]]:
    """Share and smoothed block rate of each suffix and section of labelled ``(url, host, path, blocked)``."""
    seen: Counter = Counter()
    blocked: Counter = Counter()
    for url, host, path, y in rows:
        for k in _parts(url, host, path):
            seen[k] += 1
            blocked[k] += y
    return {k: (n / len(rows), (blocked[k] + 1) / (n + 2)) for k, n in seen.items()}


class Trees:
    """Gradient-boosted regression trees on the logistic loss, with histogram splits."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = L2):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.base = 0.0
        self.fitted: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            return self
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(p / (1 - p))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            nodes: list[tuple] = []
            self._grow(nodes, binned, edges, y - q, q * (1 - q), np.arange(len(y)), self.depth)
            self.fitted.append(nodes)
            score += self._one(nodes, x)
        return self

    def _grow(self, nodes, binned, edges, g, h, at, depth) -> int:
        me = len(nodes)
        total_g, total_h = g[at].sum(), h[at].sum()
        nodes.append((-1, 0.0, -1, -1, self.rate * total_g / (total_h + self.l2)))
        best = (1e-6, None, None)
        if depth and len(at) > 1:
            for f, e in enumerate(edges):
                if len(e):
                    gs = np.bincount(binned[at, f], g[at], len(e) + 1).cumsum()[:-1]
                    hs = np.bincount(binned[at, f], h[at], len(e) + 1).cumsum()[:-1]
                    gain = gs**2 / (hs + self.l2) + (total_g - gs) ** 2 / (total_h - hs + self.l2) - total_g**2 / (total_h + self.l2)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
        if best[1] is not None:
            _, f, k = best
            left = binned[at, f] <= k
            if left.any() and not left.all():
                a = self._grow(nodes, binned, edges, g, h, at[left], depth - 1)
                b = self._grow(nodes, binned, edges, g, h, at[~left], depth - 1)
                nodes[me] = (f, float(edges[f][k]), a, b, 0.0)
        return me

    @staticmethod
    def _one(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, at = todo.pop()
            f, cut, a, b, value = nodes[n]
            if f < 0:
                out[at] = value
            else:
                left = x[at, f] <= cut
                todo += [(a, at[left]), (b, at[~left])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for nodes in self.fitted:
            score += self._one(nodes, x)
        return 1 / (1 + np.exp(-score))


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> tuple[Trees, dict]:
    """Trees and suffix statistics from ``labelled(url, host, path, blocked)``.

    At most ``sample`` different URLs are fitted on: those of the smallest
    seeded hash, so the choice does not depend on the partitioning. Each is
    fitted on the statistics of the other ``FOLDS`` - 1 folds, and new URLs are
    judged by those of all.
    """
    picked = labelled.groupBy("url", "host", "path").agg(F.max("blocked").alias("blocked")).orderBy(F.xxhash64(F.lit(seed), "url"), "url").limit(sample)
    rows = sorted((r.url or "", r.host, r.path, int(r.blocked)) for r in picked.collect())
    stats = suffix_stats(rows)
    # a row's own label must not be in the rates that it is fitted on
    folds = [crc32((u + "\n" + h + p).encode("utf-8", "surrogatepass")) % FOLDS for u, h, p, _ in rows]
    others = [suffix_stats([r for r, f in zip(rows, folds) if f != k]) for k in range(FOLDS)]
    x = np.array([features(u, h, p, others[f]) for (u, h, p, _), f in zip(rows, folds)], float).reshape(len(rows), len(FEATURES))
    return Trees().fit(x, np.array([r[3] for r in rows], float)), stats


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Verdict for each row of ``pages(page_id, url)``.

    A rule fits its host and all its subdomains if the path starts with the
    rule's; the longest fitting rule decides (ties: the first in code point
    order). All other URLs are decided by the trees, at a block probability of
    one half. The trees learn from ``labelled(url, host, path, blocked)``; by
    default from the URLs that a rule decides.

    Returns ``page_id, host, path, rule, verdict, block_score``. A null url, or
    one without ``://``, has an empty host and path, fits no rule and goes to
    the trees; without any labelled URL the trees allow everything
    (probability one half is not above it). Repeated rows and null page ids are
    kept, extra columns are not looked at, an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", _longest(F.col("host"), F.col("path"), rules, "name"))
    rows = rows.withColumn("ruled", _longest(F.col("host"), F.col("path"), rules, "verdict"))
    if labelled is None:
        labelled = rows.where("rule is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("blocked"))
    trees, stats = fit(labelled, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            url, host, path, ruled = (b.column(i).to_pylist() for i in (1, 2, 3, 5))
            x = np.array([features(*r, stats) for r in zip(url, host, path)], float).reshape(len(url), len(FEATURES))
            p = trees.probability(x)
            verdict = [r or ("block" if q > 0.5 else "allow") for r, q in zip(ruled, p)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), b.column(4), pa.array(verdict, pa.string()), pa.array(p, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "block_score"],
            )

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, block_score double")
