"""URL filter: rules by host and path, and boosted trees on lexical features for what no rule decides.

Features are read off the URL alone: lengths, depths, digit ratios, entropies,
parameter counts, and statistics of host suffixes (how often URLs below a suffix
are blocked among the labelled ones, also with the path's first segment).  Trees
are fitted by gradient boosting with histograms in numpy on a bounded sample of
labelled URLs, and sent to the tasks once.  Only URLs are read and moved, and
only those of the sample leave their task.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import log, log1p, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.worker import held

ALLOW, BLOCK = "allow", "block"

# Labelled URLs that trees are fitted on.
SAMPLE_ROWS = 8000
FOLDS = 5

ROUNDS = 60
DEPTH = 3
BINS = 64
RATE = 0.2
RIDGE = 1.0
# Share of blocked URLs that training weighs the labelled ones to: lists of rules hold more blocked places than the web,
# and a URL of which nothing is known is to be let through.
BLOCKED_SHARE = 0.25
# Labelled URLs that a suffix is taken to have had before any is seen.
PRIOR = 4.0

_CUT = re.compile(r"[/?#]")


# --- parts of a URL -----------------------------------------------------------------


def host_of(url: str) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    """From the end of the host to the next ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))


# --- rules --------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(lines: Iterable[str]) -> list[Rule]:
    """Rules from lines like ``block example.com/en/``."""
    made = []
    for line in lines:
        verdict, _, place = line.strip().partition(" ")
        host, slash, path = place.strip().partition("/")
        if verdict not in (ALLOW, BLOCK) or not host:
            raise ValueError(f"no rule: {line!r}")
        made.append(Rule(verdict, host.lower(), slash + path))
    return made


class RuleBook:
    """Finds the longest rule that fits by looking up the host's suffixes."""

    def __init__(self, given: list[Rule]):
        self.by_host: dict[str, list[Rule]] = defaultdict(list)
        # Of rules for the same place the blocking one is met first.
        for rule in sorted(given, key=lambda r: (-len(r.path), r.path, r.verdict != BLOCK)):
            self.by_host[rule.host].append(rule)
        self.labels = max((h.count(".") + 1 for h in self.by_host), default=0)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule (host and path together, then the longer host) that fits."""
        best: Rule | None = None
        labels = host.rsplit(".", self.labels)[-self.labels :] if self.labels else []
        for i in range(len(labels)):  # the longest suffix first
            for rule in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
        return best


# --- features -----------------------------------------------------------------------


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return log2(n) - sum(c * log2(c) for c in Counter(text).values()) / n if n else 0.0


def _digits(text: str) -> float:
    return sum(map(text.count, string.digits)) / len(text) if text else 0.0


def parts(url: str) -> tuple[str, str, str, str]:
    """Host, path, query and fragment, as :func:`host_of` and :func:`path_of` cut them."""
    before, mark, rest = url.partition("://")
    if not mark:
        return "", "", "", ""
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in host), slash + path, query, fragment


def shape(url: str) -> list[float]:
    """Features that need no labels."""
    host, path, query, fragment = parts(url)
    labels = host.split(".")
    segments = [s for s in path.split("/") if s]
    letters = sum(map(str.isalnum, url))
    last = segments[-1] if segments else ""
    return [
        len(url),
        len(host),
        len(path),
        len(query),
        len(fragment),
        len(labels) if host else 0,
        len(segments),
        _digits(url),
        _digits(host),
        _digits(path),
        entropy(url),
        entropy(host),
        entropy(path),
        query.count("&") + 1 if query else 0,
        query.count("=") + query.count("%"),
        max(map(len, labels)),
        host.count("-"),
        1 - letters / len(url) if url else 0.0,
        float(url.startswith("https:")),
        len(last) - last.rfind(".") if "." in last else 0,
        float(path.endswith("/")),
    ]


def suffixes(url: str) -> list[str]:
    """The host's last one, two and three labels and the host, alone and with the path's first segment.

    What a host is too short for is left empty."""
    host, path, _, _ = parts(url)
    labels = host.rsplit(".", 3)
    head = "/" + path.split("/", 2)[1] if path.startswith("/") else ""
    found = [".".join(labels[-n:]) if len(labels) >= n else "" for n in (1, 2, 3)] + [host]
    return [*found, *[s + head if s else "" for s in found]]


SHAPES = len(shape(""))
LEVELS = len(suffixes(""))


@dataclass
class Statistics:
    """Labelled and blocked URLs by level and suffix."""

    share: float
    counts: list[dict[str, tuple[int, int]]] = field(default_factory=list)

    def of(self, keys: list[list[str]], minus: Statistics | None = None) -> np.ndarray:
        """Smoothed log odds of a block and log count for every level; without what ``minus`` has counted."""
        base = log(self.share / (1 - self.share))
        rows = np.zeros((len(keys), 2 * LEVELS))
        for row, names in zip(rows, keys):
            for level, name in enumerate(names):
                n, blocked = self.counts[level].get(name, (0, 0)) if name else (0, 0)
                if minus is not None and n:
                    less_n, less_blocked = minus.counts[level].get(name, (0, 0))
                    n, blocked = n - less_n, blocked - less_blocked
                likely = (blocked + PRIOR * self.share) / (n + PRIOR)
                row[2 * level] = log(likely / (1 - likely)) - base
                row[2 * level + 1] = log1p(n)
        return rows


def count(keys: list[list[str]], labels: list[int], share: float) -> Statistics:
    found: list[dict[str, tuple[int, int]]] = [{} for _ in range(LEVELS)]
    for names, label in zip(keys, labels):
        for counts, name in zip(found, names):
            if name:
                n, blocked = counts.get(name, (0, 0))
                counts[name] = (n + 1, blocked + label)
    return Statistics(share, found)


# --- boosted trees ------------------------------------------------------------------


@dataclass
class Tree:
    """A complete binary tree: at node i go to 2i+1, or to 2i+2 if the feature is above the threshold."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def value(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        while len(self.features) and node[:1].size and node[0] < len(self.features):
            node = 2 * node + 1 + (x[row, self.features[node]] > self.thresholds[node])
        return self.leaves[node - len(self.features)]


def best_splits(
    binned: np.ndarray, node: np.ndarray, slope: np.ndarray, curve: np.ndarray, nodes: int, ridge: float = RIDGE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every node the feature and the bin after which to split, and the gain, from histograms."""
    features = binned.shape[1]
    best_gain, best_feature, best_bin = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, BINS)
    g_all = np.bincount(node, slope, nodes)[:, None]
    h_all = np.bincount(node, curve, nodes)[:, None]
    for f in range(features):
        cell = node * BINS + binned[:, f]
        g = np.bincount(cell, slope, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
        h = np.bincount(cell, curve, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
        gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
        at = gain.argmax(axis=1)
        most = gain[np.arange(nodes), at]
        better = most > best_gain + 1e-9
        best_gain[better], best_feature[better], best_bin[better] = most[better], f, at[better]
    return best_feature, best_bin, best_gain


def boost(
    x: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE
) -> tuple[float, list[Tree]]:
    """Weighted logistic loss by Newton steps: the log odds to start from, and the trees."""
    share = min(max(float(np.average(y, weights=weights)), 0.01), 0.99)
    base = log(share / (1 - share))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, trees = np.full(len(y), base), []
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        slope, curve = weights * (y - p), weights * p * (1 - p)
        features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            feature, cut, gain = best_splits(binned, node - first, slope, curve, nodes)
            for i in range(nodes):
                if gain[i] > 0 and cut[i] < len(edges[feature[i]]):
                    features[first + i], thresholds[first + i] = feature[i], edges[feature[i]][cut[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[node]] > thresholds[node])
        leaf = node - inner
        step = np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + RIDGE)
        trees.append(Tree(features, thresholds, rate * step))
        score = score + rate * step[leaf]
    return base, trees


# --- the model ----------------------------------------------------------------------


@dataclass
class Model:
    statistics: Statistics
    base: float
    trees: list[Tree]

    def scores(self, urls: list[str]) -> np.ndarray:
        """Probability of a block; equal URLs are judged once."""
        distinct = list(dict.fromkeys(urls))
        if not self.trees:
            return np.full(len(urls), 1 / (1 + np.exp(-self.base)))
        x = np.hstack([np.array([shape(u) for u in distinct]).reshape(-1, SHAPES), self.statistics.of([suffixes(u) for u in distinct])])
        found = 1 / (1 + np.exp(-(self.base + sum(tree.value(x) for tree in self.trees))))
        place = {u: i for i, u in enumerate(distinct)}
        return found[[place[u] for u in urls]] if urls else found[:0]


def train(rows: list[tuple[str, int]], rounds: int = ROUNDS) -> Model:
    """Trees from (url, 1 if blocked).  Without rows, or with one kind only, the score is a constant.

    A row's suffix statistics leave out its own fold, so that a label does not
    explain itself.  Every row is also shown without them, as a URL below
    suffixes that are not known.
    """
    rows = sorted(rows)
    labels = [label for _, label in rows]
    keys = [suffixes(url) for url, _ in rows]
    if len(set(labels)) < 2:
        share = 0.99 if labels and labels[0] else 0.01
        return Model(count(keys, labels, share), log(share / (1 - share)), [])
    share = sum(labels) / len(labels)
    whole = count(keys, labels, share)
    fold = np.array([zlib.crc32(url.encode("utf-8", "surrogatepass")) % FOLDS for url, _ in rows])
    x = np.zeros((2 * len(rows), SHAPES + 2 * LEVELS))
    x[:, :SHAPES] = 2 * [shape(url) for url, _ in rows]
    for k in range(FOLDS):
        mine = np.flatnonzero(fold == k).tolist()
        own = count([keys[i] for i in mine], [labels[i] for i in mine], share)
        x[mine, SHAPES:] = whole.of([keys[i] for i in mine], minus=own)
    y = np.array(2 * labels, float)
    base, trees = boost(x, y, np.where(y == 1, BLOCKED_SHARE / share, (1 - BLOCKED_SHARE) / (1 - share)), rounds)
    return Model(whole, base, trees)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most ``rows`` different URLs of ``labelled`` (url, blocked), by the smallest hashes.

    URLs that certainly have larger hashes are dropped before anything is
    shuffled.  A URL with both labels counts as blocked; null URLs and labels are
    left out.
    """
    usable = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    different = usable.agg(F.approx_count_distinct("url").alias("n")).first()["n"]
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    # Three times the wanted number, which an estimate within a few percent cannot miss.
    limit = (1 << 40) * 3 * rows // max(different, 1)
    each = usable.where(place < F.lit(limit)).groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("blocked"))
    chosen = each.orderBy(F.xxhash64("url"), "url").limit(rows)
    return [(r["url"], r["blocked"]) for r in chosen.collect()]


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Trees from a bounded sample of ``labelled`` (url, blocked)."""
    return train(sample(labelled, rows))


# --- tables -------------------------------------------------------------------------


def decided(urls: DataFrame, given: list[Rule]) -> DataFrame:
    """Add host, path, rule and rule_verdict to ``urls`` (url); null where no rule fits.  Columns of these names are replaced."""
    added = ["host", "path", "rule", "rule_verdict"]
    urls = urls.drop(*added)
    told = urls.withColumns({"host": host_of("url"), "path": path_of("url")})
    names = told.columns

    def found(batches):
        book = held("rules", given, lambda: RuleBook(given))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            fits = [book.find(h, p) for h, p in zip(hosts, paths)]
            texts = pa.array([r and r.text for r in fits], pa.string())
            verdicts = pa.array([r and r.verdict for r in fits], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts, verdicts], [*names, *added[2:]])

    schema = told.select("*", *[F.lit(None).cast("string").alias(c) for c in added[2:]]).schema
    return told.mapInArrow(found, schema)


def with_verdicts(rows: DataFrame, model: Model) -> DataFrame:
    """Add score and verdict to :func:`decided` rows: the rule's verdict, else a block from a score of 0.5 on.

    The score is null where a rule decides.  A null URL is scored as an empty one."""
    rows = rows.drop("score", "verdict")
    names = rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        for batch in batches:
            ruled = batch.column("rule_verdict").to_pylist()
            urls = batch.column("url").to_pylist()
            scores = iter(shared.value.scores([u or "" for u, v in zip(urls, ruled) if v is None]).tolist())
            found = [None if v else next(scores) for v in ruled]
            verdicts = [v or (BLOCK if s >= 0.5 else ALLOW) for v, s in zip(ruled, found)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array(verdicts, pa.string())], [*names, "score", "verdict"]
            )

    schema = rows.select("*", F.lit(None).cast("double").alias("score"), F.lit("").cast("string").alias("verdict")).schema
    return rows.mapInArrow(judged, schema)


def judge(pages: DataFrame, given: list[Rule], labelled: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Verdict on every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    Rules decide first.  The trees for what is left learn from ``labelled`` (url,
    blocked), by default from the URLs that a rule decides.  Null URLs and URLs
    without ``://`` have an empty host and path, so no rule fits them.  Without
    labelled URLs everything left is allowed; with one kind it gets that kind's
    verdict.  Rows that repeat are judged alike, other columns are not read, an
    empty table gives no rows.
    """
    ruled = decided(pages.select("page_id", "url"), given)
    if labelled is None:
        labelled = decided(pages.select("url"), given).where(F.col("rule").isNotNull())
        labelled = labelled.select("url", (F.col("rule_verdict") == BLOCK).alias("blocked"))
    found = with_verdicts(ruled, fit(labelled, rows))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")
