"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

Features are numbers that any engine reads off a URL: lengths, depth, digit and hyphen counts, parameters,
entropy of the host, and how often labelled URLs with the same host suffix were bad. Trees are boosted by
Newton steps of the logistic loss over binned features, on a bounded labelled sample, and become nested
conditional expressions, so that scoring all pages is one projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: At most this many labelled URLs are learned from, those with the least hash.
MAX_LABELLED = 20_000
TREES, DEPTH, RATE, RIDGE, MIN_LEAF, BINS = 24, 3, 0.3, 1.0, 10, 32
#: A suffix counts as if this many more URLs with the average share of bad ones had it.
SUFFIX_PRIOR = 20.0
#: Score in log odds from which a URL is blocked.
BLOCK_FROM = 0.0

FEATURES = {
    "length": "length(__u)",
    "host_length": "length(host)",
    "labels": "size(split(host, '[.]'))",
    "host_hyphens": "length(host) - length(replace(host, '-', ''))",
    "host_digits": "length(host) - length(regexp_replace(host, '[0-9]+', ''))",
    "digit_permille": "(length(__u) - length(regexp_replace(__u, '[0-9]+', ''))) * 1000 div greatest(length(__u), 1)",
    "depth": "size(filter(split(path, '/'), x -> x <> ''))",
    "parameters": "if(instr(__u, '?') = 0, 0, size(split(regexp_extract(__u, '[?]([^#]*)', 1), '&')))",
    "longest_label": "array_max(transform(split(host, '[.]'), x -> length(x)))",
    "vowel_permille": "(length(host) - length(regexp_replace(host, '[aeiou]+', ''))) * 1000 div greatest(length(host), 1)",
    "entropy_milli": """cast(floor(1000 * aggregate(array_distinct(split(host, '')), 0d,
        (a, c) -> a - if(c = '' or host = '', 0d, (length(host) - length(replace(host, c, ''))) / length(host)
                         * log2((length(host) - length(replace(host, c, ''))) / length(host))))) as int)""",
    "suffix_milli": None,
}


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host with all its subdomains and for paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with ``host`` and ``path``; both empty for a null url or one without ://. Columns so named are replaced."""
    rest = F.expr(f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        pages.drop("host", "path")
        .withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), upper, lower))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def matching_rule(rules: Sequence[HostRule]) -> Column:
    """The longest rule that fits host and path, as a struct (rule, verdict); null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: int = 0
    low: Node | None = None
    high: Node | None = None


def _tree(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int) -> Node:
    g, h = float(grad.sum()), float(hess.sum())
    node = Node(-RATE * g / (h + RIDGE))
    if not depth or len(grad) < 2 * MIN_LEAF:
        return node
    best = (1e-6, -1, -1)
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        n = len(edge) + 1
        gs = np.cumsum(np.bincount(bins[:, f], grad, n))[:-1]
        hs = np.cumsum(np.bincount(bins[:, f], hess, n))[:-1]
        many = np.cumsum(np.bincount(bins[:, f], minlength=n))[:-1]
        gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g * g / (h + RIDGE)
        gain[(many < MIN_LEAF) | (len(grad) - many < MIN_LEAF)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), f, i)
    if best[1] < 0:
        return node
    _, node.feature, i = best
    node.threshold = int(edges[node.feature][i])
    low = bins[:, node.feature] <= i
    node.low = _tree(bins[low], edges, grad[low], hess[low], depth - 1)
    node.high = _tree(bins[~low], edges, grad[~low], hess[~low], depth - 1)
    return node


def _predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, _predict(node.low, x), _predict(node.high, x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Node]]:
    """Start score and trees for whole-number features x and labels y; one class alone gives a start score only."""
    if not len(y):
        return -1.0, []
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return base, []
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])[:-1]
        edges.append(values if len(values) < BINS else np.unique(values[np.linspace(0, len(values) - 1, BINS - 1).astype(int)]))
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    score, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(bins, edges, p - y, p * (1 - p), DEPTH))
        score += _predict(trees[-1], x)
    return base, trees


def tree_column(node: Node, names: Sequence[str]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(F.col(names[node.feature]) <= node.threshold, tree_column(node.low, names)).otherwise(tree_column(node.high, names))


def lexical(parsed: DataFrame, url: str, suffix_milli: Column) -> DataFrame:
    """parsed with a column f_<name> for each of FEATURES."""
    with_url = parsed.withColumn("__u", F.coalesce(F.col(url), F.lit("")))
    columns = {f"f_{k}": (suffix_milli if v is None else F.expr(v)).cast("int") for k, v in FEATURES.items()}
    return with_url.withColumns(columns).drop("__u")


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, "[.]"), -1)


@dataclass
class UrlModel:
    suffixes: dict[str, int]
    average: int
    base: float
    trees: list[Node]

    def score(self, parsed: DataFrame, url: str) -> DataFrame:
        """parsed with ``url_score``, the log odds that the URL is bad."""
        names = [f"f_{k}" for k in FEATURES]
        total = F.lit(self.base)
        for t in self.trees:
            total = total + tree_column(t, names)
        return lexical(parsed, url, self.suffix_column()).withColumn("url_score", total).drop(*names)

    def suffix_column(self) -> Column:
        out = None
        for k, v in sorted(self.suffixes.items()):
            out = F.when(suffix(F.col("host")) == k, v) if out is None else out.when(suffix(F.col("host")) == k, v)
        return F.lit(self.average) if out is None else out.otherwise(self.average)


#: Suffixes that get a statistic of their own; rarer ones share the average.
MAX_SUFFIXES = 64


def train(parsed: DataFrame, label: str, url: str = "url", max_labelled: int = MAX_LABELLED) -> UrlModel:
    """A model from the rows whose ``label`` is 1 (bad) or 0; null labels are passed over.

    Over max_labelled such rows, about as many whose URLs have the least hashes are taken.
    """
    names = [f"f_{k}" for k, v in FEATURES.items() if v is not None]
    rows = (
        lexical(parsed.filter(F.col(label).isNotNull()), url, F.lit(0))
        .select(F.xxhash64(url).alias("h"), F.col(label).cast("int").alias("y"), suffix(F.col("host")).alias("s"), *names)
        .dropDuplicates(["h"])
    )
    rows = sorted(bounded_sample(rows, "h", max_labelled))
    y = np.array([r["y"] for r in rows], np.float64)
    average = float(y.mean()) if len(y) else 0.0
    seen: dict[str, list[float]] = {}
    for r in rows:
        c = seen.setdefault(r["s"], [0.0, 0.0])
        c[0] += r["y"]
        c[1] += 1
    common = sorted(seen, key=lambda s: (-seen[s][1], s))[:MAX_SUFFIXES]
    rate = {s: round(1000 * (seen[s][0] + SUFFIX_PRIOR * average) / (seen[s][1] + SUFFIX_PRIOR)) for s in common}
    mean = round(1000 * average)
    x = np.array([[r[n] for n in names] + [rate.get(r["s"], mean)] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    base, trees = boost(x, y)
    return UrlModel(rate, mean, base, trees)


def filter_urls(pages: DataFrame, rules: Sequence[HostRule], label: Column, url: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """pages with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``url_score``.

    The longest rule that fits decides; where none does, the trees do, trained on the rows for which ``label``
    (an expression over host and path: 1 bad, 0 good, null unknown) isn't null. A null url, or one without
    ://, has an empty host and path and is judged like any other. Repeated URLs get equal verdicts; other
    columns are kept, those with these names replaced; an empty table gives an empty result.
    """
    own = pages.drop("rule", "verdict", "url_score")
    parsed = parse_urls(own, url).withColumn("__rule", matching_rule(rules))
    model = train(parsed.withColumn("__label", F.when(F.col("__rule").isNull(), label)), "__label", url, max_labelled)
    scored = model.score(parsed, url)
    by_trees = F.when(F.col("url_score") > BLOCK_FROM, "block").otherwise("allow")
    return (
        scored.withColumn("rule", F.col("__rule")["rule"])
        .withColumn("verdict", F.coalesce(F.col("__rule")["verdict"], by_trees))
        .drop("__rule")
    )
