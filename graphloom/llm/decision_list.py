"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: a rule is grown one threshold condition at a time by the gain in
information on two thirds of the rows, pruned back on the other third, and taken if it is precise enough there;
then the rows that it covers go and the next rule is learned. The list becomes one ordered conditional
expression over columns, so that scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text_stats import RATIOS, labelled_sample, text_stats

#: At most this many labelled rows are learned from, those whose doc_id has the least hash.
MAX_LABELLED = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
#: Thresholds that are tried for a feature at most, at even ranks.
MAX_THRESHOLDS = 64
#: Of the pruning rows that a rule covers, this share must be bad; below it learning stops.
MIN_PRECISION = 0.9
MIN_COVERED = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold}"


Rule = tuple[Condition, ...]


def _covers(rule: Sequence[Condition], x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        column = x[:, names.index(c.feature)]
        out &= column > c.threshold if c.above else column <= c.threshold
    return out


def _gain(p0: int, n0: int, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and bad.any() and not bad.all():
        best = (1e-9, None, None)
        p0, n0 = int(bad.sum()), int((~bad).sum())
        for k, name in enumerate(names):
            values = np.unique(x[:, k])[:-1]
            if len(values) > MAX_THRESHOLDS:
                values = values[np.linspace(0, len(values) - 1, MAX_THRESHOLDS).astype(int)]
            if not len(values):
                continue
            low_p = np.searchsorted(np.sort(x[bad, k]), values, side="right")
            low_n = np.searchsorted(np.sort(x[~bad, k]), values, side="right")
            for above, p1, n1 in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gains = _gain(p0, n0, p1, n1)
                i = int(np.argmax(gains))
                if gains[i] > best[0]:
                    best = (float(gains[i]), Condition(name, above, int(values[i])), None)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _covers(rule[-1:], x, names)
        x, bad = x[inside], bad[inside]
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> tuple[list[Condition], float]:
    """The shortest beginning of rule that is best on rows it wasn't grown on, and its precision there."""
    best, worth, precision = rule, -2.0, 0.0
    for n in range(1, len(rule) + 1):
        inside = _covers(rule[:n], x, names)
        p, q = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p + q >= MIN_COVERED and (p - q) / (p + q) > worth + 1e-12:
            best, worth, precision = rule[:n], (p - q) / (p + q), p / (p + q)
    return best, precision


def learn(rows: list[tuple], names: Sequence[str]) -> list[Rule]:
    """Rules for bad rows, in order, from (hash, label 1 good or 0 bad, features...). Without bad or good rows: none."""
    if not rows:
        return []
    table = np.array(rows, np.int64)
    prune_part = table[:, 0] % 3 == 0
    bad, x = table[:, 1] == 0, table[:, 2:]
    rules: list[Rule] = []
    left = np.ones(len(table), bool)
    while len(rules) < MAX_RULES:
        grow, check = left & ~prune_part, left & prune_part
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grow(x[grow], bad[grow], names)
        if not rule:
            break
        rule, precision = _prune(rule, x[check], bad[check], names)
        if precision < MIN_PRECISION:
            break
        rules.append(tuple(rule))
        left &= ~_covers(rule, x, names)
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; 0 if none."""
    out = None
    for i, rule in enumerate(rules, 1):
        met = F.expr(" AND ".join(c.sql() for c in rule))
        out = F.when(met, i) if out is None else out.when(met, i)
    return (F.lit(0) if out is None else out.otherwise(0)).cast("int")


def apply_rules(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED
) -> tuple[DataFrame, list[Rule]]:
    """The counts of text_stats() for each row, with ``base_failed``, ``rule`` and ``kept``; and the rules.

    base_failed: under 10 words, or over a fifth of the words in repeated windows. rule is the number of the
    learned rule that the row meets, 0 for none. kept is false where base_failed or a rule holds. A null or
    empty text has no words, so it fails. Labels are 1 for good and 0 for bad; without both kinds no rule is
    learned. Rows may repeat; columns of docs with these names are replaced; an empty table stays empty.
    """
    labels = labels.select(F.col("doc_id"), F.col(label))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = cut(text_stats(own))
    ratios = stats.withColumns({f"r_{k}": F.expr(v) for k, v in RATIOS.items()})
    names = [f"r_{k}" for k in RATIOS]
    rules = learn(labelled_sample(ratios, labels, label, names, max_labelled), names)
    judged = ratios.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", F.expr("not base_failed and rule = 0")).drop(*names), rules
