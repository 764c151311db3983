"""A quality classifier by co-training of two views.

One view reads the text (counts and shares over the whole of it), the other the page's metadata (source,
language, length). Each view has a logistic model with a ridge. First both learn from the labelled documents.
Then, in each round, every unlabelled document of which one view is confident becomes a pseudo-labelled one
for the other view, and both learn anew. All of this is done FOLDS times side by side, each time without the
labels of one fold of the documents. At last each view's log odds are calibrated on the labelled documents, and a
last logistic model combines the two; there a document has the odds that the views without its label give it. All
documents are scored by the mean of the folds' views.

Fitting is distributed and covers all rows: a Newton step is one pass over the features, in which each task
adds up a small gradient and Hessian for both views of each fold. Pseudo-labels are functions of the last round's
weights, so they are never stored. Only sums of fixed size reach the driver. Sums are added in the order of the
tasks, so a job that runs again over the same written features gives the same weights bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text_stats import RATIOS, text_stats

ROUNDS = 2
#: Passes over the features: at first, in each round, and for the combination.
FIRST_PASSES, ROUND_PASSES, LAST_PASSES = 10, 5, 6
RIDGE = 1.0
#: Parts of the labelled documents; each is left out of the views that calibration on it uses.
FOLDS = 3
#: A view labels a document for the other one if it gives one class at least this probability.
CONFIDENT = 0.95
#: A pseudo-label counts as this much of a label.
PSEUDO_WEIGHT = 0.3
SOURCE_BUCKETS = 16
LANGUAGES = ("en", "de", "fr", "es")
#: Documents with at least this combined probability of good quality are kept.
KEEP_FROM = 0.35


def _text_view() -> list[Column]:
    """Logarithms of the shares, each below 10 or so, and three of them squared."""
    logs = [F.log1p(F.greatest(F.expr(v), F.lit(0)).cast("double")) for v in RATIOS.values()]
    length = F.expr(RATIOS["chars_per_100_words"]).cast("double")
    return [*logs, F.abs(length - 600) / 200, F.expr("double(n_words < 10)"), F.expr("double(n_lines > 0 and n_upper > 0.5 * word_chars)")]


def _meta_view(source: Column, lang: Column, n_chars: Column) -> list[Column]:
    bucket = F.pmod(F.xxhash64(F.coalesce(source.cast("string"), F.lit(""))), F.lit(SOURCE_BUCKETS))
    size = F.log1p(F.greatest(F.coalesce(n_chars.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return [
        size / 5,
        (size - 7) * (size - 7) / 10,
        *[(bucket == i).cast("double") for i in range(SOURCE_BUCKETS)],
        *[F.coalesce((lang == name).cast("double"), F.lit(0.0)) for name in LANGUAGES],
    ]


def features(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """A row for each document: keep columns, ``xa`` and ``xb`` (arrays of doubles), ``y`` (double, null if unlabelled) and ``fold``."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__label_id"))
        .agg(F.round(F.avg(label)).cast("double").alias("y"))
    )
    have = {c: (F.col(c) if c in docs.columns else F.lit(None)) for c in ("source", "lang", "n_chars")}
    own = docs.select(
        F.col(doc_id).alias("__id"), F.col(text).alias("__text"), *[have[c].alias(f"__{c}") for c in have], *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    )
    stats = text_stats(own, "__text")
    table = stats.select(
        "__id",
        *[f"__keep_{i}" for i in range(len(keep))],
        F.array(F.lit(1.0), *_text_view()).alias("xa"),
        F.array(F.lit(1.0), *_meta_view(F.col("__source"), F.col("__lang"), F.col("__n_chars"))).alias("xb"),
    )
    joined = table.join(known, F.col("__id") == F.col("__label_id"), "left")
    return cut(joined.select(*[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)], "xa", "xb", "y", F.pmod(F.xxhash64("__id"), F.lit(FOLDS)).cast("int").alias("fold")))


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w, -30, 30)


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def _newton_parts(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Loss, gradient and Hessian of the weighted logistic loss at w."""
    odds = _odds(x, w)
    p = _probability(odds)
    curve = weight * np.maximum(p * (1 - p), 1e-6)
    loss = weight @ (np.logaddexp(0, odds) - y * odds)
    return [np.array([loss]), x.T @ (weight * (p - y)), ((x * curve[:, None]).T @ x).ravel()]


def _table(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


@dataclass
class Views:
    """Weights of both views, and of the round before (for pseudo-labels; none in the first)."""

    a: np.ndarray
    b: np.ndarray
    last: tuple[np.ndarray, np.ndarray] | None = None


def _sent(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A task's sums with its number, by which they are put in order."""
    from pyspark import TaskContext

    if total is not None:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
    return _table(batch, "xa"), _table(batch, "xb"), y, batch.column("fold").to_numpy(zero_copy_only=False)


def _view_sums(folds: list[Views]):
    """For each fold the parts of both views, without its labels; then the number of labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            xa, xb, y, fold = _columns(batch)
            known = ~np.isnan(y)
            parts = []
            for f, views in enumerate(folds):
                told = known & (fold != f)
                for x, w, teacher in ((xa, views.a, 1), (xb, views.b, 0)):
                    target, weight = np.where(told, y, 0.0), told.astype(float)
                    if views.last is not None:
                        p = _probability(_odds((xa, xb)[teacher], views.last[teacher]))
                        sure = ~known & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
                        target, weight = np.where(sure, np.round(p), target), np.where(sure, PSEUDO_WEIGHT, weight)
                    used = weight > 0
                    parts += _newton_parts(x[used], target[used], weight[used], w)
            sums = np.concatenate([*parts, [known.sum()]])
            total = sums if total is None else total + sums
        yield from _sent(total)

    return run


def _stack_sums(folds: list[Views], w: np.ndarray):
    """Parts of both calibrations and of the combination, over odds from the views without a row's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            xa, xb, y, fold = _columns(batch)
            for f, views in enumerate(folds):
                own = ~np.isnan(y) & (fold == f)
                x = np.stack([np.ones(int(own.sum())), _odds(xa[own], views.a), _odds(xb[own], views.b)], 1)
                parts = []
                for columns, k in (([0, 1], 0), ([0, 2], 1), ([0, 1, 2], 2)):
                    parts += _newton_parts(x[:, columns], y[own], np.ones(len(x)), w[k][: len(columns)])
                sums = np.concatenate(parts)
                total = sums if total is None else total + sums
        yield from _sent(total)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            sums = np.frombuffer(x.as_buffer(), np.float64)
            total = sums if total is None else total + sums
    yield from _sent(total)


def _total(table: DataFrame, run) -> np.ndarray | None:
    """The sums of all tasks, added up in two levels, each in the order of its tasks; the driver gets a bounded number of rows."""
    schema = "part int, sums binary"
    partial = table.select("xa", "xb", "y", "fold").mapInArrow(run, schema)
    some = partial.repartition(8, F.col("part") % 8).sortWithinPartitions("part")
    rows = sorted(some.mapInArrow(_add, schema).collect())
    out = None
    for r in rows:
        sums = np.frombuffer(r["sums"], np.float64)
        out = sums if out is None else out + sums
    return out


class _Newton:
    """Newton steps with a ridge that are halved until the loss falls; it needs one pass for each point tried."""

    def __init__(self, w: np.ndarray) -> None:
        self.at = self.best = w
        self.least, self.move = np.inf, np.zeros(len(w))
        self.pull = np.full(len(w), RIDGE)
        self.pull[0] = 1e-6

    def restart(self) -> None:
        """The loss is another one from now on."""
        self.at, self.least = self.best, np.inf

    def see(self, sums: np.ndarray) -> None:
        n = len(self.at)
        loss = sums[0] + 0.5 * self.pull @ self.at**2
        if loss <= self.least:
            self.best, self.least = self.at, loss
            self.move = np.linalg.solve(sums[1 + n :].reshape(n, n) + np.diag(self.pull), sums[1 : 1 + n] + self.pull * self.at)
        else:
            self.move = self.move / 4
        self.at = self.best - self.move


@dataclass
class CoTrained:
    views: Views
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def score(self, table: DataFrame) -> DataFrame:
        """table without features, with ``text_score``, ``meta_score`` and ``quality_score``, probabilities of good quality."""

        def dot(x: str, w: np.ndarray) -> Column:
            weights = F.array(*[F.lit(float(v)) for v in w])
            raw = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            return F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0))

        def sure(odds: Column) -> Column:
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

        (a0, a1), (b0, b1), (c0, c1, c2) = (tuple(map(float, w)) for w in (*self.calibration, self.combined))
        both = table.withColumn("__a", dot("xa", self.views.a)).withColumn("__b", dot("xb", self.views.b))
        return both.withColumns(
            {
                "text_score": sure(F.lit(a0) + a1 * F.col("__a")),
                "meta_score": sure(F.lit(b0) + b1 * F.col("__b")),
                "quality_score": sure(F.lit(c0) + c1 * F.col("__a") + c2 * F.col("__b")),
            }
        ).drop("xa", "xb", "y", "fold", "__a", "__b")


def fit(table: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """Both views and their combination from the rows of features(). Without labels every score is one half."""
    first = table.select(F.size("xa").alias("a"), F.size("xb").alias("b")).first()
    da, db = (first["a"], first["b"]) if first else (1, 1)
    even = (np.array([0.0, 1.0]), np.array([0.0, 1.0])), np.array([0.0, 0.5, 0.5])
    sides = [(_Newton(np.zeros(da)), _Newton(np.zeros(db))) for _ in range(FOLDS)]
    last: list = [None] * FOLDS
    for turn in range(rounds + 1):
        for _ in range(ROUND_PASSES if turn else FIRST_PASSES):
            sums = _total(table, _view_sums([Views(a.at, b.at, x) for (a, b), x in zip(sides, last, strict=True)]))
            if sums is None or not sums[-1]:
                return CoTrained(Views(np.zeros(da), np.zeros(db)), *even)
            cut_at = 1 + da + da * da
            for (a, b), part in zip(sides, np.split(sums[:-1], FOLDS), strict=True):
                a.see(part[:cut_at])
                b.see(part[cut_at:])
        last = [(a.best, b.best) for a, b in sides]
        for side in sides:
            for view in side:
                view.restart()
    folds = [Views(a.best, b.best) for a, b in sides]
    views = Views(np.mean([v.a for v in folds], axis=0), np.mean([v.b for v in folds], axis=0))
    stack = [_Newton(w) for w in (*even[0], even[1])]
    for _ in range(LAST_PASSES):
        sums = _total(table, _stack_sums(folds, [s.at for s in stack]))
        for s, part in zip(stack, np.split(sums, [7, 14]), strict=True):
            s.see(part)
    return CoTrained(views, (stack[0].best, stack[1].best), stack[2].best)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    doc_id: str = "doc_id",
    rounds: int = ROUNDS,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, extra columns of docs, text_score, meta_score, quality_score, kept) for each row of docs.

    docs may have ``source``, ``lang`` and ``n_chars``; a missing or null one counts as none. labels has
    (doc_id, label), 1 for good and 0 for bad; labels of one doc_id are averaged, null ones passed over. A
    null or empty text has no words and is scored as such. Equal rows get equal scores. Without labels all
    scores are one half and every row is kept. An empty table gives an empty result.
    """
    table = features(docs, labels.select("doc_id", label), label, text, doc_id, [doc_id, *extra])
    scored = fit(table, rounds).score(table)
    return scored.withColumnRenamed(doc_id, "doc_id").withColumn("kept", F.col("quality_score") >= KEEP_FROM)
