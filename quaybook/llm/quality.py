"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled texts of good quality; all texts, taken without their labels, are the unlabelled set.  The class prior
is estimated by the best-bin bound: where negatives vanish, the unlabelled set is as dense as the prior times the positives.  A
logistic model over binned statistics of a text then minimises the non-negative unbiased risk, in which the estimated risk of the
negatives, unlabelled minus prior times positives, is never allowed below zero.  Its intercept is set so that the share of the unlabelled
texts at half or above is the prior.

Weights are fitted on bounded samples; the prior and the intercept come from histograms of the scores of all texts.

Defined cases: a null or empty text has the statistics of an empty one and gets a score; a null id takes no part in training;
without positives every score is 0.5; repeated rows are scored one by one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaybook.llm.shared import in_small_batches, one_label, settle

STATISTICS = (
    "log_chars", "log_words", "word_length", "long_word", "distinct_share", "repeat_share", "capital_share", "digit_share", "symbol_share",
    "pipe_share", "mark_share", "stop_share", "comma_share", "line_words", "distinct_lines", "wide_share",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*<>@^~_=+{}[]\\/", "|", "!?", ".", ",", "\n", " \t\r\x0b\x0c"), 1):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = 10


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text, whatever its language; see :data:`STATISTICS`."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[raw], minlength=11)
    words = text.split()
    lines = [s for s in text.split("\n") if s]
    chars, count = max(len(raw) - int(n[8]) - int(n[9]), 1), max(len(words), 1)
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), chars / count, max(map(len, words), default=0) / 10, distinct / count, again / count, n[1] / chars, n[2] / chars,
        n[3] / chars, n[4] / chars, n[5] / chars, n[6] / chars, n[7] / chars, count / max(len(lines), 1) / 10, len(set(lines)) / max(len(lines), 1), n[10] / chars,
    ]


@dataclass(frozen=True)
class PuConfig:
    #: About so many trusted positives and unlabelled texts are used at most to fit weights.
    most_positive: int = 12_000
    most_unlabelled: int = 24_000
    bins: int = 12
    steps: int = 250
    rate: float = 0.1
    decay: float = 1e-4


@dataclass
class PuModel:
    cuts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    prior: float = 0.5

    def design(self, x: np.ndarray) -> np.ndarray:
        """For each statistic, which of its cuts the value reaches; a constant comes last."""
        columns = [x[:, [k]] >= cut for k, cut in enumerate(self.cuts)]
        return np.concatenate([*columns, np.ones((len(x), 1), bool)], axis=1).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30).astype(float)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of each document."""
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_describe, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def counts_of_scores(rows: DataFrame, model: PuModel, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many texts score, before the logistic curve, below the first edge, from each edge to the next, and from the last on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(edges, model.design(_matrix(batch.column(0))) @ weights, "right"), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bin", "n"])

    out = np.zeros(len(edges) + 1, np.int64)
    for r in rows.select("x").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def levels_of(positive: np.ndarray) -> np.ndarray:
    """Thresholds at which shares are compared."""
    return np.quantile(np.sort(positive), np.linspace(0.0, 0.9, 91))


def best_bin(positive: np.ndarray, above_u: np.ndarray, unlabelled: int) -> float:
    """Least ratio of the shares above a threshold, with a margin for small samples."""
    p = np.sort(positive)
    above_p = 1 - np.searchsorted(p, levels_of(p)) / len(p)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(unlabelled))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate from held-back scores."""
    above = 1 - np.searchsorted(np.sort(unlabelled), levels_of(positive)) / len(unlabelled)
    return best_bin(positive, above, len(unlabelled))


def fit_nonnegative(a: np.ndarray, b: np.ndarray, prior: float, config: PuConfig) -> np.ndarray:
    """Weights that minimise the non-negative risk with logistic loss over positives ``a`` and unlabelled ``b``, by Adam."""
    w, m, v = np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1])
    soft = lambda z: np.logaddexp(0, z).mean()
    for t in range(1, config.steps + 1):
        za, zb = a @ w, b @ w
        pa_, pb = 1 / (1 + np.exp(-za)), 1 / (1 + np.exp(-zb))
        negative = soft(zb) - prior * soft(za)
        as_negative = b.T @ pb / len(b) - prior * (a.T @ pa_) / len(a)
        # below zero the negative part has been overfitted: walk it back instead
        g = prior * (a.T @ (pa_ - 1)) / len(a) + as_negative if negative >= 0 else -as_negative
        g = g + config.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - config.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, config: PuConfig = PuConfig()) -> PuModel:
    """Fit with positives among labels for whose rows ``may_learn`` holds."""
    return train_on(settle(described(docs)), labels, may_learn, config)


def train_on(rows: DataFrame, labels: DataFrame, may_learn: Column, config: PuConfig = PuConfig()) -> PuModel:
    """:func:`train` on what :func:`described` gives, which is read several times."""
    trusted = one_label(labels.where(may_learn), "quality", "y").where("y = 1").select("doc_id")
    n, total = trusted.count(), rows.count()
    if not n or not total:
        return PuModel()
    share = lambda most, of: int(1_000_000 * min(1, most / of))
    draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000))
    # bounded by most_positive, so it may be sent everywhere
    trusted = trusted.where(draw(1) < share(config.most_positive, n)).withColumn("positive", F.lit(1))
    # without an id there is nothing to draw by
    both = rows.where("doc_id is not null").join(F.broadcast(trusted), "doc_id", "left").withColumn("u", (draw(2) < share(config.most_unlabelled, total)).cast("int"))
    found = both.where("positive = 1 or u = 1").select(F.coalesce("positive", F.lit(0)).alias("positive"), "u", "x").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(STATISTICS))
    positive, unlabelled = x[found["positive"] == 1], x[found["u"] == 1]
    if not len(positive) or not len(unlabelled):
        return PuModel()
    tail = [0.002, 0.01, 0.03, *np.linspace(0.08, 0.92, config.bins), 0.97, 0.99, 0.998]
    model = PuModel(cuts=[np.unique(np.quantile(unlabelled[:, k], tail)) for k in range(x.shape[1])])
    a, b = model.design(positive), model.design(unlabelled)
    if len(a) > 1:
        # one half of the positives ranks the texts, the other tells the prior among all of them
        w = fit_nonnegative(a[::2], b[::2], 0.5, config)
        held = a[1::2] @ w
        edges = np.unique(levels_of(held))
        seen = counts_of_scores(rows, model, w, edges)
        above = (seen[::-1].cumsum()[::-1][1:] / total)[np.searchsorted(edges, levels_of(held))]
        model.prior = best_bin(held, above, total)
    model.weights = fit_nonnegative(a, b, model.prior, config)
    # as large a share of all texts scores half or more as the prior says are positive
    edges = np.linspace(-30, 30, 6001)
    below = counts_of_scores(rows, model, model.weights, edges).cumsum()[:-1]
    model.weights[-1] -= edges[min(int(np.searchsorted(below, (1 - model.prior) * total)), len(edges) - 1)]
    return model


def score(docs: DataFrame, model: PuModel) -> DataFrame:
    """``doc_id, score, predicted`` for each document."""
    return score_rows(described(docs), model)


def score_rows(rows: DataFrame, model: PuModel) -> DataFrame:
    """:func:`score` of what :func:`described` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
