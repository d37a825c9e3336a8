"""Toxic passages by maximum-scoring segments of token log-odds.

Training counts, over a bounded sample of labelled rows, in how many toxic and clean texts each token occurs; log-odds under an
informative Dirichlet prior, with their variances, give the tokens that speak for or against toxicity.  A text becomes a sequence of
scores: those tokens score their log-odds, of either sign, and all others, whose odds the sample leaves open, cost a little.  One linear
scan finds every maximal-scoring segment.
Segment scores are put on a common scale by extreme-value statistics, lambda from the clean token distribution and K from
clean training texts, and a logistic curve over that scale gives the score of a text.

Defined cases: a null or empty text has no tokens and gets the curve's value for no segment; a null id takes no part in training;
without labels of both classes, or without a token that speaks for toxicity, every score is 0; repeated rows are scored one by one; other columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaybook.llm.shared import crc_of_id, in_small_batches, one_label, settle

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that count as tokens too, so that inflected forms support each other.
STEMS = (7, 5)


def with_stems(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer ones marked by an asterisk."""
    return words.union(*({f"{w[:n]}*" for w in words if len(w) > n} for n in STEMS))


class _Lookup(dict):
    """Score of any word: its own, else that of its longest beginning that has one, else 0; a bounded number is remembered."""

    def __init__(self, scores: dict[str, float], most: int = 100_000) -> None:
        super().__init__()
        self.scores, self.most = scores, most

    def __missing__(self, word: str) -> float:
        found = self.scores.get(word)
        for n in STEMS:
            if found is None and len(word) > n:
                found = self.scores.get(f"{word[:n]}*")
        if len(self) >= self.most:
            self.clear()
        self[word] = found = found or 0.0
        return found


@dataclass(frozen=True)
class ToxicConfig:
    #: About so many labelled rows enter training and calibration.
    most_labelled: int = 40_000
    #: Weight of the prior as a share of the counted tokens; least z-score, log-odds and number of texts, of either sign, of a token that scores.
    prior_share: float = 0.02
    least_z: float = 4.0
    least_odds: float = 1.0
    least_texts: int = 5
    #: What any other token costs a segment, and the expected number of chance segments up to which one is significant.
    gap_cost: float = 0.1
    significant: float = 0.05


@dataclass
class ToxicModel:
    scores: dict[str, float] = field(default_factory=dict)
    gap_cost: float = 0.1
    rate: float = 1.0
    scale: float = 1.0
    #: Intercept and weights of the logistic curve over :meth:`statistics`; empty: the score is 0.
    curve: tuple[float, ...] = ()
    lookup: _Lookup | None = None

    def bits(self, score: float, tokens: int) -> float:
        """Segment score on the scale on which the expected number of chance segments is exp(-bits)."""
        return self.rate * score - math.log(self.scale * max(tokens, 1))

    def statistics(self, text: str | None) -> tuple[float, float, float, list[tuple[int, int, float]], int]:
        """Calibrated best segment, segment mass, share of scoring tokens, the segments, and the number of tokens."""
        words = _WORD.findall(text.lower()) if text else []
        if self.lookup is None:
            self.lookup = _Lookup(self.scores)
        hits = [(i, s) for i, s in enumerate(map(self.lookup.__getitem__, words)) if s]
        if not hits:
            return 0.0, 0.0, 0.0, [], len(words)
        found = segments(hits, self.gap_cost)
        n = len(words)
        if not found:
            return 0.0, 0.0, 0.0, [], n
        best = max(s for _, _, s in found)
        mass = sum(s for _, _, s in found)
        return max(self.bits(best, n), -5.0) + 6.0, math.log1p(mass), sum(s > 0 for _, s in hits) / n, found, n

    def score(self, best: float, mass: float, share: float) -> float:
        if not self.curve:
            return 0.0
        z = self.curve[0] + self.curve[1] * best + self.curve[2] * mass + self.curve[3] * min(share * 50, 5.0)
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def segments(hits: list[tuple[int, float]], gap_cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first token, end token, score)`` of a sequence given by its scores of either sign, in linear time.

    Tokens that are not listed cost ``gap_cost`` each.  Candidates lie on a list with the running totals before and after them; a new one
    joins those from the nearest candidate that began lower, if that one ended lower too.  Each keeps the place of the nearest one that
    began lower, so no candidate is passed over twice; without one, all before are final and leave the list.
    """
    done: list[tuple[int, int, float]] = []
    low_of: list[float] = []
    high_of: list[float] = []
    first_of: list[int] = []
    end_of: list[int] = []
    lower: list[int] = []
    total, at = 0.0, 0
    for i, score in hits:
        low = total - gap_cost * (i - at)
        total, at = low + score, i + 1
        if score <= 0:
            continue
        first = i
        while True:
            k = len(low_of) - 1
            while k >= 0 and low_of[k] >= low:
                k = lower[k]
            if k < 0:
                done += [(a, b, high - start) for start, high, a, b in zip(low_of, high_of, first_of, end_of, strict=True)]
                for x in (low_of, high_of, first_of, end_of, lower):
                    x.clear()
                break
            if high_of[k] >= total:
                break
            low, first = low_of[k], first_of[k]
            for x in (low_of, high_of, first_of, end_of, lower):
                del x[k:]
        low_of.append(low)
        high_of.append(total)
        first_of.append(first)
        end_of.append(i + 1)
        lower.append(k)
    return done + [(a, b, high - start) for start, high, a, b in zip(low_of, high_of, first_of, end_of, strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts ``token, toxic, clean, seen``: texts of each class with the token, and its occurrences in clean ones."""
    texts, seen = (Counter(), Counter()), Counter()

    def out() -> pa.RecordBatch:
        words = list(texts[1] | texts[0])
        rows = [[c[w] for w in words] for c in (texts[1], texts[0], seen)]
        for c in (*texts, seen):
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(r, pa.int64()) for r in rows)], names=["token", "toxic", "clean", "seen"])

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall((text.as_py() or "").lower())
            texts[label].update(with_stems(set(words)))
            if not label:
                seen.update(words)
                seen.update(f"{w[:n]}*" for w in words for n in STEMS if len(w) > n)
            if len(texts[0]) + len(texts[1]) > 300_000:
                yield out()
    yield out()


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, may_learn: Column, most: int) -> DataFrame:
    """``doc_id, text, y`` for about ``most`` labelled rows at most; texts that are exact copies come once."""
    usable = one_label(labels.where(may_learn), column, "y")
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded by `most`, so it may be sent everywhere; so may the ids of one row for each text
    hashed = rows.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(usable), "doc_id")
    once = hashed.groupBy("h").agg(F.min(F.struct("doc_id", "y")).alias("r")).select("r.doc_id", "r.y").distinct()
    return rows.join(F.broadcast(once), "doc_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, config: ToxicConfig = ToxicConfig()) -> ToxicModel:
    """Fit on labels for whose rows ``may_learn`` holds."""
    sample = labelled_sample(docs, labels, "toxic", may_learn, config.most_labelled)
    model = ToxicModel(gap_cost=config.gap_cost)
    counts = sample.mapInArrow(_count, "token string, toxic long, clean long, seen long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "seen")])
    counts = settle(counts)
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum("seen").alias("s")).first()
    t, c, seen = (float(totals[k] or 0) for k in "tcs")
    if not t or not c:
        return model
    a = config.prior_share * (t + c)
    prior = (F.col("toxic") + F.col("clean")) * (a / (t + c))
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + a - F.col(y) - prior))
    scored = counts.where(F.col("toxic") + F.col("clean") >= config.least_texts).select(
        "token", "seen", (odds("toxic", t) - odds("clean", c)).alias("d"), (1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("v")
    )
    z = F.col("d") / F.sqrt("v")
    # at most as many as the tokens that least_texts texts of the bounded sample share
    chosen = scored.where((F.abs(z) >= config.least_z) & (F.abs("d") >= config.least_odds)).orderBy("token").collect()
    model.scores = {r["token"]: r["d"] for r in chosen}
    if not any(d > 0 for d in model.scores.values()):
        return model
    chance = [((r["seen"] + 0.5) / (seen + 0.5 * len(chosen)), r["d"]) for r in chosen]
    model.rate = _rate(chance, config.gap_cost)
    stats = np.array(sample.mapInArrow(_statistics(model), "y int, best double, mass double, share double, top double, tokens long").collect(), dtype=float).reshape(-1, 6)
    y, x = stats[:, 0], stats[:, 1:4].copy()
    model.scale = _scale(stats[y == 0], model.rate)
    some = stats[:, 4] > 0
    x[some, 0] = np.maximum(model.rate * stats[some, 4] - np.log(model.scale * np.maximum(stats[some, 5], 1)), -5) + 6
    x[:, 2] = np.minimum(x[:, 2] * 50, 5)
    model.curve = logistic(x, y)
    return model


def _rate(chance: list[tuple[float, float]], gap_cost: float) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1 over clean tokens, by bisection."""
    rest = max(1 - sum(p for p, _ in chance), 1e-6)
    excess = lambda r: sum(p * math.exp(min(r * s, 300)) for p, s in chance) + rest * math.exp(-r * gap_cost) - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def _scale(clean: np.ndarray, rate: float) -> float:
    """K such that as many clean texts as seen have a segment above the median of those that have any."""
    some = clean[clean[:, 4] > 0]
    if not len(some):
        return 1.0
    level = float(np.median(some[:, 4]))
    share = (some[:, 4] >= level).sum() / len(clean)
    return float(max(-math.log(max(1 - share, 1e-9)) / (max(clean[:, 5].mean(), 1.0) * math.exp(-rate * level)), 1e-9))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[float, ...]:
    """Intercept and weights by Newton's method with a small ridge on the weights."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *([ridge] * x.shape[1])])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _statistics(model: ToxicModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.statistics(t.as_py()) for t in batch.column(0)]
            columns = [[r[k] for r in rows] for k in range(3)]
            top = [max((s for _, _, s in r[3]), default=0.0) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), *(pa.array(c, pa.float64()) for c in (*columns, top)), pa.array([r[4] for r in rows], pa.int64())],
                names=["y", "best", "mass", "share", "top", "tokens"],
            )

    return run


_SCORED = "doc_id long, key long, score double, passages array<struct<start:int,end:int,score:double,expected:double>>"
_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def score(docs: DataFrame, model: ToxicModel, config: ToxicConfig = ToxicConfig()) -> DataFrame:
    """``doc_id, key, score, predicted, passages``; ``key`` is ``xxhash64(text)``, passages are significant ones in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for cell in batch.column(2):
                text = cell.as_py()
                best, mass, share, found, n = model.statistics(text)
                scores.append(model.score(best, mass, share))
                kept = [(a, b, s, e) for a, b, s in found if (e := math.exp(-max(model.bits(s, n), -30))) <= config.significant]
                spans = [m.span() for m in _WORD.finditer(text.lower())] if kept else []
                # lower-casing may lengthen a text; offsets then refer to the lower-cased one
                passages.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "expected": e} for a, b, s, e in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(passages, _PASSAGES)], names=["doc_id", "key", "score", "passages"]
            )

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, _SCORED)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of the id's checksum; null for a null id."""
    return F.pmod(crc_of_id(doc_id), F.lit(parts))


def reject_toxic(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig()) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic; repeated rows and those without an id are judged one by one."""
    model = train(docs, labels, fold(F.col("doc_id"), 5) != 0, config)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = [model.score(*model.statistics(t.as_py())[:3]) < 0.5 for t in texts]
            yield batch.filter(pa.array(keep))

    return in_small_batches(docs).mapInArrow(judge, docs.schema)
