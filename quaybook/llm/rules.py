"""Quality rules as a learned decision list, with DataFrame functions only.

Sequential covering: rules are grown literal by literal on one half of the labelled rows, each literal a
threshold on one statistic of a text, pruned on the other half, and what they cover is taken away before the next
rule.  All counting happens in Spark over cells of binned statistics; the driver sees counts for each
(statistic, bin) only.  The list comes out as one ordered conditional expression.  It is learned from a bounded sample of labelled rows, so
the statistics of all others are taken once, where they are judged.

Defined cases: a null or empty text has no words and fails the base rules; an empty label table gives the empty list,
which keeps whatever passes the base rules; a null id takes no part in learning; repeated rows are judged one by one; other columns are
left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaybook.llm.shared import WHITE, crc_of_id, one_label, settle, with_words

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: Statistics that literals may test, as expressions over the counts of :func:`with_statistics`.
RATIOS = ("symbol_share", "capital_share", "digit_share", "mark_share", "word_length", "distinct_share", "repeat_share", "dup_line_share")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice, given the hash of the window at each position."""

    def measure(pairs: Column) -> Column:
        twice = F.filter(
            F.transform(
                pairs,
                lambda p, i: F.when((p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]), p["i"]),
            ),
            lambda i: i.isNotNull(),
        )
        # positions in order; each adds the words that the window before it does not hold already
        return F.aggregate(
            F.array_sort(twice),
            F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")),
            lambda a: a["n"],
        )

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.transform(F.array(pairs), measure)[0]


def with_statistics(df: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Add the struct ``name``: the base counts and the ratios that literals test.  Nothing is shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = with_words(df, text)
    words = F.col("__qb_words")
    # the array enters the lambda through a variable of its own, so its elements are reached in constant time
    hashes = F.transform(
        F.array(words),
        lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )[0]
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(f"[^{WHITE}]"))
    out = out.withColumns({"__qb_hashes": hashes, "__qb_lines": lines})
    hashes, lines = F.col("__qb_hashes"), F.col("__qb_lines")
    long = lambda c: c.cast("long")
    out = out.withColumn(
        "__qb_base",
        F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.translate(body, " \t\n\x0b\f\r", ""))).alias("word_chars"),
            _count_of(body, SYMBOLS).alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("long")).otherwise(_covered_words(hashes)).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(F.array_distinct(words))).alias("n_distinct"),
            _count_of(body, CAPITALS).alias("n_capitals"),
            _count_of(body, DIGITS).alias("n_digits"),
            _count_of(body, "!?").alias("n_marks"),
        ),
    )
    b = F.col("__qb_base")
    of = lambda a, n: (b[a] / F.greatest(b[n], F.lit(1))).cast("double")
    ratios = {
        "symbol_share": of("n_symbols", "word_chars"),
        "capital_share": of("n_capitals", "word_chars"),
        "digit_share": of("n_digits", "word_chars"),
        "mark_share": of("n_marks", "word_chars"),
        "word_length": of("word_chars", "n_words"),
        "distinct_share": of("n_distinct", "n_words"),
        "repeat_share": of("n_repeat_words", "n_words"),
        "dup_line_share": of("n_dup_lines", "n_lines"),
    }
    fields = [b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    stats = F.struct(*fields, *[e.alias(c) for c, e in ratios.items()])
    return out.withColumn(name, stats).drop("__qb_words", "__qb_hashes", "__qb_lines", "__qb_base")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Literal:
    statistic: str
    at_least: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = stats[self.statistic]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose literals all hold rejects the text, and without any it is kept."""

    rules: list[tuple[Literal, ...]] = field(default_factory=list)

    def kept(self, stats: Column) -> Column:
        if not self.rules:
            return F.lit(True)
        chain = None
        for rule in self.rules:
            holds = F.lit(True)
            for x in rule:
                holds = holds & x.column(stats)
            chain = F.when(holds, F.lit(False)) if chain is None else chain.when(holds, F.lit(False))
        return chain.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) or "keep"


@dataclass(frozen=True)
class CoverConfig:
    #: About so many labelled rows are learned from at most.
    most_labelled: int = 40_000
    max_rules: int = 32
    max_literals: int = 4
    #: Least rows that a rule must cover in each half, and least share of them that must be labelled 0.
    min_cover: int = 5
    min_precision: float = 0.9
    #: Quantiles of each class that may be thresholds; the extremes part a class that lies apart.
    quantiles: tuple[float, ...] = (0.0, 0.002, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.998, 1.0)


def learn(labelled: DataFrame, config: CoverConfig = CoverConfig()) -> DecisionList:
    """Learn the list from ``(stats, bad 0/1, grow boolean)`` rows that passed the base rules."""
    shares = F.array(*[F.lit(q) for q in config.quantiles])
    cuts = labelled.agg(
        *[
            F.percentile_approx(F.when(F.col("bad") == bad, F.col("stats")[r]), shares, 10000).alias(f"{r}_{bad}")
            for r in RATIOS
            for bad in (0, 1)
        ]
    ).first()
    thresholds = {r: sorted({x for bad in (0, 1) for x in (cuts[f"{r}_{bad}"] or [])}) for r in RATIOS}
    thresholds = {r: t for r, t in thresholds.items() if t}
    if not thresholds:
        return DecisionList()
    names = list(thresholds)
    # bin b: exactly the first b thresholds are at most the value
    def bin_of(statistic: str) -> Column:
        value = F.col("stats")[statistic]
        return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds[statistic]]), lambda t: t <= value))

    binned = {f"b{k}": bin_of(r) for k, r in enumerate(names)}
    cells = labelled.select("bad", "grow", *[e.alias(n) for n, e in binned.items()])
    cells = settle(cells.groupBy(*binned, "grow").agg(F.count_if(F.col("bad") == 1).alias("p"), F.count_if(F.col("bad") == 0).alias("n")))

    def inside(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for k, up, b in rule:
            out = out & (F.col(f"b{k}") >= b if up else F.col(f"b{k}") < b)
        return out

    found: list[list[tuple[int, bool, int]]] = []
    rest = cells
    while len(found) < config.max_rules:
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < config.max_literals:
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("b")) for k in range(len(names))]))
            counts = (
                rest.where(F.col("grow") & inside(rule)).select("p", "n", each.alias("x")).groupBy("x.k", "x.b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
            )
            best = _best_literal(counts, [len(thresholds[r]) for r in names], config.min_cover)
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        fits = [F.sum(F.when(inside(rule[: i + 1]), F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(len(rule)) for c in "pn"]
        seen = rest.where(~F.col("grow")).agg(*fits).first()
        held = [(seen[f"p{i}"] or 0, seen[f"n{i}"] or 0) for i in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in held]
        keep = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = held[keep]
        if p < config.min_cover or p < config.min_precision * (p + n):
            break
        rule = rule[: keep + 1]
        found.append(rule)
        rest = rest.where(~inside(rule))
    return DecisionList([tuple(Literal(names[k], up, thresholds[names[k]][b - 1]) for k, up, b in rule) for rule in found])


def _best_literal(counts: list, sizes: list[int], least: int) -> tuple[tuple[int, bool, int], int] | None:
    """The literal of most information gain, and how many rows labelled 1 it still covers."""
    total_p = sum(r["p"] for r in counts if r["k"] == 0)
    total_n = sum(r["n"] for r in counts if r["k"] == 0)
    if total_p < least or total_n == 0:
        return None
    before = math.log2(total_p / (total_p + total_n))
    best = None
    for k, size in enumerate(sizes):
        p_of, n_of = [0] * (size + 1), [0] * (size + 1)
        for r in counts:
            if r["k"] == k:
                p_of[r["b"]] += r["p"]
                n_of[r["b"]] += r["n"]
        for b in range(1, size + 1):
            for up in (True, False):
                part = slice(b, None) if up else slice(None, b)
                p, n = sum(p_of[part]), sum(n_of[part])
                if p < least or n == total_n:
                    continue
                gain = p * (math.log2(p / (p + n)) - before)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, (k, up, b), n)
    return best and (best[1], best[2])


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, stats, label`` of about ``most`` labelled documents at most."""
    usable = one_label(labels, "quality", "__qb_label")
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # bounded by `most`, so it may be sent everywhere
    chosen = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    return with_statistics(chosen).select("doc_id", "stats", F.col("__qb_label").alias("label"))


def learn_from(docs: DataFrame, labels: DataFrame, config: CoverConfig = CoverConfig()) -> DecisionList:
    """Learn from documents and the label table; halves are dealt by a checksum of the id."""
    stats = labelled_statistics(docs, labels, config.most_labelled).where(~base_failed(F.col("stats")))
    return learn(settle(stats.select("stats", (1 - F.col("label")).alias("bad"), (F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) != 0).alias("grow"))), config)


def apply_rules(docs: DataFrame, labels: DataFrame, config: CoverConfig = CoverConfig()) -> tuple[DataFrame, DecisionList]:
    """One row for each document with its statistics and verdict, and the list that gave it."""
    model = learn_from(docs, labels, config)
    s = F.col("stats")
    out = with_statistics(docs.select("doc_id", "text")).select(
        "doc_id",
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & model.kept(s)).alias("kept"),
    )
    return out, model


def keep_good(docs: DataFrame, labels: DataFrame, config: CoverConfig = CoverConfig()) -> DataFrame:
    """The documents that the rules keep, with all their columns; repeated rows and those without an id are judged one by one."""
    model = learn_from(docs, labels, config)
    s = F.col("__qb_stats")
    return with_statistics(docs, "text", "__qb_stats").where(~base_failed(s) & model.kept(s)).drop("__qb_stats")
