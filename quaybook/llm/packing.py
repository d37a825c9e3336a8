"""Packing token sequences into fixed windows by non-negative least squares over a length histogram.

Each document's ids, an end id included, are cut into whole windows and a remainder.  Only the histogram of remainder
lengths reaches the driver (at most window - 1 rows).  There, shallow combinations of lengths that fill a window exactly
are enumerated, their repeat counts fitted to the histogram by non-negative least squares, rounded down to what is there, and
whatever is left is packed greedily end to end, cut where a window ends.  The resulting plan has a bounded number of rows
and places a remainder by its length and its rank among equal lengths, so no document is ever gathered anywhere.

Defined cases: a null or empty text is a document of the end id alone; repeated rows and null ids are packed as rows of their
own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import string
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaybook.llm.shared import crc32_of_ids, in_small_batches, settle

#: The longest word that is remembered.
CACHED_LENGTH = 40
_workers: dict[str, _Encoder] = {}


@dataclass(frozen=True)
class PackConfig:
    tokenizer_path: str
    window: int = 2048
    end_id: int = 1
    #: Words that a Python worker remembers, at 200 bytes each or so.
    cached_words: int = 1_200_000
    #: This many combinations of at most four lengths enter a fit.
    max_combinations: int = 4096
    #: Lengths, most frequent first, tried as the middle part of a combination of three.
    middle_lengths: int = 48
    sweeps: int = 40
    #: How often the fit is repeated on what the rounding left, with four lengths from the middle of the turns on.
    turns: int = 8
    #: Rows up to which the remainders that are cut are broadcast to look up their ids.
    broadcast_rows: int = 200_000


class _Encoder:
    """Ids of whole texts by way of words that are remembered, for tokenizers that allow it.

    That is, for those that lower-case, drop white space and mark the end of a word in its last id: a text's ids are then those of
    its words in order, and one call encodes many words, told apart by that mark.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_words = bool(suffix) and '"Lowercase"' in json.dumps(spec["normalizer"]) and '"Removed"' in json.dumps(spec["pre_tokenizer"])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.by_words:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in the cache yet."""
        simple = {w for w in words if w.isalpha() and max(w) < "\u0130"}
        # a word and the run of punctuation after it are two words to the tokenizer
        stopped = [(w, c, w[len(c) :]) for w in words.difference(simple) if (c := w.rstrip(string.punctuation)) != w and c.isalpha() and max(c) < "\u0130"]
        known: dict[str, bytes] = {}
        plain = list(simple.union(c for _, c, _ in stopped if c not in self.cache))
        if plain:
            # each of these is one word to the tokenizer, so as many ids carry the mark
            raw, start = self.whole([" ".join(plain)])[0], 0
            ids = np.frombuffer(raw, "<u4")
            for word, end in zip(plain, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                known[word] = raw[start:end]
                start = end
        done = {w for w, _, _ in stopped}
        other = list({t for _, _, t in stopped if t not in self.cache}.union(w for w in words if w not in known and w not in done))
        known.update(zip(other, self.whole(other), strict=True))
        for word, core, tail in stopped:
            known[word] = (known[core] if core in known else self.cache[core]) + (known[tail] if tail in known else self.cache[tail])
        return known

    def texts(self, texts: list[str], most: int) -> list[bytes]:
        if len(self.cache) > most:
            self.cache = {"": b""}
        split = [t.lower().replace("\n", " ").split(" ") for t in texts]
        fresh = self.learn(set().union(*split).difference(self.cache))
        self.cache.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHED_LENGTH)
        long = {w: ids for w, ids in fresh.items() if len(w) > CACHED_LENGTH}
        known = ChainMap(self.cache, long) if long else self.cache
        return [b"".join(map(known.__getitem__, words)) for words in split]


#: Strings whose case the tokenizer treats unlike Python, or in which it looks for special tokens.
_UNUSUAL = ("<|", "\u0130", "\u03a3")


def encode_texts(texts: list[str | None], path: str, cached_words: int = 1_200_000) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; the worker remembers about ``cached_words`` words."""
    if path not in _workers:
        _workers[path] = _Encoder(path)
    encoder, out = _workers[path], []
    for at in range(0, len(texts), 128):
        part = [t or "" for t in texts[at : at + 128]]
        usual = [encoder.by_words and not any(x in t for x in _UNUSUAL) for t in part]
        by_words = iter(encoder.texts([t for t, u in zip(part, usual, strict=True) if u], cached_words))
        whole = iter(encoder.whole([t for t, u in zip(part, usual, strict=True) if not u]))
        out += [next(by_words if u else whole) for u in usual]
    return out


_TOKENIZED = "doc_id long, tokens long, part long, first_full long, full array<struct<crc:long,ids:binary>>, rem int, rank long, rem_crc long, rem_ids binary"


def tokenize(docs: DataFrame, config: PackConfig, with_ids: bool = False) -> DataFrame:
    """One row for each document: its whole windows and its remainder, numbered within the partition."""
    window, end, path = config.window, np.array([config.end_id], "<u4").tobytes(), config.tokenizer_path
    full_type = pa.list_(pa.struct([("crc", pa.int64()), ("ids", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_full, ranks = TaskContext.get().partitionId(), 0, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows: list[tuple] = []
                for ids in encode_texts(batch.column(1).to_pylist(), path, config.cached_words):
                    ids += end
                    cut = len(ids) // 4 // window * window * 4
                    full = [ids[i : i + 4 * window] for i in range(0, cut, 4 * window)]
                    rest = ids[cut:]
                    rem = len(rest) // 4
                    rank = ranks.get(rem, 0)
                    ranks[rem] = rank + 1
                    chunks = [{"crc": crc32_of_ids(x), "ids": x if with_ids else None} for x in full]
                    rows.append((len(ids) // 4, n_full, chunks, rem, rank, crc32_of_ids(rest), rest))
                    n_full += len(full)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array(cols[0], pa.int64()),
                        pa.array([part] * len(rows), pa.int64()),
                        pa.array(cols[1], pa.int64()),
                        pa.array(cols[2], full_type),
                        pa.array(cols[3], pa.int32()),
                        pa.array(cols[4], pa.int64()),
                        pa.array(cols[5], pa.int64()),
                        pa.array(cols[6], pa.binary()),
                    ],
                    names=["doc_id", "tokens", "part", "first_full", "full", "rem", "rank", "rem_crc", "rem_ids"],
                )

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENIZED)


def combinations(histogram: dict[int, int], config: PackConfig, depth: int = 3) -> list[tuple[int, ...]]:
    """Up to ``depth`` lengths, 3 or 4, that fill the window exactly; those of frequent lengths come first."""
    window, found = config.window, set()
    lengths = sorted(histogram)
    frequent = sorted(histogram, key=lambda n: (-histogram[n], n))[: config.middle_lengths if depth == 3 else config.middle_lengths // 4]
    middles = [(0,), *((b,) for b in frequent)]
    if depth > 3:
        middles += [(b, c) for i, b in enumerate(frequent) for c in frequent[i:]]
    for middle in middles:
        rest = window - sum(middle)
        for a in lengths:
            if a > rest - a:
                break
            if rest - a in histogram:
                found.add(tuple(sorted(n for n in (a, *middle, rest - a) if n)))
    return sorted(found, key=lambda c: (-min(histogram[n] for n in c), c))[: config.max_combinations]


def nonnegative_least_squares(columns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int) -> np.ndarray:
    """x >= 0 that brings the lengths used by x repeats of the columns near the histogram, by coordinate descent."""
    left = {n: float(c) for n, c in histogram.items()}
    parts = [[(n, c.count(n)) for n in sorted(set(c))] for c in columns]
    norms = [float(sum(k * k for _, k in p)) for p in parts]
    x = np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            step = max(sum(k * left[n] for n, k in p) / norms[j], -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in p:
                    left[n] -= k * step
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], config: PackConfig) -> tuple[list[tuple[int, int, int, int, int, bool]], int]:
    """Rows ``(length, first rank, end rank, base, offset, stream)`` and the number of windows that combinations fill.

    Ranks of a row without ``stream`` go to windows base, base + 1, ...; those with it lie end to end from position base on.
    """
    used = dict.fromkeys(histogram, 0)
    rows: list[tuple[int, int, int, int, int, bool]] = []
    windows = 0
    for turn in range(config.turns):
        left = {n: c - used[n] for n, c in histogram.items() if c > used[n]}
        columns = combinations(left, config, 3 if turn < config.turns // 2 else 4)
        if not columns:
            continue
        x = nonnegative_least_squares(columns, left, config.sweeps)
        for j in sorted(range(len(columns)), key=lambda j: (-x[j], j)):
            parts = columns[j]
            repeats = min(int(x[j] + 0.5), *((histogram[n] - used[n]) // parts.count(n) for n in parts))
            if repeats > 0:
                at = 0
                for n in parts:
                    rows.append((n, used[n], used[n] + repeats, windows, at, False))
                    used[n] += repeats
                    at += n
                windows += repeats
    position = 0
    for n in sorted(histogram, reverse=True):
        if rest := histogram[n] - used[n]:
            rows.append((n, used[n], histogram[n], position, 0, True))
            position += rest * n
    return rows, windows


def pack(docs: DataFrame, config: PackConfig, with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if asked for.

    ``ids`` is binary, little-endian unsigned 32-bit.
    """
    spark, window = docs.sparkSession, config.window
    tokens = settle(tokenize(docs, config, with_ids))
    keys = ["part", "rem"]
    # one pass over the rows with their ids gives all that is counted
    stats = settle(tokens.groupBy(*keys).agg((F.max("rank") + 1).alias("n"), F.sum(F.size("full")).alias("whole")))
    counts = stats.where("rem > 0").drop("whole")
    before = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["rem"]: r["n"] for r in counts.groupBy("rem").agg(F.sum("n").alias("n")).collect()}
    rows, windows = plan(histogram, config)
    layout = spark.createDataFrame(rows, "rem int, lo long, hi long, base long, at int, stream boolean")
    # whole windows come after those of combinations and of the stream, partition after partition
    streamed = sum(n * (hi - lo) for n, lo, hi, _, _, s in rows if s)
    first = windows + -(-streamed // window)
    # one task numbers the partitions, a row of two numbers for each
    whole = stats.groupBy("part").agg(F.sum("whole").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)) + first).drop("n")

    chunk = F.posexplode("full").alias("k", "x")
    none = F.lit(None).cast("binary")
    full = (
        tokens.where(F.size("full") > 0).select("doc_id", "tokens", "part", "first_full", chunk)
        .join(starts, "part")
        .select(
            "doc_id",
            (F.col("k").cast("long") * window).alias("start"),
            F.lit(window).cast("long").alias("length"),
            F.col("x.crc").alias("ids_crc32"),
            F.col("tokens").alias("doc_tokens"),
            (F.col("skip") + F.col("first_full") + F.col("k")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
            (F.col("x.ids") if with_ids else none).alias("ids"),
        )
    )
    # the plan's rows are bounded by max_combinations, turns and the window, whatever the input
    rest = (
        tokens.where("rem > 0").select("doc_id", "tokens", *keys, "rank", "rem_crc")
        .join(shifts, keys)
        .withColumn("g", F.col("rank") + F.col("shift"))
        .join(F.broadcast(layout), "rem")
        .where("g >= lo and g < hi")
        .withColumn("position", F.when(F.col("stream"), F.col("base") + (F.col("g") - F.col("lo")) * F.col("rem")))
        .withColumn("offset", F.when(F.col("stream"), F.col("position") % window).otherwise(F.col("at").cast("long")))
        .withColumn("sequence_id", F.when(F.col("stream"), F.expr(f"position div {window}") + windows).otherwise(F.col("base") + F.col("g") - F.col("lo")))
        .withColumn("cut", F.col("offset") + F.col("rem") > window)
        .withColumn("start", F.col("tokens") - F.col("rem"))
    )
    outcome = ["doc_id", "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset", "ids"]
    stored = tokens.where("rem > 0").select(*keys, "rank", "rem_ids")
    if with_ids:
        # every remainder needs its ids
        cut, uncut = rest.join(stored, [*keys, "rank"]), None
    else:
        # a stream window cuts one remainder at most, so few rows look up their ids
        rest = settle(rest)
        uncut, cut = rest.where(~F.col("cut")), rest.where("cut")
        if cut.count() <= config.broadcast_rows:
            cut = F.broadcast(cut)
        cut = stored.join(cut, [*keys, "rank"])
    cut = cut.withColumn("head", F.least(F.lit(window) - F.col("offset"), F.col("rem").cast("long")))
    both = F.explode(
        F.filter(
            F.array(
                F.struct(F.lit(0).cast("long").alias("from"), F.col("head").alias("n"), F.col("sequence_id").alias("s"), F.col("offset").alias("o")),
                F.struct(F.col("head").alias("from"), (F.col("rem") - F.col("head")).alias("n"), (F.col("sequence_id") + 1).alias("s"), F.lit(0).cast("long").alias("o")),
            ),
            lambda p: p["n"] > 0,
        )
    )
    cut = cut.select("doc_id", "tokens", "start", "rem_ids", both.alias("p")).select(
        "doc_id",
        "tokens",
        (F.col("start") + F.col("p.from")).alias("start"),
        F.col("p.n").alias("length"),
        F.col("p.s").alias("sequence_id"),
        F.col("p.o").alias("offset"),
        F.substring("rem_ids", F.col("p.from").cast("int") * 4 + 1, F.col("p.n").cast("int") * 4).alias("bytes"),
    )
    cut = cut.withColumn("ids_crc32", F.crc32("bytes")).withColumn("ids", F.col("bytes") if with_ids else none).select(*outcome)
    pieces = full.unionByName(cut)
    if uncut is not None:
        kept = uncut.withColumn("length", F.col("rem").cast("long")).withColumn("ids_crc32", F.col("rem_crc")).withColumn("ids", none).select(*outcome)
        pieces = pieces.unionByName(kept)
    return pieces if with_ids else pieces.drop("ids")
