"""Similarity join on word shingles with a token-group matrix.

Documents with the same shingle set form a class, and only classes go on.  Every class sends the rare end of its set, the prefix
that any partner must meet, to the tokens in it; where classes meet, parity sketches give an upper bound on the overlap of two
sets, and pairs that the bound allows join into families of similar documents.  A family goes to tasks in blocks.  There, its
documents are partitioned into small groups of similar ones, a matrix stores each group's token union, a document's overlap with
each union bounds its overlap with every member, and only groups whose bound qualifies are opened for exact comparison.  Pairs
that are connected already need no comparison, so what is emitted is a forest of exact links.

What does not fit one block is dealt at random, twice, so that near copies of one document become connected while every row goes to two
tasks.  Only strangers, those not connected to the most of their group by then, visit the other blocks.  So the rows dealt grow with
the members of a family, and with the square of its strangers at worst.

Every bound is exact: a token that is frequent in a sample of texts moves to the end of the prefix order, which changes the work
but not the result.  Sets are compared by 64-bit hashes of
shingles and told apart by 128 bits, candidates by 64.

Defined cases: without words or text the set is empty and linked with nothing; fewer words than a shingle has make one
shingle; a null id takes part, and its component is the least id that is not null; repeated rows are linked with each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaybook.llm.graph import components
from quaybook.llm.shared import in_small_batches, mix64, settle, whole_runs, window_hashes, word_hashes

#: Bits of a parity sketch: a power of two about the size of the set, within these limits.
LEAST_BITS, MOST_BITS = 256, 16384
_SHORT = np.uint64(0xA5A5F00DC3C3B00B)
_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class JoinConfig:
    #: Words in a shingle, and the least similarity in hundredths.
    width: int = 5
    percent: int = 80
    #: One text in so many is counted to find frequent tokens; how often a token occurs there at least; how many are kept.
    sample: int = 32
    frequent: int = 4
    most_frequent: int = 1 << 20
    #: Classes that share a token and are paired at once; more meet in one task with their sketches.
    few: int = 8
    #: Classes compared in one task at once where a token is crowded, and documents of a family in one block.
    crowd: int = 4096
    block: int = 1024
    #: Documents in a group of the token-group matrix.
    group: int = 16
    #: Classes that have a token in the sample from which it is dealt apart, so that no task holds all of its classes.
    hot: int = 64
    #: Rows up to which a side of the text lookup is broadcast; its rows have a fixed width.
    broadcast_rows: int = 400_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < width:
        with np.errstate(over="ignore"):
            return mix64(window_hashes(words, len(words)) + _SHORT * np.uint64(len(words)))
    return np.unique(window_hashes(words, width))


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set: its identity."""
    with np.errstate(over="ignore"):
        a = mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))
        b = mix64(tokens ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
        return int(mix64(np.array([a]))[0].view(np.int64)), int(mix64(np.array([b]))[0].view(np.int64))


def sketch_of(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of the sketch's bits; two sketches differ in at most as many bits as their sets in tokens."""
    n = min(MOST_BITS, max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length()))
    bits = np.bincount((tokens >> np.uint64(17)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of at least ``size`` bytes brought to that size, as rows of 64-bit words: halves add up by parity."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    sizes = np.array([len(s) for s in sketches])
    for full in np.unique(sizes):
        at = np.flatnonzero(sizes == full)
        m = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), -1)
        while m.shape[1] * 8 > size:
            half = m.shape[1] // 2
            m = m[:, :half] ^ m[:, half:]
        out[at] = m
    return out


def needed(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any partner."""
    return -(-percent * size // 100)


class _Seen:
    """Remembers classes of one task, a bounded number, to pass each on once."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most, self.seen = most, set()

    def first(self, key: tuple[int, int]) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(key)
        return True


def _sampled_tokens(config: JoinConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = _Seen(), [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), config.width)
                if len(tokens) and seen.first(class_of(tokens)):
                    held.append(tokens)
                    n += len(tokens)
                    if n > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["t"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["t"])

    return run


_SETS = "doc_id long, key long, n long, c1 long, c2 long, prefix array<long>, sketch binary"


def _sets(config: JoinConfig, frequent) -> Callable:
    """Rows of :data:`_SETS`; within a task, prefix and sketch come with the first document of a class only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = frequent.value, _Seen()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sizes, ones, twos, prefixes, sketches = [], [], [], [], []
                for text in batch.column(2):
                    tokens = shingle_set(text.as_py(), config.width)
                    n, key = len(tokens), class_of(tokens)
                    sizes.append(n)
                    ones.append(key[0])
                    twos.append(key[1])
                    if not n or not seen.first(key):
                        prefixes.append(None)
                        sketches.append(None)
                        continue
                    length = n - needed(n, config.percent) + 1
                    ordered = tokens
                    if len(hot):
                        is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                        if is_hot.any():
                            ordered = np.concatenate([tokens[~is_hot], tokens[is_hot]])
                    prefixes.append(ordered[:length].view(np.int64))
                    sketches.append(sketch_of(tokens))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(ones, pa.int64()),
                        pa.array(twos, pa.int64()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "key", "n", "c1", "c2", "prefix", "sketch"],
                )

    return run


class _Forest:
    """Labels of a few nodes; merging reports whether two trees became one."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def merge(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)


_EDGES = "u long, v long"


def _crowd_forest(n: np.ndarray, sketches: list[bytes], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs among many sets that the sketch bound allows, across sides only if these are given."""
    order = np.argsort(n, kind="stable")
    n, side = n[order], None if side is None else side[order]
    sketches = [sketches[i] for i in order]
    sizes = np.array([len(s) for s in sketches])
    reach = np.searchsorted(n * percent, n * 100, side="right")
    forest, found = _Forest(len(n)), []
    for size in np.unique(sizes):
        # sets in order of their size, so larger sketches come later
        base = int(np.searchsorted(sizes, size))
        last = int(np.searchsorted(sizes, size, side="right"))
        m = folded(sketches[base : int(reach[last - 1])], int(size))
        for x in range(base, last):
            far = int(reach[x])
            if far <= x + 1:
                continue
            apart = np.bitwise_count(m[x + 1 - base : far - base] ^ m[x - base]).sum(1, dtype=np.int64)
            may = (apart * (100 + percent) <= (n[x + 1 : far] + n[x]) * (100 - percent)) & (forest.label[x + 1 : far] != forest.label[x])
            if side is not None:
                may &= side[x + 1 : far] != side[x]
            for y in np.flatnonzero(may) + x + 1:
                if forest.label[y] != forest.label[x]:
                    forest.merge(x, int(y))
                    found.append((int(order[x]), int(order[y])))
    return found


def _pairs_alone(n: np.ndarray, sketches: list[bytes], i: np.ndarray, percent: int) -> np.ndarray:
    """Of rows ``i`` that meet only the row after them, those that the sketch bound allows."""
    swap = n[i] > n[i + 1]
    small, large = np.where(swap, i + 1, i), np.where(swap, i, i + 1)
    near = n[large] * percent <= n[small] * 100
    i, small, large = i[near], small[near], large[near]
    sizes = np.array([len(sketches[k]) for k in small])
    ok = np.zeros(len(i), bool)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        apart = np.bitwise_count(folded([sketches[k] for k in small[at]], int(size)) ^ folded([sketches[k] for k in large[at]], int(size))).sum(1, dtype=np.int64)
        ok[at] = apart * (100 + percent) <= (n[small[at]] + n[large[at]]) * (100 - percent)
    return i[ok]


def _deal(config: JoinConfig) -> Callable:
    """From rows ``t, c1`` sorted by token: pairs ``u, v`` where few classes meet, and ``t, u, crowd`` where many do."""
    few = config.few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, 1):
            t, c1 = table.column(0).to_numpy(), table.column(1).to_numpy()
            lengths = np.diff(bounds)
            us, vs = [], []
            for n in range(2, few + 1):
                at = bounds[:-1][lengths == n]
                for i in range(n):
                    for j in range(i + 1, n):
                        us.append(np.minimum(c1[at + i], c1[at + j]))
                        vs.append(np.maximum(c1[at + i], c1[at + j]))
            pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
            many = np.repeat(lengths > few, lengths)
            crowd = np.repeat(lengths, lengths)[many]
            nothing = lambda n: pa.nulls(n, pa.int64())
            if len(pairs):
                yield pa.RecordBatch.from_arrays([nothing(len(pairs)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), nothing(len(pairs))], names=["t", "u", "v", "crowd"])
            if len(crowd):
                yield pa.RecordBatch.from_arrays([pa.array(t[many]), pa.array(c1[many]), nothing(len(crowd)), pa.array(crowd)], names=["t", "u", "v", "crowd"])

    return run


def _alike(config: JoinConfig) -> Callable:
    """Of pairs ``u, v, n, sketch, m, other``, those that the sketch bound allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.stack([batch.column(2).to_numpy(), batch.column(4).to_numpy()], 1).ravel()
            sketches = [x for pair in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True) for x in pair]
            ok = _pairs_alone(n, sketches, np.arange(0, len(n), 2), config.percent) // 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], names=["u", "v"])

    return run


def _meet(config: JoinConfig) -> Callable:
    """From rows ``t, a, b, side, c1, n, sketch`` sorted by the first three: a forest of pairs that the sketch bound allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at_home in _each_run(batches):
            side = None if at_home else rows.column("side").to_numpy()
            pairs = _crowd_forest(rows.column("n").to_numpy(), rows.column("sketch").to_pylist(), side, config.percent)
            if pairs:
                c1 = rows.column("c1").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(c1[[i for i, _ in pairs]]), pa.array(c1[[j for _, j in pairs]])], names=["u", "v"])

    return run


class TokenGroups:
    """The matrix of one block: groups of similar sets, each with the union of its tokens, as postings from token to groups."""

    def __init__(self, sets: list[np.ndarray], group: int) -> None:
        # sets that share their least token tend to be alike
        self.order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]), i))
        self.of = np.empty(len(sets), np.int64)
        self.of[self.order] = np.arange(len(sets)) // group
        self.members = [self.order[i : i + group] for i in range(0, len(sets), group)]
        sizes = np.array([len(s) for s in sets])
        self.least = np.array([sizes[m].min() for m in self.members])
        self.most = np.array([sizes[m].max() for m in self.members])
        self.vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
        self.tokens = np.split(where, np.cumsum(sizes)[:-1])
        pairs = np.unique(where * len(self.members) + np.repeat(self.of, sizes))
        self.posted = pairs % len(self.members)
        self.start = np.searchsorted(pairs, np.arange(len(self.vocabulary) + 1) * len(self.members))

    def overlaps(self, i: int) -> np.ndarray:
        """Tokens that set ``i`` shares with the union of each group."""
        t = self.tokens[i]
        first, n = self.start[t], self.start[t + 1] - self.start[t]
        ends = np.cumsum(n)
        return np.bincount(self.posted[np.arange(ends[-1]) + np.repeat(first - ends + n, n)], minlength=len(self.members))


def links_within(sets: list[np.ndarray], config: JoinConfig, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest with the same connected components as all links among the sets; with ``sides``, links across sides only."""
    p, found = config.percent, []
    matrix, forest = TokenGroups(sets, config.group), _Forest(len(sets))
    mark = np.zeros(len(matrix.vocabulary), bool)
    for i in range(len(sets)):
        n = len(sets[i])
        bound = matrix.overlaps(i)
        smallest = np.maximum(matrix.least, needed(n, p))
        opened = np.flatnonzero((bound * (100 + p) >= p * (n + smallest)) & (100 * matrix.most >= p * n) & (p * matrix.least <= 100 * n))
        mark[matrix.tokens[i]] = True
        for g in opened:
            for j in matrix.members[g]:
                if j <= i or forest.label[j] == forest.label[i] or (sides is not None and sides[i] == sides[j]):
                    continue
                m = len(sets[j])
                if 100 * min(n, m) < p * max(n, m):
                    continue
                shared = int(np.count_nonzero(mark[matrix.tokens[j]]))
                if 100 * shared >= p * (n + m - shared):
                    forest.merge(i, j)
                    found.append((i, j))
        mark[matrix.tokens[i]] = False
    return found


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """The rows of each block, and whether they are all at home there, or else visitors with whom to compare."""
    for table, bounds in whole_runs(batches, 3):
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield table.slice(s, e - s), table.column("b")[s].as_py() < 0


def _verify(config: JoinConfig) -> Callable:
    """From rows ``family, a, b, side, c1, text`` sorted by the first three: a forest of exact links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at_home in _each_run(batches):
            c1 = rows.column("c1").to_pylist()
            # a stranger visits its own block too
            first = {c: i for i, c in reversed(list(enumerate(zip(c1, rows.column("side").to_pylist(), strict=True))))}
            keep = sorted(first.values())
            if len(keep) < 2:
                continue
            sets = [shingle_set(rows.column("text")[i].as_py(), config.width) for i in keep]
            sides = None if at_home else rows.column("side").to_numpy()[keep]
            pairs = links_within(sets, config, sides)
            if pairs:
                ends = ([c1[keep[i]] for i, _ in pairs], [c1[keep[j]] for _, j in pairs])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["u", "v"])

    return run


def _at_home(df: DataFrame, count: str, size: int, *by: str, rounds: int = 1) -> DataFrame:
    """Deal the rows of each group into blocks of about ``size``, in each of ``rounds`` anew where one block does not hold them."""
    blocks = F.ceil(F.col(count) / size).cast("long")
    turns = F.explode(F.sequence(F.lit(0), F.when(blocks > 1, rounds - 1).otherwise(0)))
    dealt = df.withColumn("__qb_turn", turns).withColumn("a", F.pmod(F.xxhash64(*by, "__qb_turn"), blocks))
    return dealt.withColumns({"b": (-1 - F.col("__qb_turn")).cast("long"), "side": F.lit(0).cast("long")}).drop("__qb_turn")


def strangers(df: DataFrame, group: str, count: str, size: int, labels: DataFrame) -> DataFrame:
    """Of groups that one block does not hold, the rows not connected to the most of their group, as visitors of every block.

    ``labels`` tells by ``node`` and ``label`` which classes ``c1`` are connected.  Two rows that are not, are both strangers or one of
    them is, and a stranger meets every row of its group in that row's block.  Visitors come in blocks too, so no task holds more
    than two blocks.
    """
    rows = df.where(F.col(count) > size).join(labels.select(F.col("node").alias("c1"), "label"), "c1", "left").withColumn("label", F.coalesce("label", "c1"))
    sums = rows.groupBy(group, "label").count()
    most = sums.groupBy(group).agg(F.max_by("label", F.struct("count", "label")).alias("__qb_most"), (F.sum("count") - F.max("count")).alias("__qb_others"))
    known = rows.join(most.where("__qb_others > 0"), group)
    blocks, visits = F.ceil(F.col(count) / size).cast("long"), F.ceil(F.col("__qb_others") / size).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    home = known.withColumns({"side": F.lit(0).cast("long"), "a": F.pmod(F.xxhash64("c1"), blocks)}).withColumn("b", every(visits))
    away = known.where("label <> __qb_most").withColumns({"side": F.lit(1).cast("long"), "b": F.pmod(F.xxhash64("c1", F.lit(1)), visits)}).withColumn("a", every(blocks))
    return home.unionByName(away.select(*home.columns)).drop("label", "__qb_most", "__qb_others")


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def find_links(docs: DataFrame, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """``(sets, links)``: a row for each document with its set's size and class, and a forest of links ``u, v`` between classes."""
    spark = docs.sparkSession
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    sampled = texts.where(F.pmod("key", F.lit(config.sample)) == 0).select("text")
    counted = sampled.mapInArrow(_sampled_tokens(config), "t long").groupBy("t").count().where(F.col("count") >= config.frequent)
    # at most `most_frequent` numbers, whatever the input
    top = counted.orderBy(F.desc("count"), "t").limit(config.most_frequent).toPandas()
    frequent = spark.sparkContext.broadcast(np.sort(top["t"].to_numpy().astype(np.int64).view(np.uint64)))
    hot = F.broadcast(spark.createDataFrame([(int(t),) for t in top["t"][top["count"] >= config.hot]], "t long"))
    sets = settle(texts.mapInArrow(_sets(config, frequent), _SETS))

    # one row for each token of a prefix and class that has it; tokens of one class alone say nothing
    tokens = sets.where("prefix is not null").select(F.explode("prefix").alias("t"), "c1")
    met = tokens.join(hot, "t", "left_anti").repartition("t").dropDuplicates(["t", "c1"]).withColumn("n", F.count("*").over(Window.partitionBy("t"))).where("n > 1")
    dealt = settle(met.select("t", "c1").sortWithinPartitions("t").mapInArrow(_deal(config), "t long, u long, v long, crowd long"))
    # the classes of a token that is likely to have very many are counted where they are
    apart = settle(tokens.join(hot, "t", "left_semi").distinct())
    many = apart.join(F.broadcast(apart.groupBy("t").agg(F.count("*").alias("crowd")).where("crowd > 1")), "t").select("t", "c1", "crowd")
    sketches = sets.where("sketch is not null").groupBy("c1").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    pairs = dealt.where("v is not null").select("u", "v").distinct()
    pairs = pairs.join(sketches.withColumnRenamed("c1", "u"), "u").join(sketches.toDF("v", "m", "other"), "v")
    alike = pairs.select("u", "v", "n", "sketch", "m", "other").mapInArrow(_alike(config), _EDGES)
    crowded = dealt.where("crowd is not null").select("t", F.col("u").alias("c1"), "crowd").unionByName(many)
    meet = lambda df: _grouped(df.join(sketches, "c1").select("t", "a", "b", "side", "c1", "n", "sketch"), ["t", "a", "b"]).mapInArrow(_meet(config), _EDGES)
    # the token is part of the deal, so blocks of different tokens mix
    near = settle(alike.union(meet(_at_home(crowded, "crowd", config.crowd, "c1", "t"))))
    families = components(near)
    if not crowded.where(F.col("crowd") > config.crowd).isEmpty():
        families = components(near.union(meet(strangers(crowded, "t", "crowd", config.crowd, families))))

    # one row stands for each class: the one of least id
    rows = sets.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "key")).alias("row"))
    members = rows.join(families.withColumnRenamed("node", "c1"), "c1").select(F.col("label").alias("family"), "c1", "row.id", F.col("row.key").alias("key"))
    sizes = families.groupBy(F.col("label").alias("family")).agg(F.count("*").alias("members"))
    members = settle(members.join(sizes, "family"))

    def verified(placed: DataFrame) -> DataFrame:
        own = placed.select("family", "a", "b", "side", "c1", "id", "key")
        if own.count() <= config.broadcast_rows:
            own = F.broadcast(own)
        found = texts.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).select("id", "key", "text").join(own, ["id", "key"])
        found = _grouped(found.select("family", "a", "b", "side", "c1", "text"), ["family", "a", "b"])
        return settle(found.mapInArrow(_verify(config), _EDGES))

    links = verified(_at_home(members, "members", config.block, "c1", rounds=2))
    if not members.where(F.col("members") > config.block).isEmpty():
        links = links.union(verified(strangers(members, "family", "members", config.block, components(links))))
    return sets, links


def join(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """``doc_id, key, n_shingles, component_id`` for each document; ``key`` is ``xxhash64(text)``."""
    sets, links = find_links(docs, config)
    labels = components(links)
    classes = sets.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first_id"))
    classes = classes.join(labels.withColumnRenamed("node", "c1"), "c1", "left")
    least = classes.where("label is not null").groupBy("label").agg(F.min("first_id").alias("least"))
    classes = classes.join(least, "label", "left").select("c1", "c2", F.coalesce("least", "first_id").alias("least"))
    out = sets.select("doc_id", "key", "n", "c1", "c2").join(classes, ["c1", "c2"], "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """The documents, with all columns, of which each component keeps the one of least id.

    A document without an id, and one with an empty set, always stays; rows alike in id and text stay once.
    """
    found = join(docs, config)
    stay = found.where(F.col("component_id").isNull() | F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("__qb_id"), F.col("key").alias("__qb_key")).distinct()
    keyed = docs.withColumn("__qb_key0", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__qb_id")) & (F.col("__qb_key0") == F.col("__qb_key"))
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", "__qb_key0"]).drop("__qb_key0")
