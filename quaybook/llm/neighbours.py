"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Distinct unit vectors are projected by a few orthogonal Gaussian directions; the squared ratio of projected and true distance follows
a chi-square law, or one narrower still as the directions are orthogonal.  A coarse kd-tree over the projections, drawn from a bounded
sample, deals the vectors into shards, every vector into one; a shard keeps a kd-tree of its own.  A query takes projected neighbours
nearest first and verifies them by exact distance, until the chi-square test holds: a vector nearer than its current k-th
would have been met by now with the configured probability.  The same test decides which shards a query visits: first the one it lies
in, which tells how far its k-th is, then those whose cells are not too far for that.  There is no cap on what is verified.

Equal vectors are one here, with their least ids, and equal queries are searched once.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another length
than a query's are not its candidates; fewer candidates than asked for are all returned; ties go to the smaller id; rows alike
in id and vector count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaybook.llm.shared import settle, whole_runs


@dataclass(frozen=True)
class SearchConfig:
    k: int = 5
    #: Directions of the projection, an even number; vectors of as few components or fewer keep them all and are searched exactly.
    directions: int = 24
    #: Probability that a vector nearer than the k-th would have been met when the search stops.
    confidence: float = 0.85
    leaf: int = 64
    #: Vectors verified between two stopping tests.
    step: int = 128
    shard_rows: int = 25_000
    #: Vectors from which the cells of the shards are drawn, at most.
    sample: int = 100_000
    #: Parts into which the neighbours of one vector are split where they meet its queries.
    salts: int = 8
    seed: int = 7


def chi_square_below(x: np.ndarray | float, degrees: int) -> np.ndarray | float:
    """Distribution function of the chi-square law for an even number of degrees."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_at(share: float, degrees: int) -> float:
    """Where the distribution function reaches the share."""
    low, high = 0.0, 1400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < share else (low, middle)
    return high


class Projection:
    """Orthogonal directions for vectors of one length, scaled so that a squared distance grows to about ``directions`` times itself."""

    def __init__(self, size: int, config: SearchConfig) -> None:
        m = min(config.directions, size)
        gaussian = np.random.default_rng([config.seed, size]).standard_normal((size, m))
        self.directions = np.linalg.qr(gaussian)[0] * np.sqrt(size)
        #: Times a squared distance: the projected one beyond which the stopping test holds.
        self.reach = chi_square_at(config.confidence, m) if m < size else size * (1 + 1e-9)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions


def unit_rows(flat: np.ndarray) -> np.ndarray:
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


class KdTree:
    """Points split at the median of their widest coordinate until a leaf holds few; leaves keep their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        parts: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= leaf:
                parts.append(part)
                continue
            own = points[part]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            middle = len(part) // 2
            order = np.argpartition(own[:, axis], middle)
            todo += [part[order[:middle]], part[order[middle:]]]
        #: Points leaf by leaf, and where each leaf begins and ends there.
        self.order = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        self.starts, self.ends = ends - [len(p) for p in parts], ends
        self.low = np.stack([points[p].min(0) for p in parts])
        self.high = np.stack([points[p].max(0) for p in parts])


def box_distances(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance from a point to each box."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(1)


class Cells:
    """The coarse tree of vectors of one length: cells that cover all of the projected space, about equal shares of a sample in each."""

    def __init__(self, points: np.ndarray, shards: int) -> None:
        width = points.shape[1]
        self.low, self.high = [np.full(width, -np.inf)], [np.full(width, np.inf)]
        parts = [points]
        while len(parts) < shards and max(map(len, parts)) > 1:
            k = max(range(len(parts)), key=lambda i: len(parts[i]))
            own = parts[k]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            at = float(np.median(own[:, axis]))
            below = own[:, axis] < at
            if not below.any():
                break
            low, high = self.low[k].copy(), self.high[k].copy()
            low[axis], high[axis] = at, at
            self.low.append(low)
            self.high.append(self.high[k])
            self.high[k] = high
            parts[k] = own[below]
            parts.append(own[~below])
        self.low, self.high = np.stack(self.low), np.stack(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)
        for k in range(len(self.low)):
            out[((points >= self.low[k]) & (points < self.high[k])).all(1)] = k
        return out


class Shard:
    """The index of distinct vectors of one length, each with its least ids in order."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray, project: Projection, config: SearchConfig) -> None:
        self.config, self.project = config, project
        points = project(unit_rows(vectors))
        self.tree = KdTree(points, config.leaf)
        # everything lies leaf by leaf, so that a leaf is a slice
        self.points, self.vectors = points[self.tree.order], vectors[self.tree.order]
        self.ids = [ids[i] for i in self.tree.order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.squares = (self.points * self.points).sum(1)

    def nearest(self, vector: np.ndarray, kth: float = np.inf) -> tuple[list[tuple[float, int]], float, int]:
        """``k + 1`` best ``(cosine, id)`` found, the squared distance of the last, and how many vectors were verified.

        One more than ``k``, as the query's own vector may be among them.  ``kth`` is a bound that is known already.
        """
        config, tree, need = self.config, self.tree, self.config.k + 1
        norm = np.sqrt((vector * vector).sum())
        unit = vector / norm
        point = self.project(unit[None, :])[0]
        bounds = box_distances(tree.low, tree.high, point)
        # without a bound yet, all leaves may hold neighbours; projected distances tell the order
        open_ = np.flatnonzero(bounds <= kth * self.project.reach)
        if not len(open_):
            return [], kth, 0
        if 4 * len(open_) > 3 * len(bounds):
            inside = np.arange(len(self.points))
            apart = self.squares - 2 * (self.points @ point) + point @ point
        else:
            inside = np.concatenate([np.arange(tree.starts[i], tree.ends[i]) for i in open_])
            apart = self.squares[inside] - 2 * (self.points[inside] @ point) + point @ point
        if np.isfinite(kth):
            near = apart <= kth * self.project.reach + 1e-9
            inside, apart = inside[near], apart[near]
        found: list[tuple[float, int]] = []
        at, step = 0, config.step
        while at < len(inside):
            # the next projected neighbours, nearest first
            rest = len(inside) - at
            if rest > step:
                part = np.argpartition(apart[at:], step - 1)
                inside[at:], apart[at:] = inside[at:][part], apart[at:][part]
            rows = inside[at : at + step]
            at += len(rows)
            scores = (self.vectors[rows] * vector).sum(1) / (self.norms[rows] * norm)
            # ties go to the smaller id, so equal scores stay in
            worst = found[need - 1][0] if len(found) >= need else -np.inf
            good = np.flatnonzero(scores >= worst)
            if len(good):
                new = [(-s, i) for s, row in zip(scores[good].tolist(), rows[good].tolist(), strict=True) for i in self.ids[row]]
                found = sorted([(s, i) for s, i in new] + [(-s, i) for s, i in found])[:need]
                found = [(-s, i) for s, i in found]
            if len(found) >= need:
                kth = min(kth, max(2 - 2 * found[need - 1][0], 0.0) + 1e-9)
                keep = apart[at:] <= kth * self.project.reach + 1e-9
                inside, apart = np.concatenate([inside[:at], inside[at:][keep]]), np.concatenate([apart[:at], apart[at:][keep]])
            step = min(2 * step, 1024)
        return found, kth, at


_PLACED = "shard long, size long, role int, class long, ids array<long>, embedding array<double>, kth double"
_FOUND = "class long, size long, kth double, verified long, found array<struct<score:double,id:long>>"
_LIST = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _place(cells: dict[int, Cells], config: SearchConfig) -> Callable:
    """Rows ``class, ids, asked, embedding, size`` with the shard of each, as vectors, and again as queries where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(4).to_numpy()
            for size in np.unique(sizes).tolist():
                rows = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(sizes == size)))
                project = Projection(size, config)
                shard = cells[size].of(project(unit_rows(_matrix(rows.column(3))))) if size in cells else np.zeros(rows.num_rows, np.int64)
                asked = np.flatnonzero(rows.column(2).to_numpy())
                for role, at in ((0, np.arange(rows.num_rows)), (1, asked)):
                    own = rows.take(pa.array(at)).combine_chunks()
                    n = own.num_rows
                    if n:
                        columns = [pa.array(shard[at]), own.column(4), pa.array(np.full(n, role, np.int32)), own.column(0), own.column(1), own.column(3), pa.nulls(n, pa.float64())]
                        yield pa.Table.from_arrays(columns, names=["shard", "size", "role", "class", "ids", "embedding", "kth"]).combine_chunks().to_batches()[0]

    return run


def _visits(cells: dict[int, Cells], config: SearchConfig) -> Callable:
    """Queries ``shard, size, role, class, ids, embedding, kth`` for every other shard whose cell the stopping test does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shards = [], []
            for i, (home, size, kth) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                if size in cells:
                    project = Projection(size, config)
                    point = project(unit_rows(_matrix(batch.column(5).slice(i, 1))))[0]
                    near = box_distances(cells[size].low, cells[size].high, point) <= (kth if kth is not None else np.inf) * project.reach
                    near[home] = False
                    shards += np.flatnonzero(near).tolist()
                    rows += [i] * int(near.sum())
            if rows:
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *out.columns[1:]], names=batch.schema.names)

    return run


def _search(config: SearchConfig) -> Callable:
    """From rows of ``_PLACED`` sorted by the first three, so that a shard's vectors come before its queries: rows of ``_FOUND``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: tuple[int, int, Shard] | None = None
        for table, bounds in whole_runs(batches, 3):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = table.slice(s, e - s)
                shard, size, role = (rows.column(c)[0].as_py() for c in ("shard", "size", "role"))
                vectors = _matrix(rows.column("embedding"))
                if role == 0:
                    index = (shard, size, Shard(rows.column("ids").to_pylist(), vectors, Projection(size, config), config))
                elif index and index[:2] == (shard, size):
                    bound = rows.column("kth").to_pylist()
                    out = [index[2].nearest(v, np.inf if b is None else b) for v, b in zip(vectors, bound, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("class").combine_chunks(),
                            rows.column("size").combine_chunks(),
                            pa.array([kth if np.isfinite(kth) else None for _, kth, _ in out], pa.float64()),
                            pa.array([n for _, _, n in out], pa.int64()),
                            pa.array([[{"score": x, "id": i} for x, i in found] for found, _, _ in out], _LIST),
                        ],
                        names=["class", "size", "kth", "verified", "found"],
                    )

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part, as doubles; zeros have one sign."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    return rows.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"))


def search(vectors: DataFrame, every: int = 50, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``query_id, rank, vec_id, score, n_verified``: the k nearest by cosine of each vector whose id is divisible by ``every``.

    ``n_verified`` is the number of vectors that the query's exact distances were taken to.
    """
    rows = usable(vectors)
    # of equal vectors only the least ids can be among anyone's nearest, so no group of them meets in one place
    least = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= config.k + 1)
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    classes = least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    wanted = asked.select("embedding").distinct().withColumn("asked", F.lit(True))
    classes = settle(classes.join(wanted, "embedding", "left").select(F.element_at("ids", 1).alias("class"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "embedding", F.size("embedding").cast("long").alias("size")))
    counts = {r["size"]: r["count"] for r in classes.groupBy("size").count().collect()}
    cells: dict[int, Cells] = {}
    for size, n in counts.items():
        if n > config.shard_rows:
            # at most about `sample` vectors, whatever the input
            drawn = classes.where((F.col("size") == size) & (F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, config.sample / n)))).select("embedding").toPandas()
            project = Projection(size, config)
            cells[size] = Cells(project(unit_rows(np.stack(drawn["embedding"].to_numpy()))), -(-n // config.shard_rows))
    total = max(1, sum(len(c.low) for c in cells.values()) + len(counts))
    keys = ["shard", "size"]
    ordered = lambda df: df.repartition(total, *keys).sortWithinPartitions(*keys, "role").mapInArrow(_search(config), _FOUND)
    placed = classes.mapInArrow(_place(cells, config), _PLACED)
    placed = settle(placed) if cells else placed
    found = ordered(placed)
    if cells:
        home = settle(found)
        queries = placed.where("role = 1").drop("kth").join(home.select("class", "kth"), "class")
        visits = queries.select("shard", "size", "role", "class", "ids", "embedding", "kth").mapInArrow(_visits(cells, config), _PLACED)
        found = home.unionByName(ordered(placed.where("role = 0").unionByName(visits)))
    # the best of all shards for each distinct vector, one more than asked for as a query is not its own neighbour
    best = found.groupBy("class").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("found", lambda x: F.struct((-x["score"]).alias("s"), x["id"].alias("id")))))), 1, config.k + 1).alias("best"), F.sum("verified").alias("n_verified"))
    least_id = classes.where("asked").select("class", "embedding").join(best, "class")
    # a third of the queries may be one vector
    salted = least_id.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))))
    each = asked.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(config.salts)).cast("int")).join(salted, ["embedding", "salt"])
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, config.k)
    ranked = each.select(F.col("vec_id").alias("query_id"), "n_verified", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"), "n_verified")
