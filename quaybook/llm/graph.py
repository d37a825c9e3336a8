"""Connected components of a graph given as edges, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaybook.llm.shared import settle

#: A graph of at most this many edges is finished by union-find in one task; a larger one is contracted first.
LOCAL_EDGES = 400_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, label)`` for each node of ``edges`` (columns ``u`` and ``v``, long); one label to a component.

    Each round points every node at the neighbour of least priority, itself included, and contracts along these pointers;
    priorities are drawn anew each round, so long chains shrink by a constant factor.  Self-loops only name a node.
    """
    rest = settle(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    while rest.count() > local_edges:
        rank = lambda c, n=len(steps): F.struct(F.xxhash64(F.lit(n), F.col(c)).alias("h"), F.col(c).alias("id"))
        both = rest.select("u", "v").union(rest.select(F.col("v"), F.col("u")))
        chosen = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        step = settle(chosen.select(F.col("u").alias("node"), F.least(F.col("best"), rank("u"))["id"].alias("to")))
        steps.append(step)
        moved = rest.join(step.withColumnsRenamed({"node": "u", "to": "a"}), "u").join(step.withColumnsRenamed({"node": "v", "to": "b"}), "v")
        rest = settle(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    labels = settle(rest.repartition(1).mapInArrow(_union_find, "node long, label long"))
    for step in reversed(steps):
        onward = labels.withColumnsRenamed({"node": "to", "label": "l"})
        labels = settle(step.join(onward, "to", "left").select("node", F.coalesce("l", "to").alias("label")))
    return labels
