"""Running aggregates that can spread one long sequence over many tasks.

A window over a whole symbol puts the symbol into one task, which is the fastest way while symbols are short.  A long sequence is
cut into chunks by a column that never falls along the order: each chunk runs alone, its total goes into a small table, the
totals before a chunk are aggregated there, and the two parts meet.  Work per row is constant and the largest task is a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaybook.plans.lineage import settle
from quaybook.schema import Layout


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys, or evenly without any, to as many partitions as the session shuffles into.

    The number is stated, so that adaptive execution does not put a few small partitions with much work into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt_whole(df: DataFrame, chunk: Column | None, *keys: str) -> DataFrame:
    """Rows dealt by keys once, before the first of several passes over whole keys; as they are where pieces of keys run alone."""
    return dealt(df, *keys) if chunk is None else df


def layout_of(messages: DataFrame) -> Layout:
    """The layout for the longest symbol, by one count; who knows how many messages there are passes a layout instead."""
    return Layout.for_rows(messages.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0)


def whole_pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """One table for each run of rows with equal first ``keys`` columns, from rows sorted by these; nulls are equal."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for i in range(keys):
            code = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change |= code[1:] != code[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(batch.slice(low, high - low))
            if high < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Running:
    """``sum``, ``max`` or ``last`` (of non-null values) of ``value`` over the rows so far, the own row included or not."""

    name: str
    how: str
    value: Column
    inclusive: bool = True


def _aggregate(how: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how](value)


def _join(how: str, before: Column, here: Column) -> Column:
    if how == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    return F.greatest(before, here) if how == "max" else F.coalesce(here, before)


def running(df: DataFrame, keys: list[str], chunk: Column | None, order: list[str], wanted: list[Running], reverse: bool = False) -> DataFrame:
    """Add each of ``wanted``; ``chunk`` must not fall along the ascending order.  Without it, each key's rows run in one task."""
    turn = (lambda c: F.col(c).desc()) if reverse else F.col
    frame = lambda over, w: over.rowsBetween(Window.unboundedPreceding, 0 if w.inclusive else -1)
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(*[turn(c) for c in order])
        return df.withColumns({w.name: _aggregate(w.how, w.value).over(frame(whole, w)) for w in wanted})
    # read twice below, so it is written once
    valued = settle(df.withColumns({"__chunk": chunk, **{f"__{w.name}": w.value for w in wanted}}))
    chunk = "__chunk"
    last_of = lambda w: F.max_by(F.col(f"__{w.name}"), F.when(F.col(f"__{w.name}").isNotNull(), F.struct(*order)))
    first_of = lambda w: F.min_by(F.col(f"__{w.name}"), F.when(F.col(f"__{w.name}").isNotNull(), F.struct(*order)))
    total = lambda w: (first_of(w) if reverse else last_of(w)) if w.how == "last" else _aggregate(w.how, F.col(f"__{w.name}"))
    totals = valued.groupBy(*keys, chunk).agg(*[total(w).alias(f"__t_{w.name}") for w in wanted])
    earlier = Window.partitionBy(*keys).orderBy(turn(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, chunk, *[_aggregate(w.how, F.col(f"__t_{w.name}")).over(earlier).alias(f"__b_{w.name}") for w in wanted])
    inside = Window.partitionBy(*keys, chunk).orderBy(*[turn(c) for c in order])
    here = valued.withColumns({f"__h_{w.name}": _aggregate(w.how, F.col(f"__{w.name}")).over(frame(inside, w)) for w in wanted})
    joined = here.join(before, [*keys, chunk])
    result = joined.withColumns({w.name: _join(w.how, F.col(f"__b_{w.name}"), F.col(f"__h_{w.name}")) for w in wanted})
    return result.drop("__chunk", *[f"__{x}{w.name}" for w in wanted for x in ("", "b_", "h_")])


def chunk_of(column: str, size: int | None) -> Column | None:
    """Number of the chunk of so many that a whole number falls in; no chunk without a size."""
    return None if size is None else F.floor(F.col(column) / size).cast("long")


def with_lag(df: DataFrame, keys: list[str], position: str, offset: int, columns: dict[str, str], size: int | None) -> DataFrame:
    """Add ``columns`` (new name: old name) from ``offset`` rows earlier; positions are whole and have no gaps.

    Every row also visits the chunk its value is needed in, so chunks run alone however long the sequence is.
    """
    if size is None:
        back = Window.partitionBy(*keys).orderBy(position)
        return df.withColumns({new: F.lag(old, offset).over(back) for new, old in columns.items()})
    size = max(size, offset)
    own = chunk_of(position, size)
    both = F.array_distinct(F.array(own, F.floor((F.col(position) + offset) / size).cast("long")))
    visiting = df.withColumn("__slot", F.explode(both))
    within = Window.partitionBy(*keys, "__slot").orderBy(position)
    # positions have no gaps, but a chunk may lack rows between its own and the visitors', so the distance is checked
    far = F.lag(position, offset).over(within)
    near = visiting.withColumns({new: F.when(far == F.col(position) - offset, F.lag(old, offset).over(within)) for new, old in columns.items()})
    return near.where(F.col("__slot") == own).drop("__slot")
