"""What each message does to its order: episodes, remaining sizes and changes of price levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaybook.schema import BOOK_EVENTS, Event


def order_states(messages: DataFrame) -> DataFrame:
    """``symbol, order_id, seq, episode, price, side, remaining, before, replaced`` for each message that may change a live order.

    An add of positive size opens an episode and replaces whatever the id still held (``replaced``: remaining, price, side).
    Later messages of the episode use the opening message's price and side.  What remains has a closed form: nothing after a full
    cancel, else the opening size less all reductions, not below zero.
    """
    opens = (F.col("event_type") == Event.NEW_ORDER) & (F.col("size") > 0)
    reduces = F.col("event_type").isin(int(Event.PARTIAL_CANCEL), int(Event.EXECUTION_VISIBLE)) & (F.col("size") > 0)
    cancels = F.col("event_type") == Event.FULL_CANCEL
    own = Window.partitionBy("symbol", "order_id").orderBy("seq")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    acting = (
        messages.where(F.col("event_type").isin([int(e) for e in BOOK_EVENTS]) & (opens | reduces | cancels))
        .select("symbol", "order_id", "seq", "event_type", F.col("size").cast("long").alias("size"), "price", F.col("direction").alias("side"))
        .withColumn("episode", F.sum((F.col("event_type") == Event.NEW_ORDER).cast("long")).over(so_far))
        .where("episode > 0")
    )
    episode = Window.partitionBy("symbol", "order_id", "episode").orderBy("seq")
    through = episode.rowsBetween(Window.unboundedPreceding, 0)
    opening = F.first(F.struct("size", "price", "side")).over(through)
    reduced = F.sum(F.when(F.col("event_type").isin(int(Event.PARTIAL_CANCEL), int(Event.EXECUTION_VISIBLE)), F.col("size")).otherwise(0)).over(through)
    cancelled = F.max((F.col("event_type") == Event.FULL_CANCEL).cast("int")).over(through) == 1
    held = acting.withColumns({"o": opening, "reduced": reduced, "cancelled": cancelled}).select(
        "symbol",
        "order_id",
        "seq",
        "episode",
        F.col("o.price").alias("price"),
        F.col("o.side").alias("side"),
        F.when(F.col("cancelled"), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("o.size") - F.col("reduced"))).alias("remaining"),
    )
    last = F.lag(F.struct("episode", "remaining", "price", "side")).over(own)
    stated = held.withColumn("last", last)
    same = F.col("last.episode") == F.col("episode")
    return stated.select(
        "symbol",
        "order_id",
        "seq",
        "episode",
        "price",
        "side",
        "remaining",
        F.when(same, F.col("last.remaining")).otherwise(F.lit(0).cast("long")).alias("before"),
        F.when(~same & (F.col("last.remaining") > 0), F.struct("last.remaining", "last.price", "last.side")).alias("replaced"),
    )


def level_deltas(messages: DataFrame) -> DataFrame:
    """``symbol, side, price, seq, dsize, dcount``: what each message adds to a price level; one row for each level it touches.

    A replacement takes its old order off at the old price and side.  Rows come out partitioned by level.
    """
    states = order_states(messages)
    alive = lambda c: (F.col(c) > 0).cast("long")
    nothing = F.lit(None).cast("struct<side:int,price:bigint,dsize:bigint,dcount:bigint>")
    moved = F.struct("side", "price", (F.col("remaining") - F.col("before")).alias("dsize"), (alive("remaining") - alive("before")).alias("dcount"))
    removed = F.when(
        F.col("replaced").isNotNull(),
        F.struct(F.col("replaced.side").alias("side"), F.col("replaced.price").alias("price"), (-F.col("replaced.remaining")).alias("dsize"), F.lit(-1).cast("long").alias("dcount")),
    ).otherwise(nothing)
    each = states.select("symbol", "seq", F.explode(F.filter(F.array(moved, removed), lambda d: d.isNotNull())).alias("d"))
    flat = each.select("symbol", "d.side", "d.price", "seq", "d.dsize", "d.dcount").where("dsize <> 0")
    # dealt by level first, so that summing and the windows on levels need no further exchange
    return flat.repartition("symbol", "side", "price").groupBy("symbol", "side", "price", "seq").agg(F.sum("dsize").alias("dsize"), F.sum("dcount").alias("dcount"))


def level_changes(messages: DataFrame) -> DataFrame:
    """``symbol, side, price, seq, next_seq, total_size, order_count``: each state of a level and when the next one takes over."""
    level = Window.partitionBy("symbol", "side", "price").orderBy("seq")
    so_far = level.rowsBetween(Window.unboundedPreceding, 0)
    return level_deltas(messages).select(
        "symbol",
        "side",
        "price",
        "seq",
        F.lead("seq").over(level).alias("next_seq"),
        F.sum("dsize").over(so_far).alias("total_size"),
        F.sum("dcount").over(so_far).alias("order_count"),
    )
