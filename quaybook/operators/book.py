"""Book states after every message, point lookups, snapshots and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaybook.functions.columns import ratio
from quaybook.operators.lifecycle import level_changes, level_deltas
from quaybook.plans.lineage import settle
from quaybook.plans.scan import Running, chunk_of, dealt, layout_of, running
from quaybook.schema import BUY, SELL, Backend, Layout

_SPINE = ("symbol", "seq", "timestamp", "event_type", "size", "price", "direction")


def _pieces(messages: DataFrame, depth: int, layout: Layout) -> DataFrame:
    """``symbol, chunk, start, end, last, side, level_price, total_size, order_count``: states of levels cut at chunk borders.

    ``last`` is the chunk's last message.  A level is left out of a chunk in which ``depth`` better ones live from its first message to
    its last, as it cannot come among the best ``depth`` there.
    """
    size = layout.book_chunk
    changes = level_changes(messages).where("order_count > 0")
    last = messages.groupBy("symbol").agg(F.max("seq").alias("last_seq"))
    lived = changes.join(last, "symbol").withColumn("end", F.coalesce(F.col("next_seq") - 1, F.col("last_seq")))
    chunks = F.sequence(chunk_of("seq", size), chunk_of("end", size))
    each = lived.select("symbol", F.explode(chunks).alias("chunk"), "seq", "end", "last_seq", "side", F.col("price").alias("level_price"), "total_size", "order_count")
    first, final = F.col("chunk") * size, F.least(F.col("chunk") * size + (size - 1), F.col("last_seq"))
    cut = each.select("symbol", "chunk", F.greatest("seq", first).alias("start"), F.least("end", final).alias("end"), final.alias("last"), "side", "level_price", "total_size", "order_count")
    level, side = Window.partitionBy("symbol", "chunk", "side", "level_price"), Window.partitionBy("symbol", "chunk", "side")
    whole = F.sum(F.col("end") - F.col("start") + 1).over(level) == F.col("last") - F.col("chunk") * size + 1
    marked = dealt(cut, "symbol", "chunk").withColumns({"whole": whole.cast("long"), "nth": F.row_number().over(level.orderBy("start"))})
    one = F.when(F.col("nth") == 1, F.col("whole")).otherwise(F.lit(0).cast("long"))
    up_to = F.sum(one).over(side.orderBy("level_price").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # counts from both ends rather than a falling order of negated prices, which could overflow
    better = F.when(F.col("side") == BUY, F.sum(one).over(side) - up_to).otherwise(up_to - F.col("whole"))
    return marked.withColumn("better", better).where(F.col("better") < depth).drop("whole", "nth", "better")


def _ladders_at_changes(messages: DataFrame, depth: int, layout: Layout) -> DataFrame:
    """``symbol, chunk, seq, bids, asks`` at the beginning of each chunk and wherever its best levels can change.

    Every state of a level holds over an interval of messages.  Intervals are cut at chunk borders, so changes meet only levels
    that live in their chunk, by an equality join on the chunk.
    """
    # read twice below, so they are written once
    pieces = settle(_pieces(messages, depth, layout))
    after = F.when(F.col("end") < F.col("last"), F.col("end") + 1).otherwise(F.col("start"))
    points = pieces.select("symbol", "chunk", F.explode(F.array(F.col("chunk") * layout.book_chunk, F.col("start"), after)).alias("seq")).distinct()
    p, s = points.alias("p"), pieces.alias("s")
    meets = (F.col("p.symbol") == F.col("s.symbol")) & (F.col("p.chunk") == F.col("s.chunk")) & (F.col("p.seq") >= F.col("s.start")) & (F.col("p.seq") <= F.col("s.end"))
    joined = p.join(s, meets, "left").select("p.symbol", "p.chunk", "p.seq", "side", "level_price", "total_size", "order_count")
    level = F.struct(F.col("level_price").alias("price"), "total_size", "order_count", "side")
    best = lambda side, up: F.slice(F.sort_array(F.collect_list(F.when(F.col("side") == side, level)), up), 1, depth)
    return joined.groupBy("symbol", "chunk", "seq").agg(best(BUY, False).alias("bids"), best(SELL, True).alias("asks"))


def _held(messages: DataFrame, states: DataFrame, columns: list[str], layout: Layout) -> DataFrame:
    """The messages with ``columns`` of the last state of their chunk up to them; null where a chunk has none."""
    spine = messages.select(*_SPINE, chunk_of("seq", layout.book_chunk).alias("chunk"), F.lit(1).alias("kind"))
    both = spine.unionByName(states.select("symbol", "chunk", "seq", F.lit(0).alias("kind"), F.struct(*columns).alias("state")), allowMissingColumns=True)
    so_far = Window.partitionBy("symbol", "chunk").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("state", F.last("state", ignorenulls=True).over(so_far)).where("kind = 1")
    return held.select(*_SPINE, *[F.col(f"state.{c}").alias(c) for c in columns])


def ladders(messages: DataFrame, depth: int = 10, layout: Layout = Layout()) -> DataFrame:
    """The messages with ``bids`` and ``asks``, the best ``depth`` levels of each side after each of them.

    Levels meet only at changes, and a message holds the ladders of the last one.  A message with an empty book keeps its row.
    """
    found = _held(messages, _ladders_at_changes(messages, depth, layout), ["bids", "asks"], layout)
    return found.withColumns({side: F.coalesce(side, F.array().cast(found.schema[side].dataType)) for side in ("bids", "asks")})


def _total(side: str, levels: int) -> Column:
    return F.aggregate(F.slice(side, 1, levels), F.lit(0).cast("long"), lambda a, x: a + x["total_size"])


def _ladder_columns(states: DataFrame) -> DataFrame:
    """Add best prices and depths to rows with ``bids`` and ``asks``."""
    out = states.withColumns({"best_bid": F.get("bids", F.lit(0))["price"], "best_ask": F.get("asks", F.lit(0))["price"]})
    return out.withColumns({f"{name}_depth_{k}": _total(side, k) for name, side in (("bid", "bids"), ("ask", "asks")) for k in (1, 5, 10)})


def book_columns(states: DataFrame) -> DataFrame:
    """Add best prices, depths and what derives from them to rows with ``bids`` and ``asks``."""
    return derived_columns(_ladder_columns(states))


def derived_columns(states: DataFrame) -> DataFrame:
    """Add spread, mid and imbalance to rows with best prices and depths."""
    bid, ask, b, a = (F.col(c) for c in ("best_bid", "best_ask", "bid_depth_5", "ask_depth_5"))
    return states.withColumns({"spread": F.try_subtract(ask, bid), "mid": (bid.cast("double") + ask.cast("double")) / 2, "order_imbalance": ratio(b - a, b + a)})


def book_states(messages: DataFrame, backend: Backend = Backend.CHUNKED, layout: Layout = Layout()) -> DataFrame:
    """The messages with best prices, spread, mid, depths and imbalance after each of them."""
    if backend is Backend.RELATIONAL:
        depths = [f"{name}_depth_{k}" for name in ("bid", "ask") for k in (1, 5, 10)]
        found = _held(messages, _ladder_columns(_ladders_at_changes(messages, 10, layout)), ["best_bid", "best_ask", *depths], layout)
        return derived_columns(found.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in depths}))
    from quaybook.operators.chunked import depths

    return derived_columns(depths(messages, layout))


def top_of_book(messages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``symbol, seq, best_bid, best_ask, spread, mid``."""
    return book_states(messages, Backend.CHUNKED, layout).select("symbol", "seq", "best_bid", "best_ask", "spread", "mid")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one frame has more often than the other; empty if they are equal as collections."""
    same = b.select(*a.columns)
    return a.exceptAll(same).union(same.exceptAll(a))


def active_orders(messages: DataFrame, layout: Layout | None = None) -> DataFrame:
    """``symbol, seq, active_orders``: live orders after each message."""
    layout = layout or layout_of(messages)
    changes = level_deltas(messages).groupBy("symbol", "seq").agg(F.sum("dcount").alias("dcount"))
    spine = messages.select("symbol", "seq").join(changes, ["symbol", "seq"], "left")
    counted = running(spine, ["symbol"], chunk_of("seq", layout.scan_chunk), ["seq"], [Running("active_orders", "sum", F.coalesce("dcount", F.lit(0).cast("long")))])
    return counted.select("symbol", "seq", "active_orders")


def level_at(messages: DataFrame, side: int, price: int, seq: int | None = None) -> DataFrame:
    """``symbol, side, price, total_size, order_count`` of one level after message ``seq``, or the last; no row if it is empty.

    Which orders rested there is known only from all messages up to then, but later ones are not read.
    """
    seen = messages if seq is None else messages.where(F.col("seq") <= seq)
    states = level_deltas(seen).where((F.col("side") == side) & (F.col("price") == price))
    return states.groupBy("symbol", "side", "price").agg(F.sum("dsize").alias("total_size"), F.sum("dcount").alias("order_count")).where("order_count > 0")


def final_levels(messages: DataFrame) -> DataFrame:
    """``symbol, side, price, total_size, order_count, rank`` of all levels after the last message; rank 1 is the best."""
    open_ = level_deltas(messages).groupBy("symbol", "side", "price").agg(F.sum("dsize").alias("total_size"), F.sum("dcount").alias("order_count")).where("order_count > 0")
    # separate expressions for the sides: negating a price could overflow
    order = [F.when(F.col("side") == BUY, F.col("price")).desc_nulls_last(), F.when(F.col("side") == SELL, F.col("price")).asc_nulls_last()]
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(*order)))


def final_snapshot(messages: DataFrame, depth: int = 10) -> DataFrame:
    """One row for each symbol: best levels, both ladders, spread, mid and live orders after its last message."""
    levels = final_levels(messages)
    live = levels.groupBy("symbol").agg(F.sum("order_count").alias("active_order_count"))
    level = F.struct("price", "total_size", "order_count", "side")
    top = levels.where(F.col("rank") <= depth).groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == BUY, level)), False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == SELL, level)), True).alias("asks"),
    )
    every = messages.select("symbol").distinct().join(top, "symbol", "left").join(live, "symbol", "left")
    none = F.array().cast("array<struct<price:bigint,total_size:bigint,order_count:bigint,side:int>>")
    out = every.withColumns({"bids": F.coalesce("bids", none), "asks": F.coalesce("asks", none), "active_order_count": F.coalesce("active_order_count", F.lit(0).cast("long"))})
    out = out.withColumns({"best_bid": F.get("bids", F.lit(0)), "best_ask": F.get("asks", F.lit(0))})
    bid, ask = F.col("best_bid.price"), F.col("best_ask.price")
    return out.withColumns({"spread": F.try_subtract(ask, bid), "mid_price": (bid.cast("double") + ask.cast("double")) / 2})


def book_peaks(messages: DataFrame, layout: Layout | None = None) -> DataFrame:
    """``symbol, peak_orders, peak_levels_per_side``: most live orders, and most levels of the fuller side, after any message."""
    layout = layout or layout_of(messages)
    level = Window.partitionBy("symbol", "side", "price").orderBy("seq")
    counts = level_deltas(messages).withColumn("n", F.sum("dcount").over(level.rowsBetween(Window.unboundedPreceding, 0)))
    opened = (F.col("n") > 0).cast("long") - ((F.col("n") - F.col("dcount")) > 0).cast("long")
    moves = counts.groupBy("symbol", "seq").agg(
        F.sum("dcount").alias("orders"), F.sum(F.when(F.col("side") == BUY, opened)).alias("bids"), F.sum(F.when(F.col("side") == SELL, opened)).alias("asks")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    totals = running(moves, ["symbol"], chunk_of("seq", layout.scan_chunk), ["seq"], [Running(f"n_{c}", "sum", zero(c)) for c in ("orders", "bids", "asks")])
    peaks = totals.groupBy("symbol").agg(F.max("n_orders").alias("o"), F.max(F.greatest("n_bids", "n_asks")).alias("l"))
    every = messages.select("symbol").distinct().join(peaks, "symbol", "left")
    return every.select("symbol", zero("o").alias("peak_orders"), zero("l").alias("peak_levels_per_side"))


def build_hints(messages: DataFrame, expected_orders: int = 0, expected_levels_per_side: int = 0) -> tuple[int, int]:
    """Fill in sizing hints that are zero from the peaks; both given needs no job."""
    if expected_orders and expected_levels_per_side:
        return expected_orders, expected_levels_per_side
    row = book_peaks(messages).agg(F.max("peak_orders").alias("o"), F.max("peak_levels_per_side").alias("l")).first()
    return expected_orders or row["o"] or 0, expected_levels_per_side or row["l"] or 0
