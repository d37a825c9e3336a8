"""The registered queries over the stream that the driver's tables give, and settings they share with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaybook.functions.columns import level_text
from quaybook.operators import analytics as an
from quaybook.operators import book, lifecycle, prediction, stateful
from quaybook.plans.lineage import remove_at_exit, settle, shared_folder
from quaybook.plans.scan import dealt
from quaybook.schema import ANALYTICS, MESSAGE, AnalyticsConfig, Backend, Layout
from quaybook.sources import tables, text
from quaybook.streaming.messages import stream_analytics, write_in_order

#: The stream's days carry many messages each, so its time window is thirty of them.
CONFIG = AnalyticsConfig(trade_window_messages=200, realized_vol_window_seconds=30 * 86400.0)
HORIZONS = [1, 10, 100]
LOOKUP_PRICE = 9900
#: Days by which times are moved to and fro, so that they fall at every other message.
SHAKEN_DAYS = 50
#: Messages of a symbol in one micro-batch of the stream, which a task holds as a whole.
STREAM_MESSAGES = 400_000
#: Messages that go to Python at once there; the state of the symbol goes along with every such batch.
STREAM_BATCH = 200_000


def row_count(spark: SparkSession, sf_dir: str) -> int:
    """How many messages there are; the count comes from the files' footers."""
    return sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "lineitem"))


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    """The messages, written once as an ingest would since plans read them several times, and the layout for as many as there are."""
    layout = Layout.for_rows(row_count(spark, sf_dir))
    return settle(tables.messages_of_tables(spark, sf_dir, layout)), layout


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir)[0]


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, layout = _stream(spark, sf_dir)
    return book.book_states(messages, layout=layout)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as text, with every kind of fault in some, and counted again."""
    m = _messages(spark, sf_dir)
    field = lambda c: F.col(c).cast("string")
    cells = [F.format_string("%.6f", F.col("timestamp")), field("event_type"), field("order_id"), field("size"), field("price"), field("direction")]
    change = lambda i, c: F.concat_ws(",", *cells[:i], c, *cells[i + 1 :])
    kind = F.col("seq") % 50
    line = (
        F.when(kind == 1, F.concat_ws(",", *cells[:5]))
        .when(kind == 2, F.concat(F.concat_ws(",", *cells), F.lit(",")))
        .when(kind == 3, change(2, F.lit("abc")))
        .when(kind == 4, change(5, F.lit("0")))
        .when(kind == 5, change(1, F.lit("8")))
        .when(kind == 6, change(3, F.lit("2147483648")))
        .when(kind == 7, F.lit(""))
        .when(kind == 8, change(0, F.lit("1.0d")))
        .when(kind == 9, F.concat(F.lit(" "), F.concat_ws(" , ", *cells), F.lit(" \r")))
        .otherwise(F.concat_ws(",", *cells))
    )
    lines = m.select("symbol", line.alias("value"))
    return text.parse(lines).groupBy("symbol").agg(F.count_if(F.col("message").isNotNull()).alias("parsed"), F.count_if(F.col("message").isNull()).alias("malformed"))


def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through text and back."""
    m = _messages(spark, sf_dir)
    line = F.concat_ws(",", F.format_string("%.6f", F.col("timestamp")), *[F.col(c).cast("string") for c in ("event_type", "order_id", "size", "price", "direction")])
    # numbering has left a symbol in one task; parsing is spread again
    return text.parse(dealt(m.select("symbol", "seq", line.alias("value")))).select("symbol", "seq", "message.*")


def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.event_counts(_messages(spark, sf_dir))


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.time_range(_messages(spark, sf_dir))


def order_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = lifecycle.order_states(_messages(spark, sf_dir))
    return states.select("symbol", "order_id", "seq", "episode", "price", "side", "remaining", "before", F.col("replaced.remaining").alias("replaced_size"))


def level_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.level_deltas(_messages(spark, sf_dir))


def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.level_changes(_messages(spark, sf_dir))


def top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.top_of_book(*_stream(spark, sf_dir))


def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("symbol", "seq", *[f"{s}_depth_{k}" for s in ("bid", "ask") for k in (1, 5, 10)])


def order_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_states(spark, sf_dir).select("symbol", "seq", "order_imbalance"))


def active_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.active_orders(*_stream(spark, sf_dir))


def book_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five levels of each side after the last message."""
    return book.final_levels(_messages(spark, sf_dir)).where("rank <= 5").select("symbol", "side", "rank", "price", "total_size", "order_count")


def final_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = book.final_snapshot(_messages(spark, sf_dir), 5)
    columns: list[Column] = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("best_bid", "best_ask") for c in ("price", "total_size", "order_count")]
    return s.select("symbol", *columns, "spread", "mid_price", "active_order_count", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"))


def final_top_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = book.final_snapshot(_messages(spark, sf_dir), 1)
    return s.select("symbol", level_text(F.col("best_bid")).alias("bid"), level_text(F.col("best_ask")).alias("ask"))


def level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.level_at(_messages(spark, sf_dir), 1, LOOKUP_PRICE)


def book_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.book_peaks(*_stream(spark, sf_dir))


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, layout = _stream(spark, sf_dir)
    return an.trade_metrics(messages, CONFIG.trade_window, layout)


def rolling_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_traded(spark, sf_dir).select("symbol", "seq", "rolling_vwap"))


def trade_flow_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_traded(spark, sf_dir).select("symbol", "seq", "trade_flow_imbalance"))


def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, layout = _stream(spark, sf_dir)
    states = book.book_states(messages, layout=layout).select("symbol", "seq", "timestamp", "mid")
    return _rounded(an.realized_volatility(states, CONFIG.realized_vol_window_seconds, layout))


def volatility_of_falling_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realized volatility where time falls at every other message."""
    messages, layout = _stream(spark, sf_dir)
    moved = ((F.col("seq") * 37) % (2 * SHAKEN_DAYS + 1) - SHAKEN_DAYS) * 86400
    states = book.book_states(messages.withColumn("timestamp", F.col("timestamp") + moved), layout=layout)
    return _rounded(an.realized_volatility(states, CONFIG.realized_vol_window_seconds, layout).select("symbol", "seq", "rolling_realized_vol"))


def analytics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, layout = _stream(spark, sf_dir)
    return _rounded(an.analytics(messages, CONFIG, layout=layout))


def relational_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the interval join."""
    messages, layout = _stream(spark, sf_dir)
    return _rounded(an.analytics(messages, CONFIG, Backend.RELATIONAL, layout))


def stateful_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from the stateful backend."""
    return _rounded(stateful.replay(_messages(spark, sf_dir), CONFIG).select("symbol", "seq", *[c for c, _ in ANALYTICS]))


def streaming_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a stream over the messages, as files, until all that is there has been taken."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    write_in_order(_messages(spark, sf_dir), f"{folder}/in", STREAM_MESSAGES)
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rows = stream_analytics(stream, CONFIG, order="seq")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(STREAM_BATCH))
    try:
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(batch, before)
    return _rounded(spark.read.parquet(f"{folder}/out").select("symbol", "seq", *[c for c, _ in ANALYTICS]))


def backend_parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the relational and the stateful backend differ, by symbol; volatility and ratios to nine places."""
    messages, layout = _stream(spark, sf_dir)
    a = _rounded(an.analytics(messages, CONFIG, Backend.RELATIONAL, layout))
    b = _rounded(stateful.replay(messages, CONFIG).select("symbol", "seq", *[c for c, _ in ANALYTICS]))
    other = b.select("symbol", "seq", F.struct(*[c for c, _ in ANALYTICS]).alias("other"))
    pairs = a.select("symbol", "seq", F.struct(*[c for c, _ in ANALYTICS]).alias("own")).join(other, ["symbol", "seq"], "full")
    near = F.lit(True)
    for c, kind in ANALYTICS:
        x, y = F.col(f"own.{c}"), F.col(f"other.{c}")
        near = near & (x.eqNullSafe(y) if kind == "long" else (x.isNull() & y.isNull()) | (F.coalesce(F.abs(x - y), F.lit(1.0)) < 1.5e-6))
    return pairs.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(near, F.lit(False))).alias("differing"))


def future_move_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, layout = _stream(spark, sf_dir)
    rows = prediction.prediction_snapshots(book.book_states(messages, layout=layout))
    return prediction.future_moves(rows, layout).select("symbol", "message_index", "move", "distance")


def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, layout = _stream(spark, sf_dir)
    rows = prediction.prediction_snapshots(book.book_states(messages, layout=layout))
    return _rounded(prediction.summarize_horizons(rows, HORIZONS, layout))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        ingest_summary,
        parsed_messages,
        event_type_counts,
        time_range,
        order_remaining,
        level_deltas,
        level_changes,
        top_of_book,
        book_depth,
        order_imbalance,
        active_orders,
        book_ladder,
        final_snapshot,
        final_top_text,
        level_lookup,
        book_peaks,
        rolling_vwap,
        trade_flow_imbalance,
        realized_vol,
        volatility_of_falling_times,
        analytics_rows,
        relational_analytics,
        stateful_analytics,
        streaming_analytics,
        backend_parity_diff,
        future_move_labels,
        prediction_summary,
    )
    return {f.__name__: f for f in found}
