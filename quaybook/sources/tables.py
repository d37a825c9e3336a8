"""A stream of order messages derived from the ``orders`` and ``lineitem`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaybook.plans.scan import Running, dealt_whole, running
from quaybook.schema import Layout

#: Seconds in one piece of the numbering of long symbols.
_SPAN = 90 * 86400


def _seconds(day: str) -> Column:
    return F.unix_seconds(F.col(day).cast("timestamp"))


def _sided(key: str, spread_by: str) -> list[Column]:
    """Direction and price: orders alternate sides by blocks of five keys, prices spread over 25 levels a side."""
    buys = F.pmod(F.floor(F.col(key) / 5), F.lit(2)) == 0
    steps = F.col(spread_by) % 25 * 10
    return [F.when(buys, 1).otherwise(-1).alias("direction"), F.when(buys, 10000 - steps).otherwise(10010 + steps).cast("long").alias("price")]


def messages_of_tables(spark: SparkSession, sf_dir: str, layout: Layout = Layout()) -> DataFrame:
    """Messages of five symbols: an order is an add; its lines cancel, execute, replace or trade, by line number and flag."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (F.col("o_orderkey") % 5).cast("string").alias("symbol"),
        _seconds("o_orderdate").alias("at"),
        F.lit(1).alias("event_type"),
        F.col("o_orderkey").alias("order_id"),
        (20 + F.col("o_orderkey") % 120).cast("int").alias("size"),
        *_sided("o_orderkey", "o_custkey"),
        F.lit(0).alias("source"),
        F.lit(0).alias("line"),
        F.lit(0).cast("long").alias("part"),
        F.lit(0.0).alias("amount"),
        F.lit(0).cast("long").alias("supplier"),
    )
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    event = F.when(line == 7, 1).when(line == 6, 5 + F.col("l_partkey") % 3).when(flag == "R", 2).when((flag == "A") & (line < 3), 3).otherwise(4)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") % 5).cast("string").alias("symbol"),
        _seconds("l_shipdate").alias("at"),
        event.cast("int").alias("event_type"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_quantity").cast("int").alias("size"),
        *_sided("l_orderkey", "l_partkey"),
        F.lit(1).alias("source"),
        line.alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_suppkey").alias("supplier"),
    )
    both = orders.unionByName(lines)
    span = None if layout.scan_chunk is None else F.floor(F.col("at") / _SPAN).cast("long")
    order = ["at", "source", "order_id", "line", "part", "amount", "supplier"]
    numbered = running(dealt_whole(both, span, "symbol"), ["symbol"], span, order, [Running("n", "sum", F.lit(1).cast("long"))])
    return numbered.select("symbol", (F.col("n") - 1).alias("seq"), F.col("at").cast("double").alias("timestamp"), "event_type", "order_id", "size", "price", "direction")
