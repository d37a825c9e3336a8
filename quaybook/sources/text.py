"""Order messages from comma-separated text: strict validation, with every line accounted for.

A line is valid if it has exactly six fields, each of which converts in full and in range; blank lines and all others count as
malformed.  Quotes have no meaning.  Lines end at a line feed only, so a carriage return before it is white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaybook.functions.columns import real_number, trim, whole_number
from quaybook.plans.scan import Running, running

_FIELDS = (("timestamp", "double"), ("event_type", "int"), ("order_id", "bigint"), ("size", "int"), ("price", "bigint"), ("direction", "int"))


def parsed_line(line: Column) -> Column:
    """Struct of the six fields, or null for a malformed line."""

    def converted(text: Column) -> Column:
        return F.struct(*[(real_number(text[i]) if kind == "double" else whole_number(text[i], kind)).alias(name) for i, (name, kind) in enumerate(_FIELDS)])

    def checked(fields: Column) -> Column:
        fine = fields["event_type"].between(1, 7) & fields["direction"].isin(1, -1)
        for name, _ in _FIELDS:
            fine = fine & fields[name].isNotNull()
        return F.when(fine, fields)

    # a variable of a lambda is computed once, however often it is read
    bind = lambda value, body: F.transform(F.array(value), body)[0]
    parts = F.split(line, ",", -1)
    return bind(parts, lambda p: F.when(F.size(p) == 6, bind(F.transform(p, trim), lambda text: bind(converted(text), checked))))


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines with ``message``, the parsed struct or null; works on batches and streams alike."""
    return lines.withColumn("message", parsed_line(F.col(line)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, asked of whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``place``, which orders the lines of a file; no rows where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string, place struct<file:string,block:long,row:long>")
    text = spark.read.option("lineSep", "\n").text(path)
    # rows of one split are numbered in their order; splits are ordered by where they begin
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.select("value", place.alias("place"))


def read_messages(spark: SparkSession, path: str, symbol: str = "") -> DataFrame:
    """The valid messages of the file or files at ``path`` as one stream in file order; malformed lines are left out."""
    good = parse(read_lines(spark, path)).where("message is not null")
    # a split of a file is a chunk of the order, so no task sees more than one
    rows = good.select(F.lit(symbol).alias("symbol"), "message", "place")
    numbered = running(rows, ["symbol"], F.struct("place.file", "place.block"), ["place"], [Running("n", "sum", F.lit(1).cast("long"))])
    return numbered.select("symbol", (F.col("n") - 1).alias("seq"), *[f"message.{n}" for n, _ in _FIELDS])


def line_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row ``parsed, malformed``."""
    return parse(lines, line).agg(F.count_if(F.col("message").isNotNull()).alias("parsed"), F.count_if(F.col("message").isNull()).alias("malformed"))


def event_counts(messages: DataFrame) -> DataFrame:
    """``symbol, event_type, n`` for all seven types, zero where there is none."""
    kinds = F.explode(F.sequence(F.lit(1), F.lit(7)))
    every = messages.select("symbol").distinct().withColumn("event_type", kinds)
    counted = messages.groupBy("symbol", "event_type").agg(F.count("*").alias("n"))
    return every.join(counted, ["symbol", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def time_range(messages: DataFrame) -> DataFrame:
    """``symbol, first_timestamp, last_timestamp``: times of the first and last message, not the least and greatest."""
    return messages.groupBy("symbol").agg(F.min_by("timestamp", "seq").alias("first_timestamp"), F.max_by("timestamp", "seq").alias("last_timestamp"))


@dataclass(frozen=True)
class IngestSummary:
    parsed: int
    malformed: int
    first_timestamp: float | None
    last_timestamp: float | None
    counts: tuple[int, ...]

    def lines(self) -> list[str]:
        span = "n/a" if not self.parsed else f"{self.first_timestamp:.6f} - {self.last_timestamp:.6f}"
        return [
            f"Parsed: {self.parsed}",
            f"Malformed: {self.malformed}",
            f"Time range: {span}",
            "Event type counts:" + "".join(f" {i}:{n}" for i, n in enumerate(self.counts, 1)),
        ]


def ingest_summary(lines: DataFrame) -> IngestSummary:
    """All figures of a file's ingest in one job."""
    rows = parse(lines)
    m = F.col("message")
    place = F.when(m.isNotNull(), F.col("place"))
    counts = [F.count_if(m["event_type"] == k).alias(f"n{k}") for k in range(1, 8)]
    r = rows.agg(
        F.count_if(m.isNotNull()).alias("parsed"),
        F.count_if(m.isNull()).alias("malformed"),
        F.min_by(m["timestamp"], place).alias("first"),
        F.max_by(m["timestamp"], place).alias("last"),
        *counts,
    ).first()
    return IngestSummary(r["parsed"], r["malformed"], r["first"], r["last"], tuple(r[f"n{k}"] for k in range(1, 8)))
