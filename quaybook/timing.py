"""Timing of replays: every message goes through a book, as often as asked, and the last book is shown."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quaybook.operators.book import final_snapshot
from quaybook.operators.lifecycle import level_changes
from quaybook.operators.stateful import apply_all
from quaybook.schema import Backend


def messages_per_second(messages: int, seconds: float) -> float:
    return messages / seconds if seconds > 0 else 0.0


def average_ns_per_message(elapsed_ms: float, processed: int) -> float:
    return elapsed_ms * 1e6 / processed if processed else 0.0


@dataclass(frozen=True)
class ReplaySummary:
    backend: Backend
    processed_messages: int
    repeats: int
    elapsed_ms: float
    messages_per_second: float
    final_snapshot: Row | None


def time_replay(messages: DataFrame, backend: Backend = Backend.RELATIONAL, depth: int = 10, repeats: int = 1) -> ReplaySummary:
    """Replay ``repeats`` times, at least once; reading the messages is not timed, building books and the last snapshot is.

    Repeats are copies of every symbol, so all of them are one job: the stateful backend takes each message of each copy through a
    book, the others compute the state of the levels after each.  The stream is cached for the time being, on disk where memory is short.
    """
    repeats = max(1, repeats)
    held = messages.persist()
    try:
        n = held.count()
        began = time.perf_counter()
        copies = held.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        if backend is Backend.STATEFUL:
            force(apply_all(copies, "copy"))
        else:
            force(level_changes(copies.withColumn("symbol", F.concat_ws("#", "symbol", "copy"))))
        last = final_snapshot(held, depth).orderBy("symbol").first()
        seconds = time.perf_counter() - began
    finally:
        held.unpersist()
    return ReplaySummary(backend, n * repeats, repeats, seconds * 1e3, messages_per_second(n * repeats, seconds), last)


def force(df: DataFrame) -> float:
    """Seconds to compute every row of a frame without keeping any."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
