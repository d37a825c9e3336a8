"""Columns, event codes and settings shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum

from pyspark.sql import types as T


class Event(IntEnum):
    NEW_ORDER = 1
    PARTIAL_CANCEL = 2
    FULL_CANCEL = 3
    EXECUTION_VISIBLE = 4
    EXECUTION_HIDDEN = 5
    CROSS_TRADE = 6
    TRADING_HALT = 7


#: Events that count as trades in the rolling window, whatever the book makes of them.
TRADES = (Event.EXECUTION_VISIBLE, Event.EXECUTION_HIDDEN, Event.CROSS_TRADE)
#: Events that can change the book.
BOOK_EVENTS = (Event.NEW_ORDER, Event.PARTIAL_CANCEL, Event.FULL_CANCEL, Event.EXECUTION_VISIBLE)

BUY, SELL = 1, -1


class Backend(Enum):
    """How book states are computed: by an interval join, by replays of short pieces, or by one replay of each symbol.

    The values are the names that output files and reports carry.
    """

    # fixed values: scripts look for these names
    RELATIONAL = "map"
    CHUNKED = "chunked"
    STATEFUL = "flat_vector"

    @classmethod
    def parse(cls, name: str) -> Backend | None:
        return _BACKEND_NAMES.get(name)


#: The selectors users know from other replay tools name containers; each stands for the backend in its place.
_BACKEND_NAMES = {
    "relational": Backend.RELATIONAL,
    "map": Backend.RELATIONAL,
    "chunked": Backend.CHUNKED,
    "stateful": Backend.STATEFUL,
    "flat": Backend.STATEFUL,
    "flat_vector": Backend.STATEFUL,
    "vector": Backend.STATEFUL,
}

#: One order message.  ``seq`` numbers the messages of a symbol from 0 without gaps, in the order they hold.
MESSAGE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("event_type", T.IntegerType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("price", T.LongType()),
        T.StructField("direction", T.IntegerType()),
    ]
)

#: Columns of an analytics row after ``symbol`` and ``seq``, in output order.
ANALYTICS = (
    ("timestamp", "double"),
    ("best_bid", "long"),
    ("best_ask", "long"),
    ("spread", "long"),
    ("mid", "double"),
    ("bid_depth_1", "long"),
    ("bid_depth_5", "long"),
    ("bid_depth_10", "long"),
    ("ask_depth_1", "long"),
    ("ask_depth_5", "long"),
    ("ask_depth_10", "long"),
    ("order_imbalance", "double"),
    ("rolling_vwap", "double"),
    ("trade_flow_imbalance", "double"),
    ("rolling_realized_vol", "double"),
)

#: Columns of a prediction report row after ``symbol``, in output order.
REPORT = (
    "horizon_messages",
    "total_rows_seen",
    "eligible_rows_with_valid_mid",
    "labeled_rows",
    "skipped_no_valid_mid",
    "skipped_no_future_move_within_horizon",
    "skipped_zero_signal",
    "up_moves",
    "down_moves",
    "correct_predictions",
    "incorrect_predictions",
    "hit_rate",
    "information_coefficient",
    "coverage_vs_total",
)

_LARGEST_INT = 2**31 - 1


@dataclass(frozen=True)
class AnalyticsConfig:
    """Settings of an analytics run.

    ``prediction_horizons_messages``, if not empty, alone decides the horizons, even where none of its entries is valid.
    """

    trade_window_messages: int = 1000
    realized_vol_window_seconds: float = 300.0
    depth_levels: int = 10
    expected_messages: int = 0
    prediction_horizons: tuple[int, ...] = ()
    prediction_report_out: str | None = None
    prediction_horizons_messages: tuple[int, ...] = ()

    @property
    def trade_window(self) -> int:
        return max(1, self.trade_window_messages)

    @property
    def depth(self) -> int:
        return max(self.depth_levels, 10)

    @property
    def prediction_report_output_enabled(self) -> bool:
        return bool(self.prediction_report_out)

    def resolved_prediction_horizons(self) -> list[int]:
        chosen = self.prediction_horizons_messages or self.prediction_horizons
        return [h for h in chosen if 0 < h <= _LARGEST_INT]

    @property
    def prediction_reporting_enabled(self) -> bool:
        return self.prediction_report_output_enabled and bool(self.resolved_prediction_horizons())


@dataclass(frozen=True)
class Layout:
    """How work inside one symbol is cut up; no setting changes a result."""

    #: Messages between two opening books of the interval join.
    book_chunk: int = 128
    #: Messages that one piece of a chunked replay holds.
    replay_chunk: int = 8192
    #: Messages in one piece of a running aggregate; None: a symbol is one piece.
    scan_chunk: int | None = None

    @classmethod
    def for_rows(cls, rows: int) -> Layout:
        """The layout for symbols of at most so many messages: one piece each while a task can sort it with ease."""
        return cls(scan_chunk=None if rows <= 4_000_000 else 1_000_000)
