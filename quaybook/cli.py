"""Command line: ``python -m quaybook.cli FILE ...`` analyses a file, ``python -m quaybook.cli time ...`` times replays."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from pathlib import Path

from quaybook.schema import AnalyticsConfig, Backend, Layout
from quaybook.sinks.csv import backend_output_path, write_analytics_csv, write_prediction_report_csv

USAGE = """usage: quaybook FILE [--backend map|flat|both] [--depth N] [--repeat N]
                [--analytics-out PATH] [--trade-window-messages N] [--realized-vol-window-seconds X]
                [--prediction-report-out PATH --prediction-horizons N,N,...]
       quaybook time --dataset FILE [--backend map|flat|both] [--reserve on|off|both] [--depth N] [--repeat N]"""

_LARGEST = 2**31 - 1


class BadArguments(ValueError):
    pass


def positive_size(text: str) -> int:
    if not re.fullmatch(r"\s*\+?[0-9]+", text) or int(text) == 0:
        raise BadArguments(f"not a positive whole number: {text}")
    return int(text)


def positive_number(text: str) -> float:
    try:
        value = float(text) if text and not text.startswith("-") and "_" not in text and text == text.rstrip() else None
    except ValueError:
        value = None
    if value is None or value <= 0:
        raise BadArguments(f"not a positive number: {text}")
    return value


def on_off_or_both(text: str) -> str:
    if text not in ("on", "off", "both"):
        raise BadArguments(f"not on, off or both: {text}")
    return text


def horizons(text: str) -> tuple[int, ...]:
    found = []
    for entry in text.split(","):
        entry = entry.strip()
        if not entry:
            raise BadArguments("Prediction horizons must not contain empty entries")
        if not re.fullmatch(r"[+-]?[0-9]+", entry):
            raise BadArguments(f"prediction horizon is not a whole number: {entry}")
        if int(entry) <= 0:
            raise BadArguments(f"prediction horizon is not positive: {entry}")
        if int(entry) > _LARGEST:
            raise BadArguments(f"prediction horizon is too large: {entry}")
        found.append(int(entry))
    return tuple(found)


@dataclass
class Options:
    path: str = ""
    backend: str = "map"
    depth: int = 10
    repeats: int = 1
    analytics_out: str = ""
    trade_window_messages: int = 1000
    realized_vol_window_seconds: float = 300.0
    prediction_report_out: str = ""
    prediction_horizons: tuple[int, ...] = field(default=())
    #: Modes that a timing reports on; Spark sizes its own memory, so the hints are shown and change nothing.
    reserve: str = "both"


# fixed values: the flags, the names and the lines printed are what scripts look for
_FLAGS = {
    "--backend": ("backend", str),
    "--depth": ("depth", positive_size),
    "--repeat": ("repeats", positive_size),
    "--analytics-out": ("analytics_out", str),
    "--trade-window-messages": ("trade_window_messages", positive_size),
    "--realized-vol-window-seconds": ("realized_vol_window_seconds", positive_number),
    "--prediction-report-out": ("prediction_report_out", str),
    "--prediction-horizons": ("prediction_horizons", horizons),
}
_TIME_FLAGS = {"--dataset": ("path", str), "--reserve": ("reserve", on_off_or_both)} | {k: _FLAGS[k] for k in ("--backend", "--depth", "--repeat")}


def parse(arguments: list[str], flags: dict, options: Options) -> Options:
    rest = list(arguments)
    while rest:
        name = rest.pop(0)
        if name in flags:
            if not rest:
                raise BadArguments(f"{name} needs a value")
            attribute, convert = flags[name]
            setattr(options, attribute, convert(rest.pop(0)))
        elif name.startswith("--") or options.path or "--dataset" in flags:
            raise BadArguments(f"unknown argument: {name}")
        else:
            options.path = name
    if not options.path:
        raise BadArguments("no input file")
    if bool(options.prediction_report_out) != bool(options.prediction_horizons):
        raise BadArguments("--prediction-report-out and --prediction-horizons need each other")
    return options


def selected_backends(name: str) -> list[Backend]:
    """The backends of a selector, none if it is unknown; ``both`` is the relational and the stateful one."""
    if name == "both":
        return [Backend.RELATIONAL, Backend.STATEFUL]
    found = Backend.parse(name)
    return [found] if found else []


def _level(row) -> str:
    return f"{row['price']} x {row['total_size']} ({row['order_count']})" if row else "n/a"


def _time(messages, backends: list[Backend], options: Options, reserve: str | None = None) -> None:
    from quaybook.timing import average_ns_per_message, time_replay

    for b in backends:
        s = time_replay(messages, b, options.depth, options.repeats)
        ns = average_ns_per_message(s.elapsed_ms, s.processed_messages)
        mode, average = (f" reserve={reserve}", f" avg_ns_per_msg={ns:.3f}") if reserve else ("", "")
        print(
            f"Replay backend={b.value}{mode} repeats={s.repeats} processed={s.processed_messages} elapsed_ms={s.elapsed_ms:.3f}"
            f" throughput_msgs_per_sec={s.messages_per_second:.3f}{average}"
        )
        last = s.final_snapshot
        bid, ask, live = (last["best_bid"], last["best_ask"], last["active_order_count"]) if last else (None, None, 0)
        print(f"Final top: bid={_level(bid)} ask={_level(ask)} active_orders={live}")


def main(arguments: list[str]) -> int:
    if arguments == ["--help"]:
        print(USAGE)
        return 0
    timing = arguments[:1] == ["time"]
    try:
        options = parse(arguments[1:], _TIME_FLAGS, Options(backend="both", depth=5, repeats=100_000)) if timing else parse(arguments, _FLAGS, Options())
    except BadArguments as e:
        print(e, file=sys.stderr)
        print(USAGE)
        return 1

    from quaybook.operators.analytics import analytics
    from quaybook.operators.book import build_hints
    from quaybook.operators.prediction import prediction_snapshots, summarize_horizons
    from quaybook.session import local_session
    from quaybook.sources.text import exists, ingest_summary, read_lines, read_messages

    spark = local_session()
    given = options.path
    if timing and not exists(spark, options.path):
        # as given, or from the folder that holds the package
        options.path = str(Path(__file__).resolve().parent.parent / options.path)
    if not exists(spark, options.path):
        print(f"Could not open file: {options.path}", file=sys.stderr)
        return 1
    backends = selected_backends(options.backend)
    if not backends:
        print(f"Unknown backend selector: {options.backend}", file=sys.stderr)
        print(USAGE)
        return 1
    summary = ingest_summary(read_lines(spark, options.path))
    layout = Layout.for_rows(summary.parsed)
    messages = read_messages(spark, options.path)
    if timing:
        print("Benchmark results", f"Dataset argument: {given}", f"Dataset path used: {options.path}", f"Parsed messages: {summary.parsed}", sep="\n")
        print(f"Malformed messages: {summary.malformed}", f"Depth: {options.depth}", f"Repeat count: {options.repeats}", sep="\n")
        orders, levels = build_hints(messages)
        for mode in ("off", "on") if options.reserve == "both" else (options.reserve,):
            hints = (orders, levels) if mode == "on" else (0, 0)
            print(f"Reserve hints reserve={mode} expected_orders={hints[0]} expected_levels_per_side={hints[1]}")
            _time(messages, backends, options, mode)
        return 0
    print(*summary.lines(), sep="\n")
    _time(messages, backends, options)
    if not (options.analytics_out or options.prediction_report_out):
        return 0
    config = AnalyticsConfig(
        trade_window_messages=options.trade_window_messages,
        realized_vol_window_seconds=options.realized_vol_window_seconds,
        depth_levels=max(options.depth, 10),
        prediction_report_out=options.prediction_report_out or None,
        prediction_horizons_messages=options.prediction_horizons,
    )
    for b in backends:
        rows = analytics(messages, config, b, layout).persist()
        try:
            if options.analytics_out:
                path = backend_output_path(options.analytics_out, b.value, len(backends) > 1)
                write_analytics_csv(rows, path)
                print(f"Analytics CSV={path} rows={rows.count()}")
            if config.prediction_reporting_enabled:
                report = summarize_horizons(prediction_snapshots(rows), config.resolved_prediction_horizons(), layout)
                path = backend_output_path(options.prediction_report_out, b.value, len(backends) > 1)
                write_prediction_report_csv(report, path)
                print(f"Prediction report={path} rows={report.count()}")
        finally:
            rows.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
