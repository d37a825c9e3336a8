"""Times the headline queries on one machine and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from quaybook.plans import catalog
from quaybook.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "parsed_messages",
    "order_remaining",
    "level_changes",
    "top_of_book",
    "book_depth",
    "active_orders",
    "final_snapshot",
    "book_peaks",
    "rolling_vwap",
    "realized_vol",
    "analytics_rows",
    "stateful_analytics",
    "future_move_labels",
    "prediction_summary",
)


def main(names: list[str]) -> None:
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8, memory="8g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # one small query first, so that the first figure is not the start of the machine
    queries["event_type_counts"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names or HEADLINE:
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    messages = catalog.row_count(spark, SF_DIR)
    rate = {f"{q}_messages_per_second": round(messages / seconds[q]) for q in ("final_snapshot", "analytics_rows", "stateful_analytics") if q in seconds}
    print(json.dumps({"metric": "order book queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR, "messages": messages, **rate}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
