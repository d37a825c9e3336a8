"""First-future-move labels and their summary for each horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaybook.functions.columns import ratio, sign
from quaybook.plans.scan import Running, chunk_of, dealt_whole, layout_of, running
from quaybook.schema import REPORT, Layout


def prediction_snapshots(rows: DataFrame) -> DataFrame:
    """``symbol, message_index, mid_price, order_imbalance_top5`` from analytics rows."""
    return rows.select("symbol", F.col("seq").alias("message_index"), F.col("mid").alias("mid_price"), F.col("order_imbalance").alias("order_imbalance_top5"))


def future_moves(snapshots: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Add ``move`` and ``distance``: sign of the first later mid that differs from the row's own, and how many rows later it is.

    Among rows with a mid, that is the next one which differs from its predecessor, whatever the horizon; so one pass serves all.
    """
    chunk = chunk_of("message_index", (layout or layout_of(snapshots)).scan_chunk)
    rows = running(dealt_whole(snapshots, chunk, "symbol"), ["symbol"], chunk, ["message_index"], [Running("previous", "last", F.col("mid_price"), inclusive=False)])
    turn = F.when(F.col("mid_price").isNotNull() & F.col("previous").isNotNull() & (F.col("mid_price") != F.col("previous")), F.struct(F.col("message_index").alias("at"), F.col("mid_price").alias("mid")))
    rows = running(rows, ["symbol"], chunk, ["message_index"], [Running("next", "last", turn, inclusive=False)], reverse=True)
    valid = F.col("mid_price").isNotNull() & F.col("next").isNotNull()
    return rows.withColumns(
        {"move": F.when(valid, sign(F.col("next.mid") - F.col("mid_price"))), "distance": F.when(valid, F.col("next.at") - F.col("message_index"))}
    ).drop("previous", "next")


def validate_horizons(horizons: list[int]) -> list[int]:
    for h in horizons:
        if h <= 0:
            raise ValueError(f"prediction horizons must be positive, got {h}")
    return list(horizons)


def summarize_horizons(snapshots: DataFrame, horizons: list[int], layout: Layout | None = None) -> DataFrame:
    """``symbol`` and the report columns, one row for each symbol and entry of ``horizons``; entries keep order and duplicates."""
    validate_horizons(horizons)
    moved = future_moves(snapshots, layout)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(h).cast("long").alias("h")) for i, h in enumerate(horizons)])) if horizons else None
    if each is None:
        return moved.limit(0).select("symbol", *[F.lit(None).cast("double" if c in REPORT[-3:] else "long").alias(c) for c in REPORT])
    rows = moved.withColumn("e", each)
    label = F.when(F.col("distance") <= F.col("e.h"), F.col("move"))
    x, eligible = F.col("order_imbalance_top5"), F.col("mid_price").isNotNull()
    rows = rows.withColumns({"pos": F.col("e.pos"), "horizon_messages": F.col("e.h"), "label": label, "eligible": eligible})
    labeled = F.col("label").isNotNull()
    signal = labeled & x.isNotNull() & (x != 0)
    seen = labeled & x.isNotNull()
    y = F.col("label").cast("double")
    total = lambda c: F.coalesce(F.sum(F.when(seen, c)), F.lit(0.0))
    sums = rows.groupBy("symbol", "pos", "horizon_messages").agg(
        F.count("*").alias("total_rows_seen"),
        F.count_if("eligible").alias("eligible_rows_with_valid_mid"),
        F.count_if(labeled).alias("labeled_rows"),
        F.count_if(~F.col("eligible")).alias("skipped_no_valid_mid"),
        F.count_if(F.col("eligible") & ~labeled).alias("skipped_no_future_move_within_horizon"),
        F.count_if(labeled & (x.isNull() | (x == 0))).alias("skipped_zero_signal"),
        F.count_if(F.col("label") > 0).alias("up_moves"),
        F.count_if(F.col("label") < 0).alias("down_moves"),
        F.count_if(signal & (sign(x) == F.col("label"))).alias("correct_predictions"),
        F.count_if(signal & (sign(x) != F.col("label"))).alias("incorrect_predictions"),
        F.count_if(seen).alias("n"),
        total(x).alias("sx"),
        total(y).alias("sy"),
        total(x * x).alias("sxx"),
        total(y * y).alias("syy"),
        total(x * y).alias("sxy"),
    )
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    ic = F.when((F.col("n") >= 2) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)).otherwise(0.0)
    done = sums.withColumns(
        {
            "hit_rate": ratio(F.col("correct_predictions"), F.col("correct_predictions") + F.col("incorrect_predictions"), 0.0),
            "information_coefficient": ic,
            "coverage_vs_total": ratio(F.col("labeled_rows"), F.col("total_rows_seen"), 0.0),
        }
    )
    return done.orderBy("symbol", "pos").select("symbol", *REPORT)
