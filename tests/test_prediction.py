import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quaybook.operators.prediction import future_moves, summarize_horizons, validate_horizons
from quaybook.schema import REPORT, AnalyticsConfig, Layout

SNAPSHOT = "symbol string, message_index long, mid_price double, order_imbalance_top5 double"


def snapshots(spark, rows):
    return spark.createDataFrame([("x", i, None if m is None else float(m), None if x is None else float(x)) for i, (m, x) in enumerate(rows)], SNAPSHOT)


def slow_report(rows, horizon):
    """Counts in report order, hit rate, coefficient and coverage by a scan of the future of every row."""
    n = {c: 0 for c in REPORT[1:11]}
    pairs = []
    for i, (mid, x) in enumerate(rows):
        n["total_rows_seen"] += 1
        if mid is None:
            n["skipped_no_valid_mid"] += 1
            continue
        n["eligible_rows_with_valid_mid"] += 1
        later = [m for m, _ in rows[i + 1 : i + 1 + horizon] if m is not None and m != mid]
        if not later:
            n["skipped_no_future_move_within_horizon"] += 1
            continue
        move = 1 if later[0] > mid else -1
        n["labeled_rows"] += 1
        n["up_moves" if move > 0 else "down_moves"] += 1
        if x is not None:
            pairs.append((x, move))
        if not x:
            n["skipped_zero_signal"] += 1
        else:
            n["correct_predictions" if (x > 0) == (move > 0) else "incorrect_predictions"] += 1
    judged = n["correct_predictions"] + n["incorrect_predictions"]
    ic = 0.0
    if len({x for x, _ in pairs}) > 1 and len({y for _, y in pairs}) > 1:
        a, b = zip(*pairs, strict=True)
        ic = statistics.correlation(a, b)
    return tuple(n.values()), n["correct_predictions"] / judged if judged else 0.0, ic, n["labeled_rows"] / n["total_rows_seen"]


ROWS = st.lists(st.tuples(st.sampled_from([None, 20, 20, 21, 22]), st.sampled_from([None, 0.0, -0.5, 0.25, 1.0])), min_size=1, max_size=30)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, st.integers(1, 6))
def test_reports_match_a_scan_of_the_future(spark, rows, h):
    counts, hit, ic, coverage = slow_report(rows, h)
    for layout in (Layout(), Layout(scan_chunk=2)):
        r = summarize_horizons(snapshots(spark, rows), [h], layout).first()
        assert tuple(r[c] for c in REPORT[1:11]) == counts
        assert r["hit_rate"] == pytest.approx(hit)
        assert r["information_coefficient"] == pytest.approx(ic, abs=1e-6)
        assert r["coverage_vs_total"] == pytest.approx(coverage)


def test_coefficient_uses_raw_imbalance_and_skips_absent(spark):
    rows = [(50, -2), (49, -2), (47, 2), (48, 2), (49, 0.1), (49, None)]
    r = summarize_horizons(snapshots(spark, rows), [1]).first()
    assert (r["labeled_rows"], r["up_moves"], r["down_moves"], r["correct_predictions"]) == (4, 2, 2, 4)
    assert r["information_coefficient"] > 0.999999


def test_several_horizons_keep_order_and_duplicates(spark):
    rows = [(7, 0.5), (7, 0.2), (7, -0.3), (9, 0.4)]
    found = summarize_horizons(snapshots(spark, rows), [3, 1, 3]).collect()
    assert [(r["horizon_messages"], r["labeled_rows"]) for r in found] == [(3, 3), (1, 1), (3, 3)]
    assert summarize_horizons(snapshots(spark, rows), []).columns == ["symbol", *REPORT]


def test_labels_match_a_scan_of_the_future(spark):
    mids = [None, 5, 5, 6, None, 6, 5, 5, 5, 7, None, 7]
    found = future_moves(snapshots(spark, [(m, 0.1) for m in mids]), Layout(scan_chunk=4)).orderBy("message_index").collect()
    for i, r in enumerate(found):
        later = [(j - i, 1 if mids[j] > mids[i] else -1) for j in range(i + 1, len(mids)) if mids[i] is not None and mids[j] not in (None, mids[i])]
        assert (r["distance"], r["move"]) == (later[0] if later else (None, None))


def test_horizon_settings():
    with pytest.raises(ValueError):
        validate_horizons([1, 0])
    c = AnalyticsConfig(prediction_horizons=(5, 0, 2**40), prediction_report_out="r.csv")
    assert c.resolved_prediction_horizons() == [5]
    assert c.prediction_reporting_enabled
    # a message list that is all invalid does not fall back
    assert AnalyticsConfig(prediction_horizons=(5,), prediction_horizons_messages=(-1,)).resolved_prediction_horizons() == []
    assert not AnalyticsConfig(prediction_horizons=(5,)).prediction_reporting_enabled
    assert not AnalyticsConfig(prediction_horizons=(5,), prediction_report_out="").prediction_report_output_enabled
