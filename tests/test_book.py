import math
import random

import pytest
from fixtures import EDGES, EDGES_ROWS, LIFECYCLE, LIFECYCLE_ROWS
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quaybook.operators import analytics as an
from quaybook.operators import book
from quaybook.operators.replay import Book, Engine, Message
from quaybook.operators.stateful import replay
from quaybook.schema import ANALYTICS, MESSAGE, AnalyticsConfig, Backend, Layout

SHOWN = ("best_bid", "best_ask", "spread", "mid", "bid_depth_5", "ask_depth_5", "order_imbalance", "rolling_vwap", "trade_flow_imbalance", "rolling_realized_vol")
CUT = Layout(book_chunk=3, replay_chunk=4, scan_chunk=5)


def frame(spark, messages, symbol="x"):
    return spark.createDataFrame([(symbol, i, *m) for i, m in enumerate(messages)], MESSAGE)


def near(a, b, places=1e-6):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= places


@pytest.mark.parametrize(("messages", "rows"), [(LIFECYCLE, LIFECYCLE_ROWS), (EDGES, EDGES_ROWS)])
@pytest.mark.parametrize("backend", list(Backend))
@pytest.mark.parametrize("layout", [Layout(), CUT])
def test_rows_of_known_streams(spark, messages, rows, backend, layout):
    found = an.analytics(frame(spark, messages), AnalyticsConfig(), backend, layout).orderBy("seq").collect()
    assert [r["timestamp"] for r in found] == [m[0] for m in messages]
    for got, want in zip(found, rows, strict=True):
        assert all(near(got[c], w) for c, w in zip(SHOWN, want, strict=False)), (got, want)


@pytest.mark.parametrize(("messages", "rows"), [(LIFECYCLE, LIFECYCLE_ROWS), (EDGES, EDGES_ROWS)])
def test_live_orders_and_sequential_replay(spark, messages, rows):
    counted = book.active_orders(frame(spark, messages), CUT).orderBy("seq").collect()
    assert [r["active_orders"] for r in counted] == [r[-1] for r in rows]
    engine = Engine()
    assert [engine.step(Message(*m))[-1] for m in messages] == [r[-1] for r in rows]


def test_final_snapshot_peaks_and_lookup(spark):
    m = frame(spark, LIFECYCLE)
    s = book.final_snapshot(m).first()
    assert (s["best_bid"]["price"], s["best_bid"]["total_size"], s["best_ask"]["price"], s["best_ask"]["total_size"]) == (5000, 40, 5060, 7)
    assert (s["spread"], s["mid_price"], s["active_order_count"]) == (60, 5030.0, 3)
    assert tuple(book.book_peaks(m, CUT).first())[1:] == (5, 3)
    assert book.build_hints(m) == (5, 3)
    assert book.build_hints(m, 7, 9) == (7, 9)
    assert book.level_at(m, 1, 5010, 4).first()["total_size"] == 50
    assert book.level_at(m, 1, 5010).isEmpty()
    model = Book()
    for x in LIFECYCLE:
        model.apply(Message(*x))
    shown = model.snapshot(1)
    assert (shown.best_bid, shown.best_ask) == ((5000, 40, 1, 1), (5060, 7, 1, -1))
    assert (shown.spread, shown.mid_price, shown.active_order_count, len(shown.bids)) == (60, 5030.0, 3, 1)


def test_ladders_list_levels_in_price_priority(spark):
    m = [(1.0, 1, i, 10 + i, 100 - i if i < 4 else 100 + i, 1 if i < 4 else -1) for i in range(8)]
    last = book.ladders(frame(spark, m), depth=3).orderBy("seq").collect()[-1]
    assert [x["price"] for x in last["bids"]] == [100, 99, 98]
    assert [x["price"] for x in last["asks"]] == [104, 105, 106]


def test_empty_stream(spark):
    empty = spark.createDataFrame([], MESSAGE)
    for b in Backend:
        assert an.analytics(empty, backend=b).isEmpty()
    assert book.final_snapshot(empty).isEmpty()


def test_prices_at_the_ends_of_a_long(spark):
    m = [(1.0, 1, 1, 5, -(2**63) + 1, 1), (2.0, 1, 2, 5, 2**63 - 1, -1)]
    for b in Backend:
        last = an.analytics(frame(spark, m), backend=b).orderBy("seq").collect()[-1]
        assert last["spread"] is None
        assert last["mid"] == 0.0
        assert last["bid_depth_1"] == 5


ODD_TIMES = st.lists(
    st.tuples(
        st.sampled_from([0.0, 3.0, 4.0, 5.0, 11.0, 20.0, 21.0, -7.0, float("nan"), float("inf"), float("-inf")]),
        st.sampled_from([1, 1, 1, 3, 4, 5]),
        st.integers(1, 6),
        st.sampled_from([0, 5, 10]),
        st.sampled_from([98, 99, 101, 102]),
        st.sampled_from([1, -1]),
    ),
    min_size=1,
    max_size=60,
)


def oldest_first(samples, now, seconds):
    """What is left of samples once the oldest ones that are too old have gone, one after the other."""
    samples = list(samples)
    while samples and samples[0][0] < now - seconds:
        samples.pop(0)
    return samples


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ODD_TIMES)
def test_backends_agree_whatever_the_times(spark, messages):
    config = AnalyticsConfig(trade_window_messages=3, realized_vol_window_seconds=4.0)
    model, samples, want = Book(), [], []
    for x in map(Message._make, messages):
        model.apply(x)
        mid = model.snapshot(1).mid_price
        samples = oldest_first([*samples, (x.timestamp, mid)] if mid else samples, x.timestamp, 4.0)
        want.append(math.sqrt(sum(math.log(b / a) ** 2 for (_, a), (_, b) in zip(samples, samples[1:], strict=False))) if len(samples) > 1 else None)
    # a symbol of rising times beside it takes the other way
    m = frame(spark, messages).union(frame(spark, LIFECYCLE, "rising"))
    known = an.analytics(frame(spark, LIFECYCLE, "rising"), config, Backend.STATEFUL).orderBy("seq").collect()
    for b, layout in ((Backend.CHUNKED, None), (Backend.CHUNKED, CUT), (Backend.RELATIONAL, Layout()), (Backend.STATEFUL, None)):
        rows = an.analytics(m, config, b, layout).orderBy("seq").collect()
        got = [r["rolling_realized_vol"] for r in rows if r["symbol"] == "x"]
        assert len(got) == len(want)
        assert all(near(x, y, 1e-9) for x, y in zip(got, want, strict=True)), (b, layout)
        for r, k in zip([r for r in rows if r["symbol"] == "rising"], known, strict=True):
            assert all(near(x, y, 1e-9) if isinstance(x, float) else x == y for x, y in zip(r, k, strict=True)), (b, layout)


def test_values_where_time_falls(spark):
    m = [(t, 1, i, 5, p, s) for i, (t, p, s) in enumerate([(10.0, 100, 1), (10.0, 110, -1), (11.0, 101, 1), (20.0, 102, 1), (12.0, 103, 1), (21.0, 104, 1)])]
    rows = frame(spark, m)
    assert an.time_falls(rows)
    assert not an.time_falls(frame(spark, LIFECYCLE))
    step = lambda *mids: math.sqrt(sum(math.log(b / a) ** 2 for a, b in zip(mids, mids[1:], strict=False)))
    want = [None, None, step(105, 105.5), None, step(106, 106.5), step(106, 106.5, 107)]
    for b in Backend:
        got = an.analytics(rows, AnalyticsConfig(realized_vol_window_seconds=4.0), b).orderBy("seq").collect()
        assert all(near(r["rolling_realized_vol"], w, 1e-9) for r, w in zip(got, want, strict=True)), b


def test_deep_books_give_the_depths_of_a_replay(spark):
    random.seed(11)
    live, messages = [], []
    for i in range(1500):
        if live and random.random() < 0.45:
            k = live.pop(random.randrange(len(live)))
            messages.append((float(i), 3, k, 0, 0, 1))
        else:
            live.append(i)
            side = random.choice([1, -1])
            messages.append((float(i), 1, i, random.randint(1, 9), 10_000 - side * random.randint(0, 900), side))
    m = frame(spark, messages)
    columns = ["seq", "best_bid", "best_ask", *[f"{s}_depth_{k}" for s in ("bid", "ask") for k in (1, 5, 10)]]
    want = replay(m).orderBy("seq").select(*columns).collect()
    for layout in (Layout(), Layout(replay_chunk=400)):
        assert book.book_states(m, Backend.CHUNKED, layout).orderBy("seq").select(*columns).collect() == want


def slow_rows(messages, config):
    """The definition, with whole windows at every message."""
    model, out = Book(), []
    samples = []
    for i, m in enumerate(messages):
        m = Message(*m)
        model.apply(m)
        bids, asks = model.best(1, 10), model.best(-1, 10)
        mid = (bids[0][0] + asks[0][0]) / 2 if bids and asks else None
        if mid is not None and mid > 0:
            samples.append((m.timestamp, mid))
        inside = [s for t, s in samples if t >= m.timestamp - config.realized_vol_window_seconds]
        vol = math.sqrt(sum(math.log(b / a) ** 2 for a, b in zip(inside, inside[1:], strict=False))) if len(inside) > 1 else None
        trades = [Message(*x) for x in messages[max(0, i + 1 - config.trade_window) : i + 1]]
        trades = [x for x in trades if x.event_type in (4, 5, 6) and x.size > 0 and x.price > 0]
        q = sum(x.size for x in trades)
        out.append((mid, sum(b[1] for b in bids), sum(a[1] for a in asks), sum(x.size * x.price for x in trades) / q if q else None, vol))
    return out


MESSAGES = st.lists(
    st.tuples(
        st.sampled_from([0.0, 0.0, 0.5, 1.0, 7.0]),
        st.sampled_from([1, 1, 1, 2, 3, 4, 5, 6, 7]),
        st.integers(1, 12),
        st.sampled_from([-2, 0, 5, 10, 20]),
        st.sampled_from([0, 98, 99, 100, 101, 102]),
        st.sampled_from([1, -1]),
    ),
    min_size=1,
    max_size=120,
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(MESSAGES)
def test_backends_agree_on_random_streams(spark, steps):
    at, messages = 0.0, []
    for gap, *rest in steps:
        at += gap
        messages.append((at, *rest))
    config = AnalyticsConfig(trade_window_messages=9, realized_vol_window_seconds=5.0)
    want = slow_rows(messages, config)
    m = frame(spark, messages)
    for b, layout in ((Backend.CHUNKED, CUT), (Backend.RELATIONAL, Layout()), (Backend.STATEFUL, Layout())):
        rows = an.analytics(m, config, b, layout).orderBy("seq").collect()
        got = [(r["mid"], r["bid_depth_10"], r["ask_depth_10"], r["rolling_vwap"], r["rolling_realized_vol"]) for r in rows]
        assert len(got) == len(want)
        assert all(near(x, y, 1e-9) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True)), b


def test_rows_that_differ(spark):
    a, b = an.analytics(frame(spark, LIFECYCLE)), an.analytics(frame(spark, LIFECYCLE), backend=Backend.STATEFUL)
    assert book.differing_rows(a.select("seq", "mid"), b.select("mid", "seq")).isEmpty()
    assert book.differing_rows(a.select("seq"), b.where("seq > 0").select("seq")).count() == 1


def test_symbols_do_not_mix(spark):
    random.seed(2)
    a, b = frame(spark, LIFECYCLE, "a"), frame(spark, EDGES, "b")
    both = an.analytics(a.union(b), layout=CUT)
    columns = [c for c, _ in ANALYTICS]
    alone = an.analytics(a).orderBy("seq").select(*columns).collect()
    got = both.where("symbol = 'a'").orderBy("seq").select(*columns).collect()
    assert all(near(x, y, 1e-12) for r, k in zip(got, alone, strict=True) for x, y in zip(r, k, strict=True))
    assert replay(a.union(b)).count() == len(LIFECYCLE) + len(EDGES)


def test_ladders_meet_only_levels_and_messages_that_count(spark):
    random.seed(8)
    # many levels that live all along, then messages that touch a few of them or none
    m = [(float(i), 1, i, 5, 1000 - i if i % 2 else 1001 + i, 1 if i % 2 else -1) for i in range(120)]
    m += [(200.0 + i, *random.choice([(3, random.randrange(40)), (1, random.randrange(300, 320)), (7, 0), (7, 0)]), 4, 1000, 1) for i in range(120)]
    layout, model, want = Layout(book_chunk=40), Book(), []
    for x in m:
        model.apply(Message(*x))
        want.append(([p for p, *_ in model.best(1, 3)], [p for p, *_ in model.best(-1, 3)]))
    messages = frame(spark, m)
    got = [([x["price"] for x in r["bids"]], [x["price"] for x in r["asks"]]) for r in book.ladders(messages, 3, layout).orderBy("seq").collect()]
    assert got == want
    everywhere = sum(len(model.prices[s]) for s in (1, -1))
    late = book._ladders_at_changes(messages, 3, layout).where("chunk >= 3")
    pieces = book._pieces(messages, 3, layout).where("chunk >= 3").count()
    assert late.count() < 120 and pieces < everywhere * 3 / 2
