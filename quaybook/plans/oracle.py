"""SQL for DuckDB that gives the rows of the registered queries in another way: plain windows and interval joins."""

from __future__ import annotations

from quaybook.plans.catalog import CONFIG, HORIZONS, LOOKUP_PRICE, SHAKEN_DAYS

_WIDTH = int(CONFIG.realized_vol_window_seconds)
#: More than any message number, so that time and number make one key.
_FAR = 1_000_000_000_000

_PARTS = {
    "messages": (
        (),
        """
        SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY moment, source, order_id, line, part, amount, supplier) - 1 AS seq,
               CAST(moment AS DOUBLE) AS "timestamp", event_type, order_id, size,
               CASE WHEN buys THEN 10000 - steps ELSE 10010 + steps END AS price, CASE WHEN buys THEN 1 ELSE -1 END AS direction
        FROM (
          SELECT CAST(o_orderkey % 5 AS VARCHAR) AS symbol, CAST(epoch(o_orderdate) AS BIGINT) AS moment, 1 AS event_type, o_orderkey AS order_id,
                 CAST(20 + o_orderkey % 120 AS INTEGER) AS size, (o_orderkey // 5) % 2 = 0 AS buys, o_custkey % 25 * 10 AS steps,
                 0 AS source, 0 AS line, 0 AS part, 0.0::DOUBLE AS amount, 0 AS supplier
          FROM orders
          UNION ALL
          SELECT CAST(l_orderkey % 5 AS VARCHAR), CAST(epoch(l_shipdate) AS BIGINT),
                 CAST(CASE WHEN l_linenumber = 7 THEN 1 WHEN l_linenumber = 6 THEN 5 + l_partkey % 3 WHEN l_returnflag = 'R' THEN 2
                           WHEN l_returnflag = 'A' AND l_linenumber < 3 THEN 3 ELSE 4 END AS INTEGER),
                 l_orderkey, CAST(l_quantity AS INTEGER), (l_orderkey // 5) % 2 = 0, l_partkey % 25 * 10, 1, l_linenumber, l_partkey, l_extendedprice, l_suppkey
          FROM lineitem
        )""",
    ),
    "acting": (
        ("messages",),
        """
        SELECT *, sum(CASE WHEN event_type = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, order_id ORDER BY seq) AS episode
        FROM messages WHERE event_type = 3 OR (event_type IN (1, 2, 4) AND size > 0)""",
    ),
    "held": (
        ("acting",),
        """
        SELECT symbol, order_id, seq, episode, first_value(price) OVER e AS price, first_value(direction) OVER e AS side,
               CASE WHEN max(CASE WHEN event_type = 3 THEN 1 ELSE 0 END) OVER e = 1 THEN 0
                    ELSE greatest(0, first_value(size) OVER e - sum(CASE WHEN event_type IN (2, 4) THEN size ELSE 0 END) OVER e) END AS remaining
        FROM acting WHERE episode > 0 WINDOW e AS (PARTITION BY symbol, order_id, episode ORDER BY seq)""",
    ),
    "states": (
        ("held",),
        """
        SELECT *, CASE WHEN last_episode = episode THEN last_remaining ELSE 0 END AS before,
               CASE WHEN last_episode <> episode AND last_remaining > 0 THEN last_remaining END AS replaced_size
        FROM (SELECT *, lag(episode) OVER o AS last_episode, lag(remaining) OVER o AS last_remaining, lag(price) OVER o AS last_price, lag(side) OVER o AS last_side
              FROM held WINDOW o AS (PARTITION BY symbol, order_id ORDER BY seq))""",
    ),
    "deltas": (
        ("states",),
        """
        SELECT symbol, side, price, seq, CAST(sum(dsize) AS BIGINT) AS dsize, CAST(sum(dcount) AS BIGINT) AS dcount FROM (
          SELECT symbol, side, price, seq, remaining - before AS dsize, CAST(remaining > 0 AS INTEGER) - CAST(before > 0 AS INTEGER) AS dcount FROM states
          UNION ALL SELECT symbol, last_side, last_price, seq, -replaced_size, -1 FROM states WHERE replaced_size IS NOT NULL)
        WHERE dsize <> 0 GROUP BY ALL""",
    ),
    "levels": (
        ("deltas",),
        """
        SELECT symbol, side, price, seq, lead(seq) OVER l AS next_seq, CAST(sum(dsize) OVER l AS BIGINT) AS total_size, CAST(sum(dcount) OVER l AS BIGINT) AS order_count
        FROM deltas WINDOW l AS (PARTITION BY symbol, side, price ORDER BY seq)""",
    ),
    "best": (
        ("messages", "levels"),
        """
        SELECT m.symbol, m.seq, max({'p': l.price, 's': l.total_size}, 10) FILTER (l.side = 1) AS b, min({'p': l.price, 's': l.total_size}, 10) FILTER (l.side = -1) AS a
        FROM messages m JOIN levels l ON m.symbol = l.symbol AND m.seq >= l.seq AND m.seq < coalesce(l.next_seq, 4000000000000) WHERE l.order_count > 0 GROUP BY m.symbol, m.seq""",
    ),
    "book": (
        ("messages", "best"),
        """
        SELECT *, best_ask - best_bid AS spread, (CAST(best_bid AS DOUBLE) + CAST(best_ask AS DOUBLE)) / 2 AS mid,
               CASE WHEN bid_depth_5 + ask_depth_5 > 0 THEN CAST(bid_depth_5 - ask_depth_5 AS DOUBLE) / CAST(bid_depth_5 + ask_depth_5 AS DOUBLE) END AS order_imbalance
        FROM (SELECT m.symbol, m.seq, m."timestamp", m.event_type, m.size, m.price, m.direction, b[1].p AS best_bid, a[1].p AS best_ask,
               """
        + ", ".join(f"CAST(coalesce(list_sum(list_transform({s}[1:{k}], lambda x: x.s)), 0) AS BIGINT) AS {n}_depth_{k}" for s, n in (("b", "bid"), ("a", "ask")) for k in (1, 5, 10))
        + """
              FROM messages m LEFT JOIN best USING (symbol, seq))""",
    ),
    "trades": (
        ("messages",),
        f"""
        SELECT symbol, seq, CASE WHEN q > 0 THEN CAST(p AS DOUBLE) / CAST(q AS DOUBLE) END AS rolling_vwap,
               CASE WHEN q > 0 THEN CAST(s AS DOUBLE) / CAST(q AS DOUBLE) END AS trade_flow_imbalance
        FROM (SELECT symbol, seq, sum(CASE WHEN t THEN size ELSE 0 END) OVER w AS q, sum(CASE WHEN t THEN CAST(size AS HUGEINT) * price ELSE 0 END) OVER w AS p,
                     sum(CASE WHEN t THEN size * direction ELSE 0 END) OVER w AS s
              FROM (SELECT *, event_type IN (4, 5, 6) AND size > 0 AND price > 0 AS t FROM messages)
              WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {CONFIG.trade_window - 1} PRECEDING AND CURRENT ROW))""",
    ),
    "volatility": (
        ("book",),
        f"""
        SELECT symbol, seq, CASE WHEN count(r2) OVER w >= 2
                 THEN sqrt(CAST(sum(r2) OVER w - first_value(r2 IGNORE NULLS) OVER w AS DOUBLE)) END AS rolling_realized_vol
        FROM (SELECT symbol, seq, CAST("timestamp" AS HUGEINT) * {_FAR} + seq AS k,
                     CASE WHEN mid > 0 THEN CAST(coalesce(power(ln(mid / last_value(CASE WHEN mid > 0 THEN mid END IGNORE NULLS) OVER b), 2), 0) AS DECIMAL(38, 24)) END AS r2
              FROM book WINDOW b AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WINDOW w AS (PARTITION BY symbol ORDER BY k RANGE BETWEEN CAST({_WIDTH} AS HUGEINT) * {_FAR} + {_FAR - 1} PRECEDING AND CURRENT ROW)""",
    ),
    "samples": (
        ("book",),
        f"""
        SELECT symbol, seq, t, row_number() OVER o AS pos, max(t) OVER o AS latest, sum(r2) OVER o AS total
        FROM (SELECT symbol, seq, CAST("timestamp" AS BIGINT) + (seq * 37 % {2 * SHAKEN_DAYS + 1} - {SHAKEN_DAYS}) * 86400 AS t,
                     CAST(coalesce(power(ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY seq)), 2), 0) AS DECIMAL(38, 24)) AS r2
              FROM book WHERE mid > 0)
        WINDOW o AS (PARTITION BY symbol ORDER BY seq)""",
    ),
    "moves": (
        ("book",),
        """
        SELECT symbol, seq, mid, order_imbalance, CASE WHEN mid IS NOT NULL AND turn IS NOT NULL THEN CASE WHEN next_mid > mid THEN 1 ELSE -1 END END AS move,
               CASE WHEN mid IS NOT NULL AND turn IS NOT NULL THEN turn - seq END AS distance
        FROM (SELECT *, first_value(CASE WHEN turns THEN seq END IGNORE NULLS) OVER f AS turn, first_value(CASE WHEN turns THEN mid END IGNORE NULLS) OVER f AS next_mid
              FROM (SELECT *, coalesce(mid <> last_value(mid IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS turns FROM book)
              WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
    ),
    "live": (("deltas",), "SELECT symbol, side, price, CAST(sum(dsize) AS BIGINT) AS total_size, CAST(sum(dcount) AS BIGINT) AS order_count FROM deltas GROUP BY ALL HAVING sum(dcount) > 0"),
    "final": (("live",), "SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY price * -side) AS rank FROM live"),
}

#: All columns in one pass over the book: nothing is joined to it.
_ANALYTICS = f"""
    SELECT symbol, seq, round("timestamp", 6) AS "timestamp", best_bid, best_ask, spread, round(mid, 6) AS mid,
           bid_depth_1, bid_depth_5, bid_depth_10, ask_depth_1, ask_depth_5, ask_depth_10, round(order_imbalance, 6) AS order_imbalance,
           round(CASE WHEN q > 0 THEN CAST(p AS DOUBLE) / CAST(q AS DOUBLE) END, 6) AS rolling_vwap, round(CASE WHEN q > 0 THEN CAST(s AS DOUBLE) / CAST(q AS DOUBLE) END, 6) AS trade_flow_imbalance,
           round(CASE WHEN n >= 2 THEN sqrt(CAST(total - first_r2 AS DOUBLE)) END, 6) AS rolling_realized_vol
    FROM (SELECT *, sum(CASE WHEN t THEN size ELSE 0 END) OVER w AS q, sum(CASE WHEN t THEN CAST(size AS HUGEINT) * price ELSE 0 END) OVER w AS p,
                 sum(CASE WHEN t THEN size * direction ELSE 0 END) OVER w AS s, count(r2) OVER v AS n, sum(r2) OVER v AS total, first_value(r2 IGNORE NULLS) OVER v AS first_r2
          FROM (SELECT *, event_type IN (4, 5, 6) AND size > 0 AND price > 0 AS t, CAST("timestamp" AS HUGEINT) * {_FAR} + seq AS k,
                       CASE WHEN mid > 0 THEN CAST(coalesce(power(ln(mid / last_value(CASE WHEN mid > 0 THEN mid END IGNORE NULLS) OVER b), 2), 0) AS DECIMAL(38, 24)) END AS r2
                FROM book WINDOW b AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
          WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {CONFIG.trade_window - 1} PRECEDING AND CURRENT ROW),
                 v AS (PARTITION BY symbol ORDER BY k RANGE BETWEEN CAST({_WIDTH} AS HUGEINT) * {_FAR} + {_FAR - 1} PRECEDING AND CURRENT ROW))"""

#: Where every message from the first sample on brings one, as here, those are gone before whose latest time so far is too old.
_FALLING = f"""
    SELECT b.symbol, b.seq, round(CASE WHEN n >= 2 THEN sqrt(CAST(total - first_total AS DOUBLE)) END, 6) AS rolling_realized_vol
    FROM book b LEFT JOIN (
      SELECT symbol, seq, total, count(*) OVER v AS n, first_value(total) OVER v AS first_total
      FROM (SELECT *, CAST(latest AS HUGEINT) * {_FAR} + pos AS k FROM samples)
      WINDOW v AS (PARTITION BY symbol ORDER BY k RANGE BETWEEN CAST({_WIDTH} AS HUGEINT) * {_FAR} + {_FAR - 1} PRECEDING AND CURRENT ROW)) USING (symbol, seq)"""

_TOP = """
    SELECT symbol, max(price) FILTER (side = 1 AND rank = 1) AS bid, max(total_size) FILTER (side = 1 AND rank = 1) AS bid_size,
           max(order_count) FILTER (side = 1 AND rank = 1) AS bid_count, max(price) FILTER (side = -1 AND rank = 1) AS ask,
           max(total_size) FILTER (side = -1 AND rank = 1) AS ask_size, max(order_count) FILTER (side = -1 AND rank = 1) AS ask_count,
           CAST(coalesce(sum(order_count), 0) AS BIGINT) AS active_order_count, CAST(count(*) FILTER (side = 1 AND rank <= 5) AS INTEGER) AS n_bids,
           CAST(count(*) FILTER (side = -1 AND rank <= 5) AS INTEGER) AS n_asks
    FROM (SELECT DISTINCT symbol FROM messages) LEFT JOIN final USING (symbol) GROUP BY symbol"""


def _summary() -> str:
    horizons = ", ".join(f"({i}, {h})" for i, h in enumerate(HORIZONS))
    return f"""
    SELECT symbol, horizon_messages, total_rows_seen, eligible_rows_with_valid_mid, labeled_rows, skipped_no_valid_mid, skipped_no_future_move_within_horizon,
           skipped_zero_signal, up_moves, down_moves, correct_predictions, incorrect_predictions,
           round(CASE WHEN correct_predictions + incorrect_predictions > 0 THEN correct_predictions / (correct_predictions + incorrect_predictions) ELSE 0.0 END, 6) AS hit_rate,
           round(CASE WHEN n >= 2 AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
                 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0.0 END, 6) AS information_coefficient,
           round(labeled_rows / total_rows_seen, 6) AS coverage_vs_total
    FROM (
      SELECT symbol, pos, CAST(h AS BIGINT) AS horizon_messages, count(*) AS total_rows_seen, count(mid) AS eligible_rows_with_valid_mid, count(y) AS labeled_rows,
             count(*) - count(mid) AS skipped_no_valid_mid, count(*) FILTER (mid IS NOT NULL AND y IS NULL) AS skipped_no_future_move_within_horizon,
             count(*) FILTER (y IS NOT NULL AND coalesce(x, 0) = 0) AS skipped_zero_signal, count(*) FILTER (y > 0) AS up_moves, count(*) FILTER (y < 0) AS down_moves,
             count(*) FILTER (x <> 0 AND sign(x) = y) AS correct_predictions, count(*) FILTER (x <> 0 AND sign(x) <> y) AS incorrect_predictions,
             CAST(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS DOUBLE) AS n, coalesce(sum(x) FILTER (y IS NOT NULL), 0) AS sx, coalesce(sum(y) FILTER (x IS NOT NULL), 0) AS sy,
             coalesce(sum(x * x) FILTER (y IS NOT NULL), 0) AS sxx, coalesce(sum(y * y) FILTER (x IS NOT NULL), 0) AS syy, coalesce(sum(x * y), 0) AS sxy
      FROM (SELECT symbol, pos, h, mid, order_imbalance AS x, CAST(CASE WHEN distance <= h THEN move END AS DOUBLE) AS y FROM moves, (VALUES {horizons}) AS t(pos, h))
      GROUP BY symbol, pos, h)"""


def _with(parts: tuple[str, ...], select: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for other in _PARTS[name][0]:
                add(other)
            needed.append(name)

    for p in parts:
        add(p)
    # named parts are computed once
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in needed) + select


def oracle_sql() -> dict[str, str]:
    return {
        "ingest_summary": _with(
            ("messages",), " SELECT symbol, count(*) FILTER (seq % 50 = 0 OR seq % 50 > 8) AS parsed, count(*) FILTER (seq % 50 BETWEEN 1 AND 8) AS malformed FROM messages GROUP BY symbol"
        ),
        "parsed_messages": _with(("messages",), ' SELECT symbol, seq, "timestamp", event_type, order_id, size, price, direction FROM messages'),
        "event_type_counts": _with(
            ("messages",),
            " SELECT symbol, CAST(k AS INTEGER) AS event_type, count(seq) AS n FROM (SELECT DISTINCT symbol FROM messages) CROSS JOIN range(1, 8) AS t(k)"
            " LEFT JOIN (SELECT symbol, event_type AS k, seq FROM messages) USING (symbol, k) GROUP BY symbol, k",
        ),
        "time_range": _with(("messages",), ' SELECT symbol, arg_min("timestamp", seq) AS first_timestamp, arg_max("timestamp", seq) AS last_timestamp FROM messages GROUP BY symbol'),
        "order_remaining": _with(
            ("states",),
            " SELECT symbol, order_id, seq, CAST(episode AS BIGINT) AS episode, price, side, CAST(remaining AS BIGINT) AS remaining, CAST(before AS BIGINT) AS before,"
            " CAST(replaced_size AS BIGINT) AS replaced_size FROM states",
        ),
        "level_deltas": _with(("deltas",), " SELECT * FROM deltas"),
        "level_changes": _with(("levels",), " SELECT * FROM levels"),
        "top_of_book": _with(("book",), " SELECT symbol, seq, best_bid, best_ask, spread, mid FROM book"),
        "book_depth": _with(("book",), " SELECT symbol, seq, bid_depth_1, bid_depth_5, bid_depth_10, ask_depth_1, ask_depth_5, ask_depth_10 FROM book"),
        "order_imbalance": _with(("book",), " SELECT symbol, seq, round(order_imbalance, 6) AS order_imbalance FROM book"),
        "active_orders": _with(
            ("messages", "deltas"),
            " SELECT symbol, seq, CAST(sum(coalesce(d, 0)) OVER (PARTITION BY symbol ORDER BY seq) AS BIGINT) AS active_orders FROM messages"
            " LEFT JOIN (SELECT symbol, seq, sum(dcount) AS d FROM deltas GROUP BY ALL) USING (symbol, seq)",
        ),
        "book_ladder": _with(("final",), " SELECT symbol, side, CAST(rank AS INTEGER) AS rank, price, total_size, order_count FROM final WHERE rank <= 5"),
        "final_snapshot": _with(
            ("messages", "final"),
            " SELECT symbol, bid AS best_bid_price, bid_size AS best_bid_total_size, bid_count AS best_bid_order_count, ask AS best_ask_price, ask_size AS best_ask_total_size,"
            f" ask_count AS best_ask_order_count, ask - bid AS spread, (CAST(bid AS DOUBLE) + CAST(ask AS DOUBLE)) / 2 AS mid_price, active_order_count, n_bids, n_asks FROM ({_TOP})",
        ),
        "final_top_text": _with(
            ("messages", "final"),
            " SELECT symbol, coalesce(bid || ' x ' || bid_size || ' (' || bid_count || ')', 'n/a') AS bid, coalesce(ask || ' x ' || ask_size || ' (' || ask_count || ')', 'n/a') AS ask"
            f" FROM ({_TOP})",
        ),
        "level_lookup": _with(
            ("levels",),
            f" SELECT symbol, side, price, total_size, order_count FROM levels WHERE side = 1 AND price = {LOOKUP_PRICE} AND next_seq IS NULL AND order_count > 0",
        ),
        "book_peaks": _with(
            ("messages", "levels", "deltas"),
            """ SELECT symbol, coalesce(max(o), 0) AS peak_orders, coalesce(max(greatest(b, a)), 0) AS peak_levels_per_side FROM (SELECT DISTINCT symbol FROM messages) LEFT JOIN (
              SELECT symbol, seq, CAST(sum(o) OVER w AS BIGINT) AS o, CAST(sum(b) OVER w AS BIGINT) AS b, CAST(sum(a) OVER w AS BIGINT) AS a FROM (
                SELECT symbol, seq, sum(dcount) AS o, sum(opened) FILTER (side = 1) AS b, sum(opened) FILTER (side = -1) AS a
                FROM (SELECT d.*, CAST(l.order_count > 0 AS INTEGER) - CAST(l.order_count - d.dcount > 0 AS INTEGER) AS opened
                      FROM deltas d JOIN levels l USING (symbol, side, price, seq)) GROUP BY symbol, seq)
              WINDOW w AS (PARTITION BY symbol ORDER BY seq)) USING (symbol) GROUP BY symbol""",
        ),
        "rolling_vwap": _with(("trades",), " SELECT symbol, seq, round(rolling_vwap, 6) AS rolling_vwap FROM trades"),
        "trade_flow_imbalance": _with(("trades",), " SELECT symbol, seq, round(trade_flow_imbalance, 6) AS trade_flow_imbalance FROM trades"),
        "realized_vol": _with(("volatility",), " SELECT symbol, seq, round(rolling_realized_vol, 6) AS rolling_realized_vol FROM volatility"),
        "volatility_of_falling_times": _with(("book", "samples"), _FALLING),
        "analytics_rows": _with(("book",), _ANALYTICS),
        "relational_analytics": _with(("book",), _ANALYTICS),
        "streaming_analytics": _with(("book",), _ANALYTICS),
        "stateful_analytics": _with(("book",), _ANALYTICS),
        "backend_parity_diff": _with(("messages",), " SELECT symbol, count(*) AS n_rows, CAST(0 AS BIGINT) AS differing FROM messages GROUP BY symbol"),
        "future_move_labels": _with(("moves",), " SELECT symbol, seq AS message_index, move, distance FROM moves"),
        "prediction_summary": _with(("moves",), _summary()),
    }
