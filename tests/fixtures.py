"""Message streams with the rows they must give; None is an absent value."""

LIFECYCLE = [
    (1.5, 1, 11, 40, 5000, 1), (1.5, 1, 12, 60, 5040, -1), (2.0, 1, 13, 25, 5010, 1), (2.25, 1, 14, 35, 5010, 1), (2.5, 4, 13, 10, 5010, 1), (2.75, 2, 14, 5, 5010, 1),
    (3.0, 3, 12, 60, 5040, -1), (3.0, 1, 15, 80, 5030, -1), (3.5, 1, 16, 20, 5025, -1), (4.0, 4, 16, 20, 5025, -1), (4.5, 5, 77, 12, 5020, 1), (4.75, 1, 13, 9, 4990, 1),
    (5.0, 6, 78, 30, 5015, -1), (5.5, 3, 14, 1, 1, 1), (6.0, 4, 15, 100, 5030, -1), (6.5, 1, 17, 7, 5060, -1), (7.0, 7, 0, 0, 0, 1),
]
#: bid, ask, spread, mid, bid depth 5, ask depth 5, imbalance, vwap, flow, volatility, live orders
LIFECYCLE_ROWS = [
    (5000, None, None, None, 40, 0, 1.0, None, None, None, 1),
    (5000, 5040, 40, 5020.0, 40, 60, -0.2, None, None, None, 2),
    (5010, 5040, 30, 5025.0, 65, 60, 0.04, None, None, 0.000996, 3),
    (5010, 5040, 30, 5025.0, 100, 60, 0.25, None, None, 0.000996, 4),
    (5010, 5040, 30, 5025.0, 90, 60, 0.2, 5010.0, 1.0, 0.000996, 4),
    (5010, 5040, 30, 5025.0, 85, 60, 0.172414, 5010.0, 1.0, 0.000996, 4),
    (5010, None, None, None, 85, 0, 1.0, 5010.0, 1.0, 0.000996, 3),
    (5010, 5030, 20, 5020.0, 85, 80, 0.030303, 5010.0, 1.0, 0.001408, 4),
    (5010, 5025, 15, 5017.5, 85, 100, -0.081081, 5010.0, 1.0, 0.001493, 5),
    (5010, 5030, 20, 5020.0, 85, 80, 0.030303, 5020.0, -0.333333, 0.001574, 4),
    (5010, 5030, 20, 5020.0, 85, 80, 0.030303, 5020.0, 0.047619, 0.001574, 4),
    (5010, 5030, 20, 5020.0, 79, 80, -0.006289, 5020.0, 0.047619, 0.001574, 4),
    (5010, 5030, 20, 5020.0, 79, 80, -0.006289, 5017.916667, -0.388889, 0.001574, 4),
    (5000, 5030, 30, 5015.0, 49, 80, -0.24031, 5017.916667, -0.388889, 0.001863, 3),
    (5000, None, None, None, 49, 0, 1.0, 5024.94186, -0.744186, 0.001863, 2),
    (5000, 5060, 60, 5030.0, 49, 7, 0.75, 5024.94186, -0.744186, 0.00352, 3),
    (5000, 5060, 60, 5030.0, 49, 7, 0.75, 5024.94186, -0.744186, 0.00352, 3),
]

#: Ties in time, a replaced id, sizes that do nothing, an unknown id, too large a cancel, and the edge of the time window.
EDGES = [
    (10.0, 1, 1, 10, 100, 1), (10.0, 1, 2, 10, 110, -1), (11.0, 1, 1, 5, 90, 1), (12.0, 1, 1, 0, 95, 1), (13.0, 2, 1, -3, 90, 1), (14.0, 4, 99, 7, 105, -1),
    (15.0, 2, 1, 50, 1, -1), (16.0, 1, 3, 8, 108, 1), (316.0, 1, 4, 1, 109, 1), (316.5, 7, 0, 0, 0, 1),
]
EDGES_ROWS = [
    (100, None, None, None, 10, 0, 1.0, None, None, None, 1),
    (100, 110, 10, 105.0, 10, 10, 0.0, None, None, None, 2),
    (90, 110, 20, 100.0, 5, 10, -0.333333, None, None, 0.04879, 2),
    (90, 110, 20, 100.0, 5, 10, -0.333333, None, None, 0.04879, 2),
    (90, 110, 20, 100.0, 5, 10, -0.333333, None, None, 0.04879, 2),
    (90, 110, 20, 100.0, 5, 10, -0.333333, 105.0, -1.0, 0.04879, 2),
    (None, 110, None, None, 0, 10, -1.0, 105.0, -1.0, 0.04879, 1),
    (108, 110, 2, 109.0, 8, 10, -0.111111, 105.0, -1.0, 0.099031, 2),
    (109, 110, 1, 109.5, 9, 10, -0.052632, 105.0, -1.0, 0.004577, 3),
    (109, 110, 1, 109.5, 9, 10, -0.052632, 105.0, -1.0, 0.0, 3),
]
