"""Neighbours and gaps with large print, against every pair of spans."""

import random

from labelloom.operators import layout, recovery

S = "scan_id string, photo int, span_id long, text string, x double, y double, w double, h double, confidence double, angle double"


def page():
    rng = random.Random(7)
    sizes = [0.0, 0.5, 1.0, 12.0, 20.0, 60.0, 75.0, 200.0]
    boxes = [(float(rng.randrange(1500)), float(rng.randrange(-50, 900)), rng.choice([30.0, 120.0, 2500.0]), rng.choice(sizes)) for _ in range(120)]
    return dict(enumerate(boxes))


def least(pairs):
    return min(pairs, default=(None, None))


def test_spans_of_every_size_equal_brute_force(spark):
    at = page()
    df = spark.createDataFrame([("s", 0, i, "t", *b, 0.9, 0.0) for i, b in at.items()], S)
    right, below, side, stacked = {}, {}, {}, {}
    for i, (x, y, w, h) in at.items():
        others = [(j, *b) for j, b in at.items() if j != i]
        right[i] = least((bx - x - w, j) for j, bx, by, bw, bh in others if abs(y + h / 2 - by - bh / 2) <= 0.5 * h and bx >= x + w and bx - x - w <= 400)
        near = [(by - y - h, j) for j, bx, by, bw, bh in others if h >= 1 and bh >= 1 and by >= y + 0.5 * h and by - y - h <= 1.2 * h and (abs(x - bx) <= 1.5 * h or min(x + w, bx + bw) - max(x, bx) >= 0.5 * min(w, bw))]
        below[i] = least(near)
        beside = [b for b in others if b[2] < y + h and b[2] + b[4] > y]
        side[i] = tuple(min(g, default=None) for g in ([x - b[1] - b[3] for b in beside if b[1] + b[3] <= x], [b[1] - x - w for b in beside if b[1] >= x + w]))
        over = [b for b in others if b[1] < x + w and b[1] + b[3] > x]
        stacked[i] = tuple(min(g, default=None) for g in ([y - b[2] - b[4] for b in over if b[2] + b[4] <= y], [b[2] - y - h for b in over if b[2] >= y + h]))
    assert {r.span_id: (r.gap, r.neighbour_id) for r in layout.right_neighbours(df).collect()} == {i: v for i, v in right.items() if v[1] is not None}
    assert {r.span_id: (r.gap, r.below_id) for r in layout.below_neighbours(df).collect()} == {i: v for i, v in below.items() if v[1] is not None}
    assert {r.span_id: (r.gap_left, r.gap_right) for r in layout.side_gaps(df).collect()} == side
    assert {r.span_id: (r.gap_top, r.gap_bottom) for r in recovery.vertical_gaps(df).collect()} == stacked
