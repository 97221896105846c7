"""Boxes, scales and angles as Column expressions. A box is a struct x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(w).alias("w"), F.col(h).alias("h"))


def contains(a: Column, b: Column, tol: float = 0.0) -> Column:
    return (a["x"] - tol <= b["x"]) & (a["y"] - tol <= b["y"]) & (a["x"] + a["w"] + tol >= b["x"] + b["w"]) & (a["y"] + a["h"] + tol >= b["y"] + b["h"])


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    inter = overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))


def shifted(a: Column, dy: Column) -> Column:
    return a.withField("y", a["y"] + dy)


def padded(a: Column, pad: float, width: Column, height: Column) -> Column:
    """A crop rectangle: the box with a margin, inside the picture."""
    x, y = F.greatest(F.lit(0.0), a["x"] - pad), F.greatest(F.lit(0.0), a["y"] - pad)
    return F.struct(x.alias("x"), y.alias("y"), (F.least(width, a["x"] + a["w"] + pad) - x).alias("w"), (F.least(height, a["y"] + a["h"] + pad) - y).alias("h"))


def polygon_box(poly: Column) -> Column:
    """The axis-aligned box of a polygon (array of [x, y])."""
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def polygon_angle(poly: Column) -> Column:
    """Slope of the longer of the first two sides in degrees, folded into (-45, 45]; 0 for fewer than four points."""
    side = lambda i, k: poly[i + 1][k] - poly[i][k]
    first = F.hypot(side(0, 0), side(0, 1)) >= F.hypot(side(1, 0), side(1, 1))
    a = F.degrees(F.atan2(F.when(first, side(0, 1)).otherwise(side(1, 1)), F.when(first, side(0, 0)).otherwise(side(1, 0))))
    a = F.when(a > 90, a - 180).when(a <= -90, a + 180).otherwise(a)
    a = F.when(a > 45, a - 90).when(a <= -45, a + 90).otherwise(a)
    return F.when(F.size(poly) < 4, 0.0).otherwise(F.bround(a, 2))


def is_vertical(w: Column, h: Column, text: Column) -> Column:
    return (F.length(F.trim(text)) >= 3) & (h >= 1.5 * F.greatest(w, F.lit(1.0)))


def rotated_point(x: Column, y: Column, turn: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point after quarter turns (0, 90, 180, 270 degrees clockwise) of a picture."""
    return (
        F.when(turn == 90, height - y).when(turn == 180, width - x).when(turn == 270, y).otherwise(x),
        F.when(turn == 90, x).when(turn == 180, height - y).when(turn == 270, width - x).otherwise(y),
    )


def px_to_mm(px: Column, px_per_mm: Column) -> Column:
    return F.when(px_per_mm > 0, px / px_per_mm)


def mm_uncertainty(px: Column, px_per_mm: Column, sigma: Column) -> Column:
    """Error of a length from the error of the scale: |px / s^2| * sigma."""
    return F.when(px_per_mm > 0, F.abs(px / (px_per_mm * px_per_mm)) * sigma)


def panel_area_cm2(quad: Column, px_per_mm: Column) -> Column:
    """Area of a four-cornered panel from the means of its opposite sides; null otherwise."""
    d = lambda i, j: F.hypot(quad[j][0] - quad[i][0], quad[j][1] - quad[i][1])
    w, h = (d(0, 1) + d(3, 2)) / 2, (d(1, 2) + d(0, 3)) / 2
    return F.when((F.size(quad) == 4) & (px_per_mm > 0), w * h / (px_per_mm * px_per_mm) / 100)


def known_scale(px: Column, mm: Column, err_mm: Column) -> Column:
    """Scale from a known dimension: px per mm and its standard error."""
    s = px / mm
    return F.when((px > 0) & (mm > 0), F.struct(s.alias("px_per_mm"), (s * err_mm / mm).alias("sigma")))


def agreed_scale(scales: Column, spread: float = 0.15) -> Column:
    """One scale from several stated references (an array of px per mm): their mean, null where they differ by more than ``spread``."""
    known = F.filter(scales, lambda x: x.isNotNull() & (x > 0))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when((F.size(known) > 0) & ((F.array_max(known) - F.array_min(known)) <= spread * mean), mean)


def glyph_height(px: Column, px_per_mm: Column) -> Column:
    """struct(mm, uncertainty) of a glyph's height at a scale; half a pixel is the least uncertainty."""
    return F.when((px_per_mm > 0) & px.isNotNull(), F.struct((px / px_per_mm).alias("mm"), (F.lit(0.5) / px_per_mm).alias("uncertainty")))


def covers(overlay: Column, b: Column) -> Column:
    """A pasted rectangle holds a box (with 6 pixels to spare) or overlaps it by more than 0.3."""
    return contains(overlay, b, 6.0) | (iou(overlay, b) > 0.3)
