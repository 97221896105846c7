"""Reading order, lines and neighbours over boxes of recognised text.

Work is split by (scan_id, photo): a page holds a bounded number of spans, while a scan may hold
a tenth of all rows. Order-dependent steps run as grouped Arrow functions on one page;
neighbour searches are equality joins on the page and a height band with a range condition.

Defined results: null boxes count as 0 wide and high at the origin; spans with null text keep
their place; ties are broken by x, then span_id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.paged import by_group

PAGE = ["scan_id", "photo"]


def boxes(spans: DataFrame) -> DataFrame:
    """The columns layout needs, with nulls in numbers filled."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return spans.select("scan_id", F.coalesce("photo", F.lit(0)).alias("photo"), "span_id", "text", *(zero(c) for c in ("x", "y", "w", "h")), "confidence", "angle")


def rows_of(x: list[float], y: list[float], h: list[float]) -> list[list[int]]:
    """Rows of a page whose spans come in order of y: a span joins the first row whose running mean
    centre is within 0.6 of the upper median height; rows by centre, spans in a row by x."""
    tol = (sorted(h)[len(h) // 2] or 1.0) * 0.6
    rows: list[list[int]] = []
    sums: list[float] = []
    for i in range(len(y)):
        c = y[i] + h[i] / 2
        for k, row in enumerate(rows):
            if abs(c - sums[k] / len(row)) <= tol:
                row.append(i)
                sums[k] += c
                break
        else:
            rows.append([i])
            sums.append(c)
    by = sorted(range(len(rows)), key=lambda k: sums[k] / len(rows[k]))
    return [sorted(rows[k], key=lambda i: x[i]) for k in by]


def _cols(g: pa.RecordBatch, *names: str) -> list[list]:
    return [g.column(n).to_pylist() for n in names]


def _ordered(g: pa.RecordBatch) -> list[tuple]:
    scan, photo, ids, x, y, h = _cols(g, "scan_id", "photo", "span_id", "x", "y", "h")
    out = []
    for r, row in enumerate(rows_of(x, y, h)):
        out += [(scan[i], photo[i], ids[i], r, p, len(out) + p) for p, i in enumerate(row)]
    return out


def reading_order(spans: DataFrame) -> DataFrame:
    """(scan_id, photo, span_id, row_no, col_no, pos): the order a person reads a page in."""
    cols = boxes(spans).select(*PAGE, "span_id", "x", "y", "h")
    return by_group(cols, PAGE, ["y", "x", "span_id"], _ordered, "scan_id string, photo int, span_id long, row_no int, col_no int, pos int")


def _lines(g: pa.RecordBatch) -> list[tuple]:
    """Greedy lines: neighbours of a row join while the gap is at most 1.5 heights; a label
    that ends in a colon also takes the value to its right, up to 14 median heights away."""
    scan, photo, ids, text, x, y, w, h = _cols(g, "scan_id", "photo", "span_id", "text", "x", "y", "w", "h")
    median = sorted(h)[len(h) // 2] or 1.0
    out, line = [], 0
    for row in rows_of(x, y, h):
        last = None
        for i in row:
            if last is not None:
                label = (text[last] or "").rstrip().endswith(":")
                if x[i] - (x[last] + w[last]) > (14 * median if label else 1.5 * median):
                    line += 1
            out.append((scan[i], photo[i], ids[i], line))
            last = i
        line += 1
    return out


def line_groups(spans: DataFrame) -> DataFrame:
    """(scan_id, photo, span_id, line_no)."""
    cols = boxes(spans).select(*PAGE, "span_id", "text", "x", "y", "w", "h")
    return by_group(cols, PAGE, ["y", "x", "span_id"], _lines, "scan_id string, photo int, span_id long, line_no int")


def line_boxes(spans: DataFrame, groups: DataFrame) -> DataFrame:
    """Box, text and mean confidence of each line."""
    s = boxes(spans).join(groups.select("span_id", *PAGE, "line_no"), ["span_id", *PAGE])
    parts = F.array_sort(F.collect_list(F.struct("x", "span_id", "text")))
    out = s.groupBy(*PAGE, "line_no").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.avg("confidence").alias("confidence"), parts.alias("p")
    )
    return out.withColumn("text", F.concat_ws(" ", F.transform("p", lambda p: p["text"]))).drop("p")


BAND = 40.0


def _bands(top, bottom):
    """One row for each height band from top to bottom."""
    at = lambda c: F.floor(c / BAND).cast("long")
    return F.explode(F.sequence(at(top), at(F.greatest(top, bottom))))


def right_neighbours(spans: DataFrame, max_gap: float = 400.0, limit: int = 1) -> DataFrame:
    """(span_id, neighbour_id, gap, rank): nearest spans to the right on the same row.

    Same row: the centres are at most half the first span's height apart. The first span stands in
    all bands such a centre can have, the other in that of its centre.
    """
    s = boxes(spans).select(*PAGE, "span_id", "x", "y", "w", "h")
    # half a unit more than the span's own height, against rounding at its edges
    a = s.where("h >= 0").withColumn("band", _bands(F.expr("y - 0.5"), F.expr("y + h + 0.5")))
    b = s.withColumn("band", F.floor((F.col("y") + F.col("h") / 2) / BAND).cast("long")).toDF(*PAGE, "neighbour_id", "nx", "ny", "nw", "nh", "band")
    near = a.join(b, [*PAGE, "band"]).where("span_id <> neighbour_id and abs(y + h / 2 - ny - nh / 2) <= 0.5 * h and nx >= x + w")
    near = near.withColumn("gap", F.col("nx") - F.col("x") - F.col("w")).where(F.col("gap") <= max_gap)
    w = Window.partitionBy("span_id").orderBy("gap", "neighbour_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("span_id", "neighbour_id", "gap", "rank")


def below_neighbours(spans: DataFrame) -> DataFrame:
    """(span_id, below_id, gap): the nearest span below in the same column (first hop).

    Column: left edges within 1.5 heights or half of the narrower width shared; gap at most 1.2 heights.
    """
    s = boxes(spans).select(*PAGE, "span_id", "x", "y", "w", "h").where("h >= 1")
    a = s.withColumn("band", _bands(F.expr("y + 0.5 * h - 0.5"), F.expr("y + 2.2 * h + 0.5")))
    b = s.toDF(*PAGE, "below_id", "bx", "by", "bw", "bh").withColumn("band", F.floor(F.col("by") / BAND).cast("long"))
    near = a.join(b, [*PAGE, "band"]).where("span_id <> below_id and by >= y + h - 0.5 * h and by - y - h <= 1.2 * h")
    same = (F.abs(F.col("x") - F.col("bx")) <= 1.5 * F.col("h")) | (F.least(F.expr("x + w"), F.expr("bx + bw")) - F.greatest("x", "bx") >= 0.5 * F.least("w", "bw"))
    near = near.where(same).withColumn("gap", F.expr("by - y - h"))
    return near.groupBy("span_id").agg(F.min(F.struct("gap", "below_id")).alias("m")).select("span_id", "m.below_id", "m.gap")


def side_gaps(spans: DataFrame) -> DataFrame:
    """(span_id, gap_left, gap_right): clear space to the nearest span that shares height, in all bands both cover."""
    s = boxes(spans).select(*PAGE, "span_id", "x", "y", "w", "h")
    a = s.withColumn("band", _bands(F.col("y"), F.expr("y + h")))
    b = a.toDF(*PAGE, "other", "nx", "ny", "nw", "nh", "band")
    near = a.join(b, [*PAGE, "band"]).where("span_id <> other and ny < y + h and ny + nh > y")
    left = F.when(F.expr("nx + nw <= x"), F.expr("x - nx - nw"))
    right = F.when(F.expr("nx >= x + w"), F.expr("nx - x - w"))
    gaps = near.groupBy("span_id").agg(F.min(left).alias("gap_left"), F.min(right).alias("gap_right"))
    return s.select("span_id").join(gaps, "span_id", "left")


def curved_pages(spans: DataFrame, least: int = 5, limit: float = 2.0) -> DataFrame:
    """(scan_id, photo, mad, curved): median absolute deviation of the angles of wide lines."""
    wide = boxes(spans).where("angle is not null and w >= 3 * h")
    med = wide.groupBy(*PAGE).agg(F.median("angle").alias("m"), F.count("*").alias("n"))
    mad = wide.join(med, PAGE).groupBy(*PAGE).agg(F.median(F.abs(F.col("angle") - F.col("m"))).alias("mad"), F.max("n").alias("n"))
    return mad.select(*PAGE, "mad", ((F.col("n") >= least) & (F.col("mad") > limit)).alias("curved"))


def page_orientation(spans: DataFrame) -> DataFrame:
    """(scan_id, photo, wide, tall, turned, tilt): vote by text length; tilt if lines agree on it."""
    s = boxes(spans).where("length(trim(text)) >= 3").withColumn("n", F.length(F.trim("text")))
    tall = F.col("h") >= 1.5 * F.greatest("w", F.lit(1.0))
    v = s.groupBy(*PAGE).agg(F.sum(F.when(tall, 0).otherwise(F.col("n"))).alias("wide"), F.sum(F.when(tall, F.col("n")).otherwise(0)).alias("tall"), F.median("angle").alias("a"), (F.max("angle") - F.min("angle")).alias("spread"))
    tilt = F.when(F.abs("a").between(10, 30) & (F.col("spread") <= 3), F.col("a")).otherwise(0.0)
    return v.select(*PAGE, "wide", "tall", (F.col("tall") > F.col("wide")).alias("turned"), tilt.alias("tilt"))


def _suppressed(limit: float):
    def run(g: pa.RecordBatch) -> list[tuple]:
        scan, photo, ids, x, y, w, h = _cols(g, "scan_id", "photo", "span_id", "x", "y", "w", "h")
        kept: list[int] = []
        for i in range(len(ids)):
            for k in kept:
                iw = min(x[i] + w[i], x[k] + w[k]) - max(x[i], x[k])
                ih = min(y[i] + h[i], y[k] + h[k]) - max(y[i], y[k])
                inter = iw * ih if iw > 0 and ih > 0 else 0.0
                if inter and inter / (w[i] * h[i] + w[k] * h[k] - inter) >= limit:
                    break
            else:
                kept.append(i)
        return [(scan[i], photo[i], ids[i]) for i in kept]

    return run


def overlap_suppressed(spans: DataFrame, limit: float = 0.5) -> DataFrame:
    """(scan_id, photo, span_id) of spans kept when overlapping ones yield to the surest."""
    s = boxes(spans).select(*PAGE, "span_id", "x", "y", "w", "h", (-F.coalesce("confidence", F.lit(0.0))).alias("doubt"))
    return by_group(s, PAGE, ["doubt", "span_id"], _suppressed(limit), "scan_id string, photo int, span_id long")


def top_tokens(spans: DataFrame, token: str, share: float = 0.25) -> DataFrame:
    """(scan_id, photo, present, at_top): a whole-word token, and whether it stands in the top part."""
    s = boxes(spans)
    ends = s.groupBy(*PAGE).agg(F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"))
    hit = F.coalesce(F.lower("text").rlike(f"(^|[^a-z0-9]){token.lower()}($|[^a-z0-9])"), F.lit(False))
    top = F.col("y") + F.col("h") / 2 <= F.col("y0") + share * (F.col("y1") - F.col("y0"))
    return s.join(ends, PAGE).groupBy(*PAGE).agg(F.bool_or(hit).alias("present"), F.bool_or(hit & top).alias("at_top"))


def zoom_candidates(spans: DataFrame, width: float, height: float, least: float = 0.35) -> DataFrame:
    """(scan_id, photo, covered, zoom): share of the picture inside the hull of its text, and whether it is too small."""
    s = boxes(spans).groupBy(*PAGE).agg(((F.max(F.expr("x + w")) - F.min("x")) * (F.max(F.expr("y + h")) - F.min("y")) / (width * height)).alias("a"))
    return s.select(*PAGE, (F.floor(F.least(F.lit(1.0), F.col("a")) * 10000 + 0.5) / 10000).alias("covered"), (F.col("a") < least).alias("zoom"))


def wants_second_reading(text, confidence):
    """Not a plain Latin line that was read surely; null text is no line."""
    return text.isNotNull() & ~((F.coalesce(confidence, F.lit(0.0)) >= 0.97) & text.rlike("^[ -~]*$"))


def weakest(spans: DataFrame, below: float, limit: int) -> DataFrame:
    """(span_id, rank): the least sure lines of every photo under a confidence."""
    s = spans.select("scan_id", F.coalesce("photo", F.lit(0)).alias("photo"), "span_id", F.coalesce("confidence", F.lit(0.0)).alias("c")).where(F.col("c") < below)
    w = Window.partitionBy("scan_id", "photo").orderBy("c", "span_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("span_id", "rank")


def better_reading(old_text, old_score, new_text, new_score, gain: float = 0.05, kept: float = 0.6):
    """A second crop is taken where it is surer by ``gain`` and keeps ``kept`` of the characters."""
    return (new_score >= old_score + gain) & (F.length(new_text) >= kept * F.length(old_text))


def below_chains(spans: DataFrame, hops: int = 3) -> DataFrame:
    """(span_id, hop, below_id): the spans under a span in its column, one after the other, until the print leaves space."""
    first = below_neighbours(spans).select("span_id", "below_id")
    step = first.select(F.col("span_id").alias("at"), F.col("below_id").alias("next"))
    out = last = first.withColumn("hop", F.lit(1))
    for k in range(2, hops + 1):
        last = last.join(step, F.col("below_id") == F.col("at")).select("span_id", F.col("next").alias("below_id"), F.lit(k).alias("hop")).where("below_id <> span_id")
        out = out.unionByName(last)
    return out


def _stacked_beside(limit: int):
    def run(g: pa.RecordBatch) -> list[tuple]:
        scan, photo, ids, x, y, w, h = _cols(g, "scan_id", "photo", "span_id", "x", "y", "w", "h")

        def adjacent(a: int, b: int) -> bool:
            shared = min(y[a] + h[a], y[b] + h[b]) - max(y[a], y[b])
            gap = max(x[b] - x[a] - w[a], x[a] - x[b] - w[b])
            return a != b and shared >= 0.2 * min(h[a], h[b]) and gap <= max(4.0, min(w[a], h[a]))

        out = []
        for i in range(len(ids)):
            found: list[int] = []
            edge = [i]
            while edge and len(found) < limit:
                near = sorted({b for a in edge for b in range(len(ids)) if adjacent(a, b)} - {i, *found}, key=lambda b: abs(x[b] + w[b] / 2 - x[i] - w[i] / 2))
                edge = near[: limit - len(found)]
                found += edge
            out += [(scan[i], photo[i], ids[i], ids[b], k) for k, b in enumerate(sorted(found, key=lambda b: x[b] + w[b] / 2))]
        return out

    return run


def beside_vertical(spans: DataFrame, limit: int = 3) -> DataFrame:
    """(scan_id, photo, span_id, beside_id, pos): the sideways lines stacked next to a sideways line, left to right."""
    s = boxes(spans.where("vertical")).select(*PAGE, "span_id", "x", "y", "w", "h")
    return by_group(s, PAGE, ["x", "span_id"], _stacked_beside(limit), "scan_id string, photo int, span_id long, beside_id long, pos int")


def split_prices(prices: DataFrame, overlays: DataFrame) -> DataFrame:
    """(scan_id, printed, sticker): the greatest price under no pasted rectangle, and under one.

    prices: (scan_id, price, box), overlays: (scan_id, overlay).
    """
    from labelloom.functions.geometry import covers

    hit = prices.join(overlays, "scan_id", "left").groupBy("scan_id", "price", "box").agg(F.coalesce(F.bool_or(covers(F.col("overlay"), F.col("box"))), F.lit(False)).alias("pasted"))
    return hit.groupBy("scan_id").agg(F.max(F.when(~F.col("pasted"), F.col("price"))).alias("printed"), F.max(F.when(F.col("pasted"), F.col("price"))).alias("sticker"))
