"""Readings completed from a second reader, blocks of lines, panels and date pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import geometry, text


def completed(found: DataFrame, second: DataFrame, keys: list[str], seen: DataFrame | None = None) -> DataFrame:
    """(keys, value, confidence, source): found values, and where one lacks the second reader's.

    found: (keys, value, confidence); second: (keys, value). With ``seen`` (keys[0], text: the lines
    of an item) a second reading that stands in a line is confirmed (0.7, 'second+first'),
    else it is held (0.45, 'second').
    """
    f = found.where("value is not null").select(*keys, "value", "confidence", F.lit("first").alias("source"))
    s = second.where("value is not null").join(f.select(*keys), keys, "left_anti")
    agreed = F.lit(False)
    if seen is not None:
        # each line of an item is asked for the value, and the answers meet in a partial aggregate
        key = text.name_key(F.col("value"))
        said = s.join(seen.select(keys[0], F.col("text").alias("_seen")), keys[0])
        hit = said.groupBy(*keys).agg(F.bool_or(F.contains(text.name_key(F.col("_seen")), key) & (key != "")).alias("_hit"))
        s = s.join(hit, keys, "left")
        agreed = F.coalesce("_hit", F.lit(False))
    s = s.select(*keys, "value", F.when(agreed, 0.7).otherwise(0.45).alias("confidence"), F.when(agreed, "second+first").otherwise("second").alias("source"))
    return f.unionByName(s)


def joined_block(lines: Column) -> Column:
    """Address lines as one text: commas between lines that do not end in punctuation, none after a label."""
    step = lambda acc, x: F.when(acc == "", x).when(acc.rlike(r"[,:;.&/-]\s*$"), F.concat(acc, F.lit(" "), x)).otherwise(F.concat(acc, F.lit(", "), x))
    return F.aggregate(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), F.lit("").cast("string"), step)


def is_bare_label(c: Column) -> Column:
    """A line that is a label and nothing else."""
    return F.lower(F.trim(c)).rlike(r"^[^a-z0-9]*(m[.]?r[.]?p[.]?|net (qty|quantity|wt|weight|contents?)|(mfg|mfd|pkd)[.]?( date| by)?|(manufactured|packed|marketed) (by|on)|consumer care|customer care|best before|batch no[.]?|country of origin|unit (sale )?price)[^a-z0-9]*$")


def vertical_gaps(spans: DataFrame) -> DataFrame:
    """(span_id, gap_top, gap_bottom): clear space to the nearest span above and below that shares width.

    Pages are joined on width bands, as side gaps are on height bands.
    """
    from labelloom.operators.layout import PAGE, boxes

    band = 100.0
    s = boxes(spans).select(*PAGE, "span_id", "x", "y", "w", "h")
    cover = F.sequence(F.floor(F.col("x") / band).cast("long"), F.floor((F.col("x") + F.greatest("w", F.lit(0.0))) / band).cast("long"))
    a = s.withColumn("band", F.explode(cover))
    b = a.toDF(*PAGE, "other", "nx", "ny", "nw", "nh", "band")
    near = a.join(b, [*PAGE, "band"]).where("span_id <> other and nx < x + w and nx + nw > x")
    gaps = near.groupBy("span_id").agg(F.min(F.expr("case when ny + nh <= y then y - ny - nh end")).alias("gap_top"), F.min(F.expr("case when ny >= y + h then ny - y - h end")).alias("gap_bottom"))
    return s.select("span_id").join(gaps, "span_id", "left")


def best_panels(panels: DataFrame, spans: DataFrame, width: Column, height: Column, least: float = 0.6) -> DataFrame:
    """(scan_id, panel_id, coverage, score): the panel that holds most text, if it holds enough.

    panels: (scan_id, panel_id, box, rectangularity). Score: twice the share of spans inside plus
    half the rectangularity plus half the share of the picture.
    """
    s = spans.where("span_id is not null").select("scan_id", "span_id", geometry.box().alias("b"))
    inside = panels.join(s, "scan_id").groupBy("scan_id", "panel_id").agg(F.avg(geometry.contains(F.col("box"), F.col("b"), 2.0).cast("int")).alias("coverage"), F.first("box").alias("box"), F.first("rectangularity").alias("rect"))
    score = 2 * F.col("coverage") + 0.5 * F.col("rect") + 0.5 * F.col("box.w") * F.col("box.h") / (width * height)
    best = inside.withColumn("score", score).groupBy("scan_id").agg(F.max(F.struct("score", "panel_id", "coverage")).alias("m"))
    return best.select("scan_id", "m.panel_id", "m.coverage", "m.score").where(F.col("coverage") >= least)


def date_pair(dates: Column) -> Column:
    """struct(first, last) of an unlabelled pair of ISO dates: the earlier is the making, the later the end."""
    d = F.array_distinct(F.filter(dates, lambda x: x.isNotNull()))
    return F.when(F.size(d) >= 2, F.struct(F.array_min(d).alias("first"), F.array_max(d).alias("last")))


def nearest_below_label(lines: DataFrame, label: str, value: str, keys: list[str]) -> DataFrame:
    """(keys, label_id, value_id): a value off its label's row: the nearest matching line below or beside.

    lines: (keys, line_id, text, x, y, w, h); label and value are patterns on lower-case text.
    """
    a = lines.where(F.lower("text").rlike(label)).select(*keys, F.col("line_id").alias("label_id"), "x", "y", "w", "h")
    b = lines.where(F.lower("text").rlike(value)).select(*keys, F.col("line_id").alias("value_id"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    near = a.join(b, keys).where("label_id <> value_id and vy >= y - 0.5 * h and vy - y <= 4 * h and abs(vx - x) <= 14 * h")
    best = near.groupBy(*keys, "label_id").agg(F.min(F.struct((F.col("vy") - F.col("y")).alias("dy"), F.abs(F.col("vx") - F.col("x")).alias("dx"), "value_id")).alias("m"))
    return best.select(*keys, "label_id", "m.value_id")
