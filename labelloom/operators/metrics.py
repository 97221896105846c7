"""Scores against answers: counts, rates and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(a: Column, b: Column) -> Column:
    """a / b at four decimals, half up; 0 where b is 0."""
    return F.when(b > 0, F.floor(a / b * 10000 + 0.5) / 10000).otherwise(0.0)


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 of counts; zero denominators give 0."""
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [(F.floor(x * 10000 + 0.5) / 10000).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1, "f1"))]


def detection_scores(rows: DataFrame, by: str, predicted: str, truth: str) -> DataFrame:
    """tp, fp, fn and scores per value of ``by``, and over all (null), in one grouping-set pass."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(truth, F.lit(False))
    counts = rows.rollup(by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return counts.select(by, "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def measurement_errors(rows: DataFrame, value: str, truth: str, tolerance: float) -> DataFrame:
    """n, mean and greatest absolute error and the share within a tolerance."""
    e = F.abs(F.col(value) - F.col(truth))
    return rows.where(e.isNotNull()).agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.max(e).alias("worst"), F.avg((e <= tolerance).cast("int")).alias("within"))


def set_scores(expected: Column, possible: Column, raised: Column) -> list[Column]:
    """Caught, missed, excused and false members of a raised set."""
    return [
        F.size(F.array_intersect(expected, raised)).alias("caught"), F.size(F.array_except(expected, raised)).alias("missed"),
        F.size(F.array_intersect(F.array_except(possible, expected), raised)).alias("excused"), F.size(F.array_except(raised, F.array_union(expected, possible))).alias("false_alarms"),
    ]


def field_match(expected: Column, got_num: Column, got_unit: Column, got_text: Column) -> Column:
    """"present" asks for any value, a number is met within 0.011, "number unit" by both, text by containment."""
    number = expected.try_cast("double")
    with_unit = F.regexp_extract(expected, r"^([0-9.]+) +([A-Za-z]+)$", 1)
    text = F.lower(F.coalesce(got_text, F.lit("")))
    return (
        F.when(expected == "present", got_num.isNotNull() | (text != ""))
        .when(number.isNotNull(), F.coalesce(F.abs(got_num - number) <= 0.011, F.lit(False)))
        .when(with_unit != "", F.coalesce((F.abs(got_num - with_unit.try_cast("double")) <= 0.011) & (F.lower(got_unit) == F.lower(F.regexp_extract(expected, r"^([0-9.]+) +([A-Za-z]+)$", 2))), F.lit(False)))
        .otherwise(text.contains(F.lower(expected)))
    )


def stability(rows: DataFrame, item: str, view: str, value: str) -> DataFrame:
    """(item, n_views, n_values): how many values an item shows over its views."""
    return rows.groupBy(item).agg(F.countDistinct(view).alias("n_views"), F.countDistinct(value).alias("n_values"))
