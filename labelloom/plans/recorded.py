"""Scores of the reading of recorded recogniser dumps against an answer key.

A folder of dumps (``<photo>[.<variant>].paddle.json``) has a key ``ground_truth.yaml``: per photo the
expected fields (a number, "45 ml", text, ``present``, or ``not_legible`` / ``not_on_panel``, which are
not scored) and the rules expected and possibly raised. The key is small and parsed on the driver;
dumps are read and scored distributed.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text
from labelloom.operators import declarations, metrics
from labelloom.sources import readers


def answer_key(spark: SparkSession, folder: str) -> tuple[str, DataFrame, DataFrame]:
    """(as_of, fields (photo_name, field_id, expected), rules (photo_name, rule_id, kind)) of a folder's key."""
    import yaml

    key = yaml.safe_load((Path(folder) / "ground_truth.yaml").read_text(encoding="utf-8"))
    photos = {k: v for k, v in key.items() if isinstance(v, dict)}
    fields = [(p, f, str(e)) for p, v in photos.items() for f, e in (v.get("fields") or {}).items()]
    rules = [(p, r, kind) for p, v in photos.items() for kind in ("expected", "possible") for r in (v.get(f"{kind}_violations") or [])]
    return str(key["as_of"]), spark.createDataFrame(fields, "photo_name string, field_id string, expected string"), spark.createDataFrame(rules, "photo_name string, rule_id string, kind string")


def read_dumps(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """Declarations of every dump of a folder, named by photo and variant."""
    s = readers.recogniser_dumps(spark, f"{folder}/*.paddle.json")
    s = s.select(F.concat_ws(".", "name", "variant").alias("scan_id"), F.lit(0).alias("photo"), F.monotonically_increasing_id().alias("span_id"), text.clean(F.col("text")).alias("text"), "x", "y", "w", "h", "confidence", "angle", "vertical")
    d = declarations.declarations(s, as_of)
    parts = F.split("scan_id", r"\.")
    return d.withColumn("photo_name", parts[0]).withColumn("variant", parts[1])


def field_scores(declared: DataFrame, key: DataFrame) -> DataFrame:
    """(photo_name, variant, field_id, expected, result): correct, wrong, missed, or skipped where the key does not score."""
    d = declared.select("photo_name", "variant", "field_id", "present", "value_num", "unit", F.concat_ws(" ", "value_text", "raw_text").alias("said"))
    photos = d.select("photo_name", "variant").distinct()
    rows = photos.join(key, "photo_name").join(d, ["photo_name", "variant", "field_id"], "left")
    ok = metrics.field_match(F.col("expected"), F.col("value_num"), F.col("unit"), F.col("said"))
    present = F.coalesce("present", F.lit(False))
    result = F.when(F.col("expected").isin("not_legible", "not_on_panel"), "skipped").when(~present, "missed").when(ok, "correct").otherwise("wrong")
    return rows.select("photo_name", "variant", "field_id", "expected", result.alias("result"))


def totals(scores: DataFrame) -> DataFrame:
    """(variant, field_id, n, correct, wrong, missed, precision, recall, f1) per variant and field, per variant, and over all."""
    n = lambda r: F.count_if(F.col("result") == r)
    t = scores.where("result <> 'skipped'").rollup("variant", "field_id").agg(F.count("*").alias("n"), n("correct").alias("correct"), n("wrong").alias("wrong"), n("missed").alias("missed"))
    return t.select("*", *metrics.scores(F.col("correct"), F.col("wrong"), F.col("missed")))


def without_dump(declared: DataFrame, key: DataFrame) -> DataFrame:
    """Photos of the key that no dump was recorded for."""
    return key.select("photo_name").distinct().join(declared.select("photo_name").distinct(), "photo_name", "left_anti")
