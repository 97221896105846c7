"""Sinks: an append-only scan store with latest views, retention, crops and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import geometry


def append_scans(scans: DataFrame, path: str) -> None:
    """Append versions partitioned by day of creation; readers take the last version of each key."""
    scans.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def as_documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON document, nulls kept so that null and empty differ."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def crops(findings: DataFrame, box: str, width: Column, height: Column, pad: float = 14.0) -> DataFrame:
    """Crop rectangles of findings with an evidence box, named by scan, position and rule."""
    rows = findings.where(F.col(box).isNotNull())
    name = F.format_string("%s_%02d_%s.png", "scan_id", "pos", F.regexp_replace("rule_id", "[^A-Za-z0-9]+", "_"))
    return rows.select("scan_id", "pos", "rule_id", name.alias("name"), geometry.padded(F.col(box), pad, width, height).alias("r")).select("scan_id", "pos", "rule_id", "name", "r.*")
