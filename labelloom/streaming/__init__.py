"""Structured Streaming over the append-only tables (an extension: the batch engine has no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A file stream over one table of a folder; files come in as they are added."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").option("recursiveFileLookup", True).parquet(folder)


def windowed(rows: DataFrame, at: str, key: str, late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """(start, key, n): tumbling counts; rows later than the watermark are dropped."""
    return rows.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(rows: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows with keys not seen within the watermark; re-sent rows are dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(rows: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): activity sessions."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drained(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give what it wrote (memory sink: for tests)."""
    rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.table(name)
