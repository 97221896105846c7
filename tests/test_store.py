import datetime
import json

import pytest
from pyspark.sql import functions as F

from labelloom import sources, streaming
from labelloom.operators import extraction, metrics
from labelloom.plans import repository
from labelloom.sources import readers, sinks


def day(n):
    return datetime.datetime(2024, 1, n)


def test_latest_version(spark):
    df = spark.createDataFrame([("a", day(1), "x"), ("a", day(2), "y"), ("a", day(2), "y"), ("b", None, "z"), (None, day(1), "n")], "k string, at timestamp, v string")
    assert sorted((r.k, r.v) for r in repository.latest(df, "k", "at", "v").collect()) == [("a", "y"), ("b", "z")]
    assert repository.latest(df.limit(0), "k", "at", "v").count() == 0


def test_open_events(spark):
    df = spark.createDataFrame([("a", 1, 1, "open"), ("a", 2, 2, "close"), ("b", 1, 3, "close"), ("b", 1, 4, "open"), ("c", 1, 5, "close")], "k string, at int, i int, e string")
    r = repository.last_event_open(df, "k", "at", "i", F.col("e") == "open", F.col("e") == "close")
    assert {x.k: x.is_open for x in r.collect()} == {"a": False, "b": True, "c": False}


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", day(1), day(1), "x"), ("a", day(1), day(3), "y")], "scan_id string, created_at timestamp, ingested_at timestamp, verdict string")
    sinks.append_scans(df, str(tmp_path / "s"))
    sinks.append_scans(df.limit(1), str(tmp_path / "s"))
    back = readers.stored_scans(spark, str(tmp_path / "s"))
    assert [r.verdict for r in repository.latest(back, "scan_id", "ingested_at", "verdict").collect()] == ["y"]
    assert json.loads(sinks.as_documents(df.select("scan_id", F.lit(None).cast("string").alias("n")), "scan_id").first().json) == {"scan_id": "a", "n": None}


def test_dumps(spark, tmp_path):
    d = {"source": "a.jpg", "regions": [{"text": "心 Net", "score": 0.9, "poly": [[0, 0], [10, 0], [10, 5], [0, 5]], "engine": "e", "language": "en"}, {"text": "印", "score": 0.9, "poly": [[0, 0]]}]}
    (tmp_path / "a.dump.json").write_text(json.dumps(d), encoding="utf-8")
    r = sources.reader("dump")(spark, str(tmp_path)).collect()
    assert [(x.name, x.text, x.w, x.h, x.vertical) for x in r] == [("a", "Net", 10.0, 5.0, False)]
    with pytest.raises(ValueError):
        sources.reader("other")


def test_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0abc\xff\xd9")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (tmp_path / "c.bin").write_bytes(b"GIF89a")
    r = {x.path.rsplit("/", 1)[1]: x.why for x in readers.images(spark, str(tmp_path)).collect()}
    assert r == {"a.jpg": None, "b.jpg": "truncated", "c.bin": "unknown format"}


def test_fields(spark):
    df = spark.createDataFrame([(1, "Net Qty: 0.5 kg\nMRP: Rs. 149.50\nMRP: Rs. 1.00\nPKD 06/2025\nBest before 8 months", 0), (2, None, 0), (3, "", 0)], "k int, t string, line_no int")
    f = extraction.first_fields(extraction.lines_of(df, "k", "t"), ["k"], ["line_no"], "line")
    p = extraction.pivoted(f, ["k"]).withColumn("d", extraction.expiry(F.col("manufacture_date"), F.col("shelf_months"))).collect()
    assert [(r.k, r.net_quantity, r.net_quantity_unit, r.retail_sale_price, str(r.d)) for r in p] == [(1, 0.5, "kg", 149.5, "2026-02-28")]


def test_category(spark):
    df = spark.createDataFrame([("Hair serum with rum",), ("Serum",), (None,)], "t string")
    c = lambda whole: [r.c.category for r in df.select(extraction.category(F.col("t"), whole).alias("c")).collect()]
    assert c(True) == ["cosmetic", "cosmetic", "other"]


@pytest.mark.parametrize("tp,fp,fn,out", [(8, 2, 4, (0.8, 0.6667, 0.7273)), (0, 0, 0, (0.0, 0.0, 0.0))])
def test_scores(spark, tp, fp, fn, out):
    r = spark.range(1).select(*metrics.scores(F.lit(tp), F.lit(fp), F.lit(fn))).first()
    assert tuple(r) == out


def test_field_match(spark):
    df = spark.createDataFrame([("present", 1.0, None, None), ("45 ml", 45.0, "ML", None), ("45 ml", 45.0, "g", None), ("12.5", 12.505, None, None), ("abc", None, None, "xABCx"), ("present", None, None, None)], "e string, n double, u string, t string")
    assert [r.m for r in df.select(metrics.field_match(F.col("e"), F.col("n"), F.col("u"), F.col("t")).alias("m")).collect()] == [True, True, False, True, True, False]


def test_streams_agree_with_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, day(1), "a"), (2, day(1), "a"), (3, day(2), "b"), (3, day(2), "b")], "id int, ts timestamp, kind string")
    df.write.parquet(str(tmp_path / "in" / "events.parquet"))
    src = streaming.stream(spark, str(tmp_path / "in" / "events.parquet"), "", df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    n = streaming.drained(streaming.windowed(src, "ts", "kind"), "w", str(tmp_path / "c1"), "complete")
    assert sorted((r.kind, r.n) for r in n.collect()) == sorted((r.kind, r.n) for r in streaming.windowed(df, "ts", "kind").collect())
    assert streaming.drained(streaming.first_seen(src, "ts", ["id"]), "f", str(tmp_path / "c2")).count() == 3
    assert streaming.sessions(df, "ts", "kind").count() == 2
