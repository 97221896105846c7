import json

from labelloom.operators import nested

SCHEMA = "scan_id string, payload string, ingested_at timestamp, child string, record string"


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r)[:2] + (r.parent_pos, r.pos) for r in nested.flatten_payloads(df).collect())


def doc(**kw):
    return json.dumps(kw)


def row(scan, payload, at="2024-01-01"):
    import datetime

    return (scan, payload, datetime.datetime.fromisoformat(at) if at else None, "x", "y")


def test_children_and_parents(spark):
    p = doc(declarations=[{"field_id": "a", "glyph": {"n": 1}, "notes": ["x", None, "y"]}, None, {"notes": "bare", "glyph": None}], ocr_stats={"photos": [{"passes": {"engine": "e"}}, {"passes": [None, {"engine": "f"}]}]}, spans=None, package_photos="one.jpg")
    assert found(spark, [row("s", p)]) == sorted(
        [("s", "declaration", -1, 0), ("s", "declaration", -1, 2), ("s", "glyph", 0, 0), ("s", "note", 0, 0), ("s", "note", 0, 2), ("s", "note", 2, 0), ("s", "ocr_photo", -1, 0), ("s", "ocr_photo", -1, 1), ("s", "ocr_pass", 0, 0), ("s", "ocr_pass", 1, 1), ("s", "package_photo", -1, 0)]
    )


def test_last_version_counts_even_if_broken(spark):
    good = doc(findings=[{}])
    assert found(spark, [row("s", good), row("s", good[:-2], "2024-02-01")]) == []
    assert found(spark, [row("s", good[:-2]), row("s", good, "2024-02-01"), row("s", good, "2024-02-01")]) == [("s", "finding", -1, 0)]


def test_odd_payloads_and_nulls(spark):
    rows = [row("a", None), row("b", ""), row("c", "null"), row("d", "[1]"), row("e", json.dumps(doc(spans=[{}]))), row(None, doc(spans=[{}])), row("f", doc(spans=[{}]), None), row("g", "[" * 100000)]
    assert found(spark, rows) == [("e", "span", -1, 0), ("f", "span", -1, 0)]
    assert found(spark, []) == []


def test_typed_table(spark):
    df = spark.createDataFrame([row("s", doc(declarations=[{"field_id": "q", "value": [1, "g"], "bbox": {"x": 1}}]))], SCHEMA)
    r = nested.typed_table(nested.flatten_payloads(df), "declaration").first()
    assert (r.field_id, json.loads(r.value), r.bbox.x, r.bbox.y) == ("q", [1, "g"], 1.0, None)


def test_written_by_tag(spark, tmp_path):
    df = spark.createDataFrame([row("s", doc(spans=[{"text": "t"}], findings=[{}]))], SCHEMA)
    nested.write_tagged(nested.flatten_payloads(df), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "child=span")).count() == 1
