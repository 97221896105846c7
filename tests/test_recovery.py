from pyspark.sql import functions as F

from labelloom.operators import extraction, recovery, synthetic


def test_second_reader_fills_what_is_missing(spark):
    found = spark.createDataFrame([("a", "f", "x", 0.9), ("b", "f", None, 0.9)], "id string, field string, value string, confidence double")
    second = spark.createDataFrame([("a", "f", "y"), ("b", "f", "Net Wt"), ("c", "f", "zz"), ("d", "f", None)], "id string, field string, value string")
    seen = spark.createDataFrame([("b", "... NET-WT 5 g"), ("c", None)], "id string, text string")
    r = {x.id: (x.value, x.confidence, x.source) for x in recovery.completed(found, second, ["id", "field"], seen).collect()}
    assert r == {"a": ("x", 0.9, "first"), "b": ("Net Wt", 0.7, "second+first"), "c": ("zz", 0.45, "second")}
    assert recovery.completed(found.limit(0), second.limit(0), ["id", "field"]).count() == 0


def test_blocks_and_labels(spark):
    df = spark.createDataFrame([(["Mfd by:", " Label Works ", "", "Plot 7,", "Lamarford"],), ([],), (None,)], "l array<string>")
    assert [r.t for r in df.select(recovery.joined_block(F.col("l")).alias("t")).collect()] == ["Mfd by: Label Works, Plot 7, Lamarford", "", None]
    t = spark.createDataFrame([("M.R.P.:",), ("Net Qty 5 g",), ("PKD DATE",), (None,)], "t string")
    assert [r.b for r in t.select(recovery.is_bare_label(F.col("t")).alias("b")).collect()] == [True, False, True, None]


def test_panels(spark):
    spans = spark.createDataFrame([("s", 1, 10.0, 10.0, 5.0, 5.0), ("s", 2, 20.0, 10.0, 5.0, 5.0), ("s", 3, 90.0, 90.0, 5.0, 5.0)], "scan_id string, span_id long, x double, y double, w double, h double")
    panels = spark.createDataFrame([("s", 1, (0.0, 0.0, 50.0, 50.0), 1.0), ("s", 2, (80.0, 80.0, 20.0, 20.0), 1.0)], "scan_id string, panel_id int, box struct<x:double,y:double,w:double,h:double>, rectangularity double")
    r = recovery.best_panels(panels, spans, F.lit(100.0), F.lit(100.0)).collect()
    assert [(x.panel_id, round(x.coverage, 3)) for x in r] == [(1, 0.667)]


def test_dates_and_offset_values(spark):
    df = spark.createDataFrame([("On 3 May 2024 and 1 March 2023, again 3 May 2024, not 31 February 2024",), ("",)], "t string")
    r = df.select(recovery.date_pair(extraction.date_tokens(F.col("t"))).alias("p")).collect()
    assert (r[0].p.first, r[0].p.last) == ("2023-03-01", "2024-05-03") and r[1].p is None
    lines = spark.createDataFrame([("s", 1, "Net Quantity:", 0.0, 0.0, 90.0, 10.0), ("s", 2, "200 g", 100.0, 12.0, 30.0, 10.0), ("s", 3, "5 g", 100.0, 30.0, 30.0, 10.0)], "scan_id string, line_id int, text string, x double, y double, w double, h double")
    assert [tuple(x) for x in recovery.nearest_below_label(lines, "net quantity", r"^[0-9]+ g$", ["scan_id"]).collect()] == [("s", 1, 2)]


def test_gaps_above_and_below(spark):
    s = spark.createDataFrame([("s", 0, 1, "a", 0.0, 0.0, 50.0, 10.0, None, None), ("s", 0, 2, "b", 40.0, 30.0, 500.0, 10.0, None, None), ("s", 0, 3, "c", 600.0, 15.0, 5.0, 5.0, None, None)], "scan_id string, photo int, span_id long, text string, x double, y double, w double, h double, confidence double, angle double")
    assert {r.span_id: (r.gap_top, r.gap_bottom) for r in recovery.vertical_gaps(s).collect()} == {1: (None, 20.0), 2: (20.0, None), 3: (None, None)}


def test_synthetic_labels_are_deterministic_and_readable(spark):
    a = synthetic.specifications(spark, 60, seed=4)
    assert a.collect() == synthetic.specifications(spark.newSession(), 60, seed=4).repartition(3).orderBy("label_id").collect()
    assert a.where("fault is not null").count() > 5
    lines = synthetic.manifests(a)
    fields = extraction.pivoted(extraction.first_fields(lines, ["label_id"], ["line_no"], "text"), ["label_id"])
    r = a.join(fields, "label_id").where("fault is null").collect()
    assert r and all(x.retail_sale_price == x.price and x.net_quantity == x.quantity and x.net_quantity_unit == x.unit for x in r)
    missing = a.join(fields, "label_id").where("fault = 'missing_price'").collect()
    assert all(x.retail_sale_price is None for x in missing)
