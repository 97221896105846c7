from labelloom.operators import layout, packages

S = "scan_id string, photo int, span_id long, text string, x double, y double, w double, h double, confidence double, angle double, rank int"


def spans(spark, *rows):
    return spark.createDataFrame([("s", 0, i, t, x, y, w, 20.0, c, a, 9) for i, (t, x, y, w, c, a) in enumerate(rows)], S)


def test_rows_are_read_left_to_right(spark):
    df = spans(spark, ("b", 50.0, 11.0, 20.0, 0.9, 0.0), ("a", 0.0, 14.0, 20.0, 0.9, 0.0), ("c", 0.0, 50.0, 20.0, None, None), (None, 30.0, 50.0, 20.0, 0.1, 0.0))
    assert [r.span_id for r in layout.reading_order(df).orderBy("pos").collect()] == [1, 0, 2, 3]


def test_label_takes_its_value(spark):
    df = spans(spark, ("NET QUANTITY:", 0.0, 0.0, 100.0, 0.9, 0.0), ("6 g", 300.0, 2.0, 30.0, 0.9, 0.0), ("other", 0.0, 60.0, 50.0, 0.9, 0.0), ("column", 300.0, 60.0, 50.0, 0.9, 0.0))
    lines = layout.line_boxes(df, layout.line_groups(df)).orderBy("line_no").collect()
    assert [r.text for r in lines] == ["NET QUANTITY: 6 g", "other", "column"]


def test_neighbours(spark):
    df = spans(spark, ("a", 0.0, 0.0, 50.0, 0.9, 0.0), ("b", 60.0, 4.0, 50.0, 0.9, 0.0), ("c", 0.0, 25.0, 50.0, 0.9, 0.0))
    assert [(r.span_id, r.neighbour_id, r.gap) for r in layout.right_neighbours(df).collect()] == [(0, 1, 10.0)]
    assert sorted((r.span_id, r.below_id) for r in layout.below_neighbours(df).collect()) == [(0, 2)]
    assert {r.span_id: (r.gap_left, r.gap_right) for r in layout.side_gaps(df).collect()} == {0: (None, 10.0), 1: (10.0, None), 2: (None, None)}


def test_suppression_keeps_the_surest(spark):
    df = spans(spark, ("a", 0.0, 0.0, 50.0, 0.5, 0.0), ("b", 2.0, 0.0, 50.0, 0.9, 0.0), ("c", 200.0, 0.0, 50.0, None, 0.0))
    assert sorted(r.span_id for r in layout.overlap_suppressed(df).collect()) == [1, 2]


def test_empty_and_null_boxes(spark):
    none = spark.createDataFrame([], S)
    for f in (layout.reading_order, layout.line_groups, layout.right_neighbours, layout.below_neighbours, layout.side_gaps, layout.curved_pages, layout.page_orientation, layout.overlap_suppressed, packages.stacked):
        assert f(none).count() == 0
    odd = spark.createDataFrame([("s", None, 1, None, None, None, None, None, None, None, 0), ("s", None, 2, "x" * 100_000, None, None, None, None, None, None, 0)], S)
    assert layout.reading_order(odd).count() == 2 and layout.curved_pages(odd).count() == 0


def test_stacked_photos(spark):
    df = spark.createDataFrame([("s", 0, 1, 10.0, 20.0), ("s", 1, 2, 5.0, 5.0), ("s", 2, 3, 0.0, 1.0)], "scan_id string, photo int, span_id long, y double, h double")
    assert {r.span_id: r.y_stacked for r in packages.stacked(df).collect()} == {1: 10.0, 2: 115.0, 3: 200.0}


def test_best_reading(spark):
    df = spark.createDataFrame([("k", "a", 0.9, 2, False), ("k", "b", 0.9, 1, False), ("k", "c", 1.0, 0, True), ("k", None, 1.0, 0, False)], "k string, v string, c double, photo int, vlm boolean")
    r = packages.best_readings(df, ["k"], "v", "c", ["photo"], df.vlm).collect()
    assert [x.v for x in r] == ["b"]


def test_groups_stay_whole_above_a_join(spark):
    from pyspark.sql import functions as F

    from labelloom.operators.paged import by_group

    a = spark.range(20_000).select((F.col("id") % 500).alias("k"), "id")
    small = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("one"))
    joined = a.join(small.hint("merge"), "k")
    rows = by_group(joined, ["k"], ["id"], lambda g: [(g.column("k")[0].as_py(), g.num_rows, g.column("id").to_pylist() == sorted(g.column("id").to_pylist()))], "k long, n long, ok boolean").collect()
    assert len(rows) == 500 and all(r.n == 40 and r.ok for r in rows)
