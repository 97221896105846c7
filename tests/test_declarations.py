"""Reading of pages: values, passes, tables and packs; scores of recorded dumps."""

import json

import pytest

from labelloom.functions import geometry
from labelloom.operators import declarations as D
from labelloom.operators import extraction, layout
from labelloom.plans import recorded


def page(*rows, as_of=(2026, 9)):
    """rows: text, or (text, x, y) with boxes of 8 a letter and 20 high."""
    at = [(r, 10.0, 10.0 + 30 * i) if isinstance(r, str) else r for i, r in enumerate(rows)]
    t, x, y = map(list, zip(*at))
    lines = D.page_lines(t, x, y, [8.0 * len(a) for a in t], [20.0] * len(t), [1.0] * len(t), [False] * len(t))
    return {k: (v["num"] if v["num"] is not None else v["text"], v["unit"], v["how"]) for k, v in D.Page(lines, as_of).read().items()}


@pytest.mark.parametrize("text,field,value,unit", [
    ("MRP: Rs. 1,699.00", "retail_sale_price", 1699.0, None), ("M.R.P. ₹1495.00 (incl. of all taxes)", "retail_sale_price", 1495.0, None), ("MRP 7 10/-", "retail_sale_price", 10.0, None), ("अधिकतम खुदरा मूल्य: ₹ 45.00", "retail_sale_price", 45.0, None),
    ("USP Rs.0.052/g", "unit_sale_price", 0.052, "g"), ("Unit Sale Price: ₹ 2.60 per ml", "unit_sale_price", 2.6, "ml"), ("Net Qty: 3 x 500 g", "net_quantity", 1500.0, "g"), ("Net wt 1.250 kg", "net_quantity", 1.25, "kg"), ("Net Qty: approx 200 g", "net_quantity", 200.0, "g"), ("NET QUANTITY 1 PIECE", "net_quantity", 1.0, "N"),
    ("शुद्ध मात्रा: 500 ग्राम", "net_quantity", 500.0, "g"), ("PKD 03/2026", "manufacture_date", "03/2026", None), ("Mfg:10MAY26", "manufacture_date", "05/2026", None), ("Country of Origin: People's Republic of China", "country_of_origin", "People's Republic of China", None), ("Made in India", "country_of_origin", "India", None),
    ("Net Wt. 7 oz", "net_quantity", 7.0, "oz"), ("Generic Name: Oat Biscuits", "common_name", "Oat Biscuits", None),
])
def test_labelled_values(text, field, value, unit):
    assert page(text)[field][:2] == (value, unit)


@pytest.mark.parametrize("text", ["complete skin care for dry winter days", "hand made in small batches", "Serving size 30 g", "Rs. 2.60 per g only", "MRP see base of can", "Special offer Rs. 99"])
def test_no_wrong_values(text):
    assert not {"retail_sale_price", "net_quantity", "consumer_care", "country_of_origin"} & set(page(text))


def test_values_off_their_label():
    assert page(("NET QUANTITY:", 10.0, 10.0), ("6 g", 200.0, 12.0))["net_quantity"] == (6.0, "g", "labelled")
    assert page(("NET QUANTITY:", 10.0, 50.0), ("35 g", 200.0, 35.0))["net_quantity"] == (35.0, "g", "beside label")
    got = page(("MRP / USP (incl. of all taxes)", 10.0, 50.0), ("65.00", 300.0, 40.0), ("0.93/g", 300.0, 62.0))
    assert got["retail_sale_price"][0] == 65.0 and got["unit_sale_price"][0] == 0.93
    row = [("BATCH NO", 10.0, 10.0), ("PKD ON", 120.0, 10.0), ("USE BY", 220.0, 10.0), ("MRP", 320.0, 10.0), ("NOV/2024", 120.0, 34.0), ("OCT/2026", 220.0, 34.0), ("260.00", 320.0, 34.0)]
    assert page(*row)["manufacture_date"][0] == "11/2024" and page(*row)["retail_sale_price"][0] == 260.0


def test_blocks_are_read_whole():
    address = ["Plot 12, Long Industrial Estate Road " + "very " * 90 + "far", "Lamarford - 600001"]
    got = page("Manufactured by: Zubamav Foods Pvt Ltd", *address, "MRP Rs. 10.00")
    assert got["manufacturer_details"][0] == f"Zubamav Foods Pvt Ltd, {address[0]}, {address[1]}" and len(got["manufacturer_details"][0]) > 500
    assert page("For feedback contact Consumer Care Cell:", "help@zuba.example", "1800-103-1644")["consumer_care"][0].endswith("1800-103-1644")


def test_later_passes():
    assert page("TNET QUANIITY: 50 g")["net_quantity"][2] == "damaged label"
    assert page("03/2026 (B4)", "03/2029", "For MFD and use before see above")["manufacture_date"] == ("03/2026", None, "date pair")
    assert page("Call 1800 266 8110")["consumer_care"][2] == "contact only"
    got = page("PKD 03/2026", "Best before 9 months from packing")
    assert got["expiry_date"] == ("12/2026", None, "months after making")
    assert page("MRP Rs. 10.00", "USP 20.83 per g")["unit_sale_price"][0] == 0.83
    assert "manufacture_date" not in page("PKD 03/2036")


@pytest.mark.parametrize("text,want", [("3 May 2024 and 04/05/26, 10MAY26", [(2024, 5, 3), (2026, 5, 4), (2026, 5, 10)]), ("MAR/26-NOV/26-D", [(2026, 3, None), (2026, 11, None)]), ("0CT 2025", [(2025, 10, None)]), ("9.1 g Rs.10.00", []), ("03/2026 03/2026", [(2026, 3, None)]), (None, [])])
def test_dates(text, want):
    assert [x[:3] for x in D.dates_in(text)] == want


def test_pages_and_packs(spark):
    rows = [(1, "s", 0, "MRP Rs. 10.00", 10.0, 10.0, 0.9), (2, "s", 1, "MRP Rs. 12.00", 10.0, 10.0, 0.8), (3, "s", 1, None, None, None, None), (4, "s", None, "Net Qty: 5 g", 10.0, 40.0, 0.9), (5, None, 0, "MRP Rs. 3.00", 1.0, 1.0, 1.0)]
    s = spark.createDataFrame([(i, a, b, t, x, y, 100.0, 20.0, c, None) for i, a, b, t, x, y, c in rows], "span_id long, scan_id string, photo int, text string, x double, y double, w double, h double, confidence double, angle double")
    pages = D.declarations(s, "2026-09-01")
    assert pages.count() == 3 * len(D.FIELDS)
    got = {(r.scan_id, r.field_id): (r.value_num, r.photo) for r in D.of_packs(pages).where("present").collect()}
    assert got == {("s", "retail_sale_price"): (10.0, 0), ("s", "net_quantity"): (5.0, 0), (None, "retail_sale_price"): (3.0, 0)}
    assert D.declarations(s.limit(0), "2026-09-01").count() == 0


def test_recorded_dumps(spark, tmp_path):
    def dump(name, *texts):
        regions = [{"text": t, "score": 0.95, "poly": [[10, y], [400, y], [400, y + 20], [10, y + 20]], "engine": "x", "language": "en"} for y, t in zip(range(10, 500, 30), texts)]
        (tmp_path / f"{name}.paddle.json").write_text(json.dumps({"source": name, "regions": regions}))

    dump("photo1", "MRP: Rs. 18.00", "Net Qty: 45 ml")
    dump("photo1.sharp", "MRP: Rs. 13.00")
    (tmp_path / "ground_truth.yaml").write_text("as_of: 2026-09-28\nphoto1:\n  fields:\n    retail_sale_price: 18.00\n    net_quantity: \"45 ml\"\n    common_name: not_legible\nphoto2:\n  fields:\n    net_quantity: present\n")
    as_of, key, _ = recorded.answer_key(spark, str(tmp_path))
    read = recorded.read_dumps(spark, str(tmp_path), as_of)
    t = {(r.variant, r.field_id): (r.correct, r.wrong, r.missed) for r in recorded.totals(recorded.field_scores(read, key)).collect()}
    assert t["default", None] == (2, 0, 0) and t["sharp", None] == (0, 1, 1) and t[None, None] == (2, 1, 1)
    assert [r.photo_name for r in recorded.without_dump(read, key).collect()] == ["photo2"]


def test_prices_under_stickers(spark):
    prices = spark.createDataFrame([("s", 10.0, (10.0, 10.0, 20.0, 10.0)), ("s", 25.0, (200.0, 10.0, 20.0, 10.0)), ("t", 5.0, (0.0, 0.0, 5.0, 5.0))], "scan_id string, price double, box struct<x:double,y:double,w:double,h:double>")
    over = spark.createDataFrame([("s", (195.0, 5.0, 40.0, 30.0))], "scan_id string, overlay struct<x:double,y:double,w:double,h:double>")
    assert {r.scan_id: (r.printed, r.sticker) for r in layout.split_prices(prices, over).collect()} == {"s": (10.0, 25.0), "t": (5.0, None)}


def test_sideways_lines_and_scales(spark):
    s = spark.createDataFrame([(i, "s", 0, "text", 30.0 * i, 10.0, 20.0, 200.0, True, None, None) for i in range(4)], "span_id long, scan_id string, photo int, text string, x double, y double, w double, h double, vertical boolean, confidence double, angle double")
    got = {}
    for r in layout.beside_vertical(s, 2).collect():
        got.setdefault(r.span_id, []).append(r.beside_id)
    assert got[0] == [1, 2] and sorted(got[1]) == [0, 2]
    from pyspark.sql import functions as F

    k = spark.range(1).select(geometry.agreed_scale(F.array(F.lit(10.0), F.lit(11.0))).alias("a"), geometry.agreed_scale(F.array(F.lit(10.0), F.lit(14.0))).alias("b")).first()
    assert k.a == 10.5 and k.b is None
    assert extraction.listing_frame(spark, [(1, "t", None)]).first().seller is None
