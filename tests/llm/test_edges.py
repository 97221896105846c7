"""Every operator on empty tables, null rows, repeated rows, very long texts and clashing columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from labelloom.llm import leaks, listings, lookalikes, names, packing, scanned, spans

AT = datetime.datetime(2024, 1, 1)
CLASH = "w string, v int, n int, c int, th int, l int, r int, scope string, root int, brand_id int, size int, salt int, rn int, zone string, _v int, _at int, node int, label int"
EXTRA = (None,) * 18

DOCS = f"doc_id long, text string, {CLASH}"
ITEMS = f"item_id long, text string, {CLASH}"
SPANS = f"span_id long, scan_id string, photo int, text string, x double, y double, {CLASH.replace('w string', 'w double')}, h double, lang string, ingested_at timestamp"
SCANS = f"scan_id string, category string, {CLASH}"
KEYS = f"key_id long, brand string, common_name string, {CLASH}"
LISTINGS = f"listing_id long, title string, text string, seller string, ingested_at timestamp, {CLASH}"
LONG = "word " * 250_000


def span(i, scan, photo, text, y):
    return (i, scan, photo, text, 40.0, y, 400.0) + EXTRA[1:] + (20.0, "en", AT)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs(spark, *rows):
    return frame(spark, [r + EXTRA for r in rows], DOCS)


def test_documents(spark):
    long_ = (7, LONG + "x" * 100_000)
    rows = [(1, None), (2, ""), (3, "short"), (None, "short"), (None, "a b " * 200), (4, "a b " * 200), (4, "a b " * 200), long_]
    items = frame(spark, [(1, "one two") + EXTRA, (2, None) + EXTRA, (None, "x") + EXTRA, (3, " ".join(f"word{i}" for i in range(30))) + EXTRA], ITEMS)
    for d in (docs(spark, *rows), docs(spark)):
        assert spans.shared_pairs(d).count() == 0
        assert leaks.leaked(d, items).count() == 0
        assert leaks.leaked(d, items.limit(0)).count() == 0
    packed = packing.pack(packing.token_counts(docs(spark, *rows))).collect()
    assert {r.doc_id for r in packed if r.container is None} == {1, 2}
    assert sum(r.n_tokens for r in packed if r.doc_id == 7) > 250_000 and sum(r.doc_id == 4 for r in packed) == 1
    assert packing.pack(packing.token_counts(docs(spark))).count() == 0


def test_passage_in_a_very_long_text(spark):
    passage = " ".join(f"seldom{i}" for i in range(40))
    d = docs(spark, (1, LONG + passage + " " + LONG), (2, "start " + passage + " end"))
    items = frame(spark, [(9, passage) + EXTRA], ITEMS)
    assert sorted((r.doc_id, r.item_id, r.run_words) for r in leaks.leaked(d, items).collect()) == [(1, 9, 40), (2, 9, 40)]
    shared = " ".join(f"{i * i}" for i in range(200))
    d = docs(spark, (1, LONG + shared + LONG[::-1]), (2, shared))
    assert [tuple(r) for r in spans.shared_pairs(d).collect()] == [(1, 2)]


def test_spans_of_text(spark):
    scans = frame(spark, [("b", "booklet") + EXTRA, ("b", "booklet") + EXTRA, (None, "booklet") + EXTRA, ("f", "food") + EXTRA], SCANS)
    rows = [span(1, "b", None, None, None), span(2, "b", 0, "", 10.0), span(3, "b", 0, "word " * 20_000, 30.0), span(3, "b", 0, "word " * 20_000, 30.0), span(None, "b", 0, "x", 50.0), span(4, "f", 0, "pl4te", 0.0), span(5, None, 0, "a​b", 0.0)]
    s = frame(spark, rows, SPANS)
    assert sorted(r.span_id for r in lookalikes.suspects(s).collect()) == [5]
    assert lookalikes.canonical_spans(s).count() == 5
    assert scanned.line_defects(s, scans).count() <= 1 and scanned.paragraphs(s, scans).count() <= 1
    for none in (s.limit(0),):
        assert lookalikes.suspects(none).count() == 0 and scanned.line_defects(none, scans).count() == 0


def test_names(spark):
    k = [(1, None, "x"), (2, "Acme", None), (3, "...", "..."), (4, "Zatebeke Foods", "Soap"), (4, "Zatebeke Foods", "Soap"), (5, "ZATEBEKE", "soap"), (None, "Zatebeke", "Soap"), (6, "y" * 50_000, "z" * 50_000)]
    df = frame(spark, [r + EXTRA for r in k], KEYS)
    ids = names.linked_names(df)
    assert [tuple(r) for r in names.same_pairs(ids, "key_id", ["brand_id", "goods_id"]).collect()] == [(4, 5)]
    assert names.linked_names(df.limit(0)).count() == 0


def test_listings(spark):
    def row(i, title, text):
        return (i, title, text, None, AT) + EXTRA

    df = frame(spark, [row(1, None, None), row(2, "", ""), row(3, "x" * 200_000, "y\n" * 50_000), row(None, "t", "t"), row(4, "Zuba Soap 100 g", "Brand: Zuba\nVariant: Rose\nGoes well with our Rose Soap."), row(4, "Zuba Soap 100 g", "Brand: Zuba\nVariant: Rose\nGoes well with our Rose Soap."), row(5, "Rose Soap 0.1 kg", "Make - Zuba")], LISTINGS)
    g = listings.product_groups(df)
    assert [tuple(r) for r in names.same_pairs(g, "listing_id", ["product_id"]).collect()] == [(4, 5)]
    assert listings.product_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_report_columns(spark, n):
    items = frame(spark, [(1, " ".join(f"w{i}" for i in range(30))) + EXTRA], ITEMS)
    r = leaks.leaked(docs(spark, (1, "x")).limit(n), items, report=True)
    assert r.columns == ["doc_id", "item_id", "run_words", "lcs_share", "answers_found"] and r.agg(F.count("*")).first()[0] == 0
