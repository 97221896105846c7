"""Misspelt brands link by shares of rows: the same proportions give the same links at every size."""

import pytest

from labelloom.llm import names

GOODS = ["Mango Drink", "Rose Soap", "Glass Cleaner", "Instant Noodles"]
# brand, rows at size 1, first goods: two slips of Zatebeke, and two brands two edits apart with goods of their own
BRANDS = [("Zatebeke", 22, 0), ("Zatebkee", 3, 0), ("Zatebeka", 4, 0), ("Vijusiki", 12, 0), ("Sivusiki", 20, 2)]


@pytest.mark.parametrize("size", [1, 10])
def test_links_do_not_depend_on_size(spark, size):
    rows = [(b, GOODS[first + i % 2]) for b, n, first in BRANDS for i in range(n * size)]
    keys = spark.createDataFrame([(i, b, g) for i, (b, g) in enumerate(rows)], "key_id long, brand string, common_name string")
    ids = {r.key_id: r.brand_id for r in names.linked_names(keys).collect()}
    of = {b: {ids[i] for i, (x, _) in enumerate(rows) if x == b} for b, _, _ in BRANDS}
    assert of["Zatebeke"] == of["Zatebkee"] == of["Zatebeka"] and len(of["Zatebeke"]) == 1
    assert len(of["Vijusiki"] | of["Sivusiki"]) == 2
