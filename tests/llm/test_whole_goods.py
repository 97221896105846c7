"""Rare commodities, and those no line names, link whatever the commonest one counts."""

from labelloom.llm import listings, names


def test_a_rare_commodity_is_kept(spark):
    rows = [(i, "Zuba Soap 100 g (Hot Deal)", "Brand: Zuba\nVariant: Rose") for i in range(300)] + [(1000 + i, "Zuba Pine Oil 100 g", "Brand: Zuba") for i in range(2)]
    df = spark.createDataFrame([(i, a, b, None, None) for i, a, b in rows], "listing_id long, title string, text string, seller string, ingested_at timestamp")
    g = {r.listing_id: r.product_id for r in listings.product_groups(df).collect()}
    assert g[1000] == g[1001] != g[0] and len({g[i] for i in range(300)}) == 1


def test_commodities_no_line_names(spark):
    rows = [(1, "Zuba Quinoapuffs 100 g", None), (2, "Quinoapuffs - 0.1 kg", "Brand: Zuba"), (3, "Zuba Quinoapuffs 200 g", None), (4, "Zuba Quinoabars 100 g", None), (5, "Vodo Quinoapuffs 100 g", None), (6, "Zuba 100 g", None), (7, "Zuba 100 g", None)]
    rows += [(10 + i, f"Keso Soap {i} kg", "Variant: Rose\nGoes well with our Rose Soap.") for i in range(5)]
    df = spark.createDataFrame([(i, a, b, None, None) for i, a, b in rows], "listing_id long, title string, text string, seller string, ingested_at timestamp")
    got = {tuple(r) for r in names.same_pairs(listings.product_groups(df), "listing_id", ["product_id"]).collect()}
    assert got == {(1, 2)}
