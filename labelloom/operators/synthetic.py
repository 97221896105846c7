"""Deterministic synthetic labels: specifications, injected faults and line manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of faults that can be put into a label.
FAULTS = ["missing_price", "missing_quantity", "non_si_unit", "future_date", "missing_contact", "bare_country_address", "damaged_label"]
GOODS = ["tea", "rice flour", "hair oil", "glass cleaner", "soap", "oat biscuits", "mango drink", "shampoo"]
UNITS = ["g", "kg", "ml", "l"]


def _pick(values: list, key: Column, salt: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def specifications(spark: SparkSession, n: int, seed: int = 1, fault_every: int = 3) -> DataFrame:
    """(label_id, goods, quantity, unit, price, month, year, fault): the same for the same seed at any parallelism."""
    key = F.xxhash64("id", F.lit(seed))
    s = spark.range(n).select(F.col("id").alias("label_id"), key.alias("k"))
    fault = F.when(F.pmod("k", F.lit(fault_every)) == 0, _pick(FAULTS, F.col("k"), "fault"))
    return s.select(
        "label_id", _pick(GOODS, F.col("k"), "goods").alias("goods"), (F.pmod(F.xxhash64("k", F.lit("q")), F.lit(40)) * 25 + 25).cast("int").alias("quantity"), _pick(UNITS, F.col("k"), "unit").alias("unit"),
        (F.pmod(F.xxhash64("k", F.lit("p")), F.lit(2000)) / 2 + 10).cast("double").alias("price"), (F.pmod(F.xxhash64("k", F.lit("m")), F.lit(12)) + 1).cast("int").alias("month"), F.lit(2025).alias("year"), fault.alias("fault"),
    )


def manifests(specs: DataFrame) -> DataFrame:
    """(label_id, line_no, field_id, text, x, y, w, h): the lines of each label with its fault applied."""
    f = F.coalesce("fault", F.lit(""))
    price = F.when(f != "missing_price", F.concat(F.when(f == "damaged_label", "MBP Rs. ").otherwise("MRP Rs. "), F.format_string("%.2f", "price")))
    unit = F.when(f == "non_si_unit", "oz").otherwise(F.col("unit"))
    quantity = F.when(f != "missing_quantity", F.concat(F.lit("Net Qty: "), F.col("quantity").cast("string"), F.lit(" "), unit))
    made = F.concat(F.lit("PKD "), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("/"), F.when(f == "future_date", F.col("year") + 20).otherwise(F.col("year")).cast("string"))
    contact = F.when(f != "missing_contact", F.lit("Care: help@label.example"))
    address = F.when(f == "bare_country_address", F.lit("Mfd by Label Works, India")).otherwise(F.concat(F.lit("Mfd by Label Works, Plot "), (F.col("label_id") % 300).cast("string"), F.lit(", Lamarford")))
    lines = {"common_name": F.initcap("goods"), "net_quantity": quantity, "retail_sale_price": price, "manufacture_date": made, "manufacturer_details": address, "consumer_care": contact}
    rows = specs.select("label_id", F.posexplode(F.array(*(F.struct(F.lit(k).alias("field_id"), v.alias("text")) for k, v in lines.items()))).alias("line_no", "l")).where("l.text is not null")
    return rows.select("label_id", "line_no", "l.field_id", "l.text", F.lit(10.0).alias("x"), (10.0 + 24.0 * F.col("line_no")).alias("y"), (8.0 * F.length("l.text")).alias("w"), F.lit(16.0).alias("h"))
