"""Several views of one item, and one item across the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import base_quantity, gtin_valid, name_key


def stacked(spans: DataFrame, gap: float = 80.0) -> DataFrame:
    """(span_id, photo, y, y_stacked): photos of a scan laid below each other with a gap.

    Heights are one row a photo before the running sum, so a scan of many pages is small.
    """
    s = spans.where("span_id is not null").select("scan_id", F.coalesce("photo", F.lit(0)).alias("photo"), "span_id", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("h", F.lit(0.0)).alias("h"))
    height = s.groupBy("scan_id", "photo").agg(F.max(F.col("y") + F.col("h")).alias("ph"))
    above = Window.partitionBy("scan_id").orderBy("photo").rowsBetween(Window.unboundedPreceding, -1)
    height = height.withColumn("offset", F.coalesce(F.sum(F.col("ph") + gap).over(above), F.lit(0.0)))
    return s.join(height.select("scan_id", "photo", "offset"), ["scan_id", "photo"]).select("span_id", "photo", "y", (F.col("y") + F.col("offset")).alias("y_stacked"))


def best_readings(rows: DataFrame, keys: list[str], value: str, confidence: str, order: list[str], doubtful=None) -> DataFrame:
    """The best row per key: not doubtful, with a value, the surest; the first in ``order`` of equals.

    A partial aggregate of the least rank, so a key with very many rows is no hot task.
    """
    rank = F.struct(F.coalesce(doubtful if doubtful is not None else F.lit(False), F.lit(False)).alias("a"), F.col(value).isNull().alias("b"), (-F.coalesce(confidence, F.lit(-1.0))).alias("c"), *order)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_m"))
    return best.select(*keys, *(F.col("_m")[c].alias(c) for c in rest))


def identity_conflicts(keys: DataFrame) -> DataFrame:
    """(scan_id, n_barcodes, q_min, q_max, conflict): views of one scan that cannot be one item.

    More than one barcode, or contents in one dimension that differ by more than 1 %.
    """
    q = base_quantity(F.col("net_quantity"), F.lower("unit"))
    rows = keys.where("scan_id is not null").withColumn("q", F.when(~F.isnan("net_quantity"), q)).withColumn("dim", F.when(F.lower("unit").isin("kg", "g"), "mass").otherwise("volume"))
    per = rows.groupBy("scan_id", "dim").agg(F.min("q").alias("q0"), F.max("q").alias("q1"))
    per = per.groupBy("scan_id").agg(F.min("q0").alias("q_min"), F.max("q1").alias("q_max"), F.bool_or(F.col("q1") - F.col("q0") > 0.01 * F.col("q1")).alias("differs"))
    codes = rows.groupBy("scan_id").agg(F.countDistinct("barcode").alias("n_barcodes"))
    return codes.join(per, "scan_id").select("scan_id", "n_barcodes", "q_min", "q_max", ((F.col("n_barcodes") > 1) | F.coalesce("differs", F.lit(False))).alias("conflict"))


def product_identity(keys: DataFrame) -> DataFrame:
    """(key_id, kind, identity): by barcode, else by brand, name, rounded content and unit; else dropped."""
    q = F.when(F.isnan("net_quantity"), None).otherwise(F.round("net_quantity", 3))
    brand, name = name_key(F.col("brand")), name_key(F.col("common_name"))
    attrs = F.concat_ws("|", brand, name, q.cast("decimal(18,3)").cast("string"), F.lower(F.trim("unit")))
    code = F.nullif(F.trim("barcode"), F.lit(""))
    kind = F.when(code.isNotNull(), "gtin").when((brand != "") & (name != "") & q.isNotNull(), "attrs")
    return keys.select("key_id", kind.alias("kind"), F.when(code.isNotNull(), code).otherwise(attrs).alias("identity")).where("kind is not null")


def differing_values(rows: DataFrame, keys: list[str], value: str, ident: str) -> DataFrame:
    """(keys, n_values, lo, hi, n_rows): groups of one identity with more than one value at 2 decimals.

    Counted per (identity, value) first, so a hot identity is pre-aggregated before it meets.
    """
    v = F.floor(F.col(value) * 100 + 0.5) / 100
    per = rows.where(F.col(value).isNotNull()).withColumn("_v", v).groupBy(*keys, "_v").agg(F.count(ident).alias("k"))
    out = per.groupBy(*keys).agg(F.count("*").alias("n_values"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("k").alias("n_rows"))
    return out.where("n_values > 1")


def valid_codes(keys: DataFrame) -> DataFrame:
    """(key_id, barcode, valid) of rows with a barcode."""
    return keys.where("barcode is not null").select("key_id", "barcode", gtin_valid(F.col("barcode")).alias("valid"))


def product_label(identity: DataFrame, keys: DataFrame) -> DataFrame:
    """(identity, label): what people call a product: brand, name, content and unit of its least typed form."""
    q = F.when(F.isnan("net_quantity"), None).otherwise(F.floor(F.col("net_quantity") * 1000 + 0.5).cast("long"))
    words = F.concat_ws(" ", "brand", "common_name", q.cast("string"), F.lower(F.trim("unit")))
    return identity.join(keys, "key_id").groupBy("identity").agg(F.min(words).alias("label"))


def price_findings(rows: DataFrame, keys: list[str], value: str, ident: str, sure) -> DataFrame:
    """(keys, prices, n_rows, confidence): products with more than one price, as 'price x rows' in order.

    Prices at two decimals are counted per product first; 0.9 where the identity is sure, else 0.55.
    """
    v = F.floor(F.col(value) * 100 + 0.5).cast("long")
    per = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, v.alias("cents")).agg(F.countDistinct(ident).alias("k"))
    out = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cents", "k"))).alias("p"), F.sum("k").alias("n_rows")).where(F.size("p") > 1)
    listed = F.array_join(F.transform("p", lambda x: F.concat(x["cents"].cast("string"), F.lit(" x "), x["k"].cast("string"))), ", ")
    return out.select(*keys, listed.alias("prices"), "n_rows", F.when(sure, 0.9).otherwise(0.55).alias("confidence"))


def fullest_photo(rows: DataFrame, keys: list[str], photo: str, present) -> DataFrame:
    """(keys, photo, n_present): the photo with most present fields, the first of equals; a pack's context comes from it."""
    n = rows.groupBy(*keys, photo).agg(F.count_if(present).alias("n_present"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n_present")).alias("m"), photo)).alias("b"))
    return best.select(*keys, F.col("b")[photo].alias(photo), (-F.col("b.m")).alias("n_present"))
