"""Lines of text to typed fields, and text to synthetic boxes.

All patterns of all fields run in one pass over the lines; the first line in reading order wins
per field, found with a partial aggregate. Patterns keep to what Java's and RE2's regexes
read alike, so that the same text serves the SQL twin.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUM = r"([0-9]+(?:,[0-9]{2,3})*(?:[.][0-9]{1,3})?)"
#: field: (pattern on the lower-case line, group of the value)
FIELDS: dict[str, tuple[str, int]] = {
    "retail_sale_price": (rf"(?:m[.]?r[.]?p[.]?|max(?:imum)? retail price)[ :]*(?:rs[.]?|inr|₹)? *{NUM}", 1),
    "net_quantity": (rf"(?:net (?:qty|quantity|wt|weight|contents?)|contents?)[ .:-]*{NUM} ?(?:kg|g|gm|grams|ml|l|ltr|litre|millilitre|n)(?:[^a-z]|$)", 1),
    "net_quantity_unit": (rf"(?:net (?:qty|quantity|wt|weight|contents?)|contents?)[ .:-]*{NUM} ?(kg|g|gm|grams|ml|l|ltr|litre|millilitre|n)(?:[^a-z]|$)", 2),
    "unit_sale_price": (rf"(?:unit (?:sale )?price|usp)[ :]*(?:rs[.]?|₹)? *{NUM}", 1),
    "manufacture_date": (r"(?:mfg|mfd|pkd|packed on|date of (?:mfg|packing))[^0-9]{0,12}([0-9]{1,2}/[0-9]{4})", 1),
    "shelf_months": (r"best before ([0-9]{1,3}) months", 1),
    "manufacturer_details": (r"(?:mfd|mfg|manufactured|packed|marketed|imported)[.]? by[ :]*(.{6,})", 1),
    "consumer_care": (r"(?:consumer|customer) ?(?:care|service|support|helpline)[ :]+(.{6,})", 1),
    "country_of_origin": (r"(?:country of origin[ :]*|(?:^|[^a-z])made in )([a-z]{2,}(?: [a-z]+){0,4})", 1),
    "batch": (r"(?:batch|lot) no[.:]* *([a-z0-9/-]{3,20})", 1),
}


def lines_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): non-blank trimmed lines; numbers count from 0 over all lines."""
    exploded = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return exploded.withColumn("line", F.trim("line")).where("line <> ''")


def first_fields(lines: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """(keys, field, value, raw): the first line of each field in reading order."""
    low = F.lower(F.col(line))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_extract(low, p, g).alias("value")) for f, (p, g) in FIELDS.items()))
    hits = lines.select(*keys, *order, F.col(line).alias("raw"), F.explode(F.filter(each, lambda s: s["value"] != "")).alias("f"))
    hits = hits.select(*keys, "f.field", F.struct(*order, F.trim("f.value").alias("value"), "raw").alias("s"))
    return hits.groupBy(*keys, "field").agg(F.min("s").alias("s")).select(*keys, "field", "s.value", "s.raw")


def pivoted(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with a typed column per field; absent fields are null."""
    out = fields.groupBy(*keys).pivot("field", list(FIELDS)).agg(F.first("value"))
    for c in ("retail_sale_price", "net_quantity", "unit_sale_price"):
        out = out.withColumn(c, F.regexp_replace(c, ",", "").try_cast("double"))
    return out.withColumn("shelf_months", F.col("shelf_months").try_cast("int"))


def expiry(month_year: Column, months: Column) -> Column:
    """Last day a pack is good: its month of manufacture plus the stated months, to the month's end."""
    start = F.try_to_date(F.concat(F.lit("1/"), month_year), "d/M/yyyy")
    return F.last_day(F.add_months(start, months))


def date_tokens(c: Column) -> Column:
    """All day-month-year dates written with a month's name: an array of ISO dates, first mention first."""
    months = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    found = F.regexp_extract_all(c, F.lit(rf"([0-9]{{1,2}} (?:{'|'.join(months)}) [0-9]{{4}})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.try_to_date(t, "d MMMM yyyy").cast("string")), lambda d: d.isNotNull()))


def word_boxes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, word_no, word, x, y, w, h): text laid out as boxes, a word after the other.

    Words are at least 6 and else 8 wide a letter, with gaps of 6; rows are 24 apart.
    """
    words = lines_of(rows, key, text).select(key, F.col("line_no").alias("row_no"), F.posexplode(F.split("line", r"\s+")).alias("word_no", "word"))
    words = words.withColumn("w", F.greatest(F.lit(6.0), F.length("word") * 8.0))
    before = Window.partitionBy(key, "row_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    x = 10.0 + F.coalesce(F.sum(F.col("w") + 6.0).over(before), F.lit(0.0))
    return words.select(key, "row_no", "word_no", "word", x.alias("x"), (10.0 + F.col("row_no") * 24.0).alias("y"), "w", F.lit(16.0).alias("h"))


# Categories in order of precedence with their words.
CATEGORIES: dict[str, list[str]] = {
    "food_packaged": ["biscuit", "chips", "rice", "flour", "atta", "oil", "milk", "snack", "namkeen", "cereal", "noodle", "tea", "coffee", "sugar", "salt", "spice", "masala", "dal", "pulse"],
    "beverage_non_alcoholic": ["water", "juice", "beverage", "soda", "drink", "cola"],
    "alcoholic_beverage": ["beer", "whisky", "whiskey", "rum", "vodka", "wine", "liquor"],
    "cosmetic": ["cream", "lotion", "shampoo", "hair oil", "face wash", "moistur", "cosmetic", "talc", "perfume", "deodorant", "serum", "hair serum", "conditioner", "hair colour", "hair color", "sunscreen"],
    "soap": ["soap", "bathing bar"],
    "detergent_household": ["detergent", "washing powder", "dishwash", "cleaner", "phenyl", "bleach"],
    "pharmaceutical": ["tablet", "capsule", "syrup", "ointment", "mg ", "pharma"],
    "textile": ["cotton", "fabric", "shirt", "saree", "textile"],
    "medical_device": ["thermometer", "glucometer", "bp monitor", "blood pressure monitor", "medical device", "surgical", "syringe", "nebulizer", "oximeter", "sphygmomanometer", "hearing aid"],
    "pan_masala": ["pan masala", "gutkha", "supari", "zarda"],
    "agricultural_unprocessed": ["wheat", "paddy", "unprocessed", "raw grain", "farm produce", "mandi"],
    "restaurant_prepared": ["restaurant", "eatery", "prepared fresh", "ready to eat", "hot food", "takeaway"],
    "notified_essential": ["essential commodity", "govt notified price", "government notified", "pds", "ration", "fair price"],
    "cement": ["cement", "opc", "ppc", "portland"],
    "fertilizer": ["fertiliser", "fertilizer", "urea", "dap", "npk"],
}


def category(c: Column, whole_words: bool) -> Column:
    """struct(category, score, confidence): most matched letters win, the first category of equals.

    Whole words for text from photos, plain containment for listings; none gives 'other'.
    """
    from labelloom.functions.text import keyword_in

    low = F.lower(F.coalesce(c, F.lit("")))
    hit = (lambda w: keyword_in(w, low)) if whole_words else (lambda w: F.contains(low, F.lit(w)))
    scored = [(name, sum((F.when(hit(w), len(w)).otherwise(0) for w in words[1:]), F.when(hit(words[0]), len(words[0])).otherwise(0))) for name, words in CATEGORIES.items()]
    rows = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("k"), F.lit(n).alias("category")) for i, (n, s) in enumerate(scored)))
    best = F.array_max(rows)
    found = best["score"] > 0
    confidence = F.when(found, F.least(F.lit(1.0), F.greatest(F.lit(1), F.floor(best["score"] / 6)) / 3)).otherwise(0.2)
    return F.struct(F.when(found, best["category"]).otherwise("other").alias("category"), best["score"].alias("score"), confidence.alias("confidence"))


# Phrases of lines that belong to something else, by field.
DISQUALIFYING = {
    "retail_sale_price": ["unit sale price", "unit price", "per unit", "per 100", "special price", "our price", "offer", "deal price", "discount", "cashback", "you pay", "you save", "selling price"],
    "unit_sale_price": ["maximum retail price", "m.r.p", "mrp"],
    "net_quantity": ["serving size", "per serve", "per 100 g", "per 100 ml", "manufactured", "mfg", "packed on", "expiry", "best before", "use by", "batch", "model"],
}


def disqualified(field: str, c: Column) -> Column:
    """The line speaks of something else than the field: no unlabelled value is taken from it."""
    low = F.lower(c)
    hit = F.lit(False)
    for phrase in DISQUALIFYING.get(field, []):
        hit = hit | F.contains(low, F.lit(phrase))
    return hit | low.rlike("(^|[^a-z])(off|save)($|[^a-z])") if field == "retail_sale_price" else hit


def dates_in(c: Column) -> Column:
    """array of struct(year, month, day, token): the dates of a text in order, each once, in any of three forms."""
    @F.pandas_udf("array<struct<year:int,month:int,day:int,token:string>>")
    def udf(s: pd.Series) -> pd.Series:
        from labelloom.operators import declarations

        known = {t: [dict(zip(("year", "month", "day", "token"), x)) for x in declarations.dates_in(t)] for t in s.dropna().unique()}
        return s.map(lambda t: known.get(t, []))

    return udf(c)


def context_flags(c: Column, imported: Column) -> list[Column]:
    """wholesale, imported, special_use and gm of a pack or listing, from its text and what its source says."""
    low = F.lower(c)
    said = lambda *phrases: F.greatest(*(F.contains(low, F.lit(p)) for p in phrases))
    return [
        said("wholesale", "not for retail").alias("wholesale"), (low.rlike("(^|[^a-z])import(ed|er|s)?($|[^a-z])") | F.coalesce(imported, F.lit(False))).alias("imported"),
        said("institutional", "industrial use", "for export").alias("special_use"), (F.contains(low, F.lit("genetically modified")) | low.rlike("(^|[^a-z])gmo?($|[^a-z])")).alias("gm"),
    ]


def listing_frame(spark, rows: list[tuple]) -> DataFrame:
    """Listings from (listing_id, title, text[, platform, seller]) tuples; missing members are null."""
    cols = ["listing_id", "title", "text", "platform", "seller"]
    return spark.createDataFrame([tuple(r) + (None,) * (len(cols) - len(r)) for r in rows], "listing_id long, title string, text string, platform string, seller string")


def second_reader_rows(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field_id, value): one row for each field a second reader gave, from one column a field; nulls and blanks give none."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_id"), F.trim(F.col(c).cast("string")).alias("value")) for c, f in fields.items())))
    return rows.select(key, pairs.alias("p")).select(key, "p.*").where("value is not null and value <> ''")
