"""Queries of the scalar functions over whole tables, with SQL twins written from their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import geometry, text
from labelloom.operators import extraction, recovery
from labelloom.plans.queries import LAST_LISTINGS, LAST_SCANS, LAST_SPANS, listings_, query, scans_, spans_
from labelloom.session import table


@query(f"SELECT span_id, translate(text, 'OolISB', '001158') AS digits FROM {LAST_SPANS}")
def c_digits(spark, d):
    return spans_(spark, d).select("span_id", text.digits_fixed(F.col("text")).alias("digits"))


@query(f"SELECT span_id, translate(text, '०१२३४५६७८९', '0123456789') AS text FROM {LAST_SPANS} WHERE lang = 'hi'")
def c_ascii_digits(spark, d):
    return spans_(spark, d).where("lang = 'hi'").select("span_id", text.ascii_digits(F.col("text")).alias("text"))


@query("""SELECT key_id, CASE u WHEN '|' THEN 'l' WHEN 'I' THEN 'l' WHEN '1' THEN 'l' WHEN '!' THEN 'l' WHEN '9' THEN 'g' WHEN 'q' THEN 'g' WHEN '6' THEN 'g' WHEN '&' THEN 'g' WHEN 'mI' THEN 'ml' WHEN 'm|' THEN 'ml' WHEN 'rnl' THEN 'ml' WHEN 'kq' THEN 'kg' WHEN 'k9' THEN 'kg' WHEN '0' THEN 'g'
 ELSE CASE lower(u) WHEN 'q' THEN 'g' WHEN 'rnl' THEN 'ml' WHEN 'kq' THEN 'kg' WHEN 'k9' THEN 'kg' ELSE u END END AS unit FROM (SELECT key_id, trim(unit) u FROM product_keys WHERE unit IS NOT NULL)""")
def c_unit_normal(spark, d):
    return table(spark, d, "product_keys").where("unit is not null").select("key_id", text.unit_normal(F.col("unit")).alias("unit"))


@query("""SELECT key_id, unit IS NOT NULL AND (lower(trim(unit)) IN ('g','gm','gms','gram','grams','kg','kgs','kilogram') AND 'g' IN ('g','kg')) AS mass_limit, unit IS NOT NULL AND lower(trim(unit)) IN ('ml','mls','millilitre','milliliter','l','ltr','litre','liter') AS volume_limit FROM product_keys""")
def c_same_dimension(spark, d):
    k = table(spark, d, "product_keys")
    return k.select("key_id", text.same_dimension(F.col("unit"), ["g", "kg"]).alias("mass_limit"), text.same_dimension(F.col("unit"), ["ml"]).alias("volume_limit"))


_YEAR = "(^|[^0-9])([0-9]{2}|[0-9]{4})($|[^0-9])"


@query(f"""SELECT span_id, CASE WHEN y BETWEEN 2000 AND 2045 THEN y END AS year FROM (SELECT span_id, CASE WHEN v < 100 THEN v + 2000 ELSE v END y FROM (SELECT span_id, try_cast(regexp_extract(text, '{_YEAR}', 2) AS INT) v FROM {LAST_SPANS} WHERE regexp_matches(text, '{_YEAR}')))""")
def c_year(spark, d):
    s = spans_(spark, d).where(F.col("text").rlike(_YEAR))
    return s.select("span_id", text.plausible_year(F.regexp_extract("text", _YEAR, 2)).alias("year"))


_MONTH = "(^|[^0-9/])([0-9]{1,2})/(20[0-9]{2})($|[^0-9/])"


@query(f"""SELECT span_id, m, y, y * 12 + m > 2025 * 12 + 6 + 1 AS future FROM (SELECT span_id, CAST(regexp_extract(text, '{_MONTH}', 2) AS INT) m, CAST(regexp_extract(text, '{_MONTH}', 3) AS INT) y FROM {LAST_SPANS} WHERE regexp_matches(text, '{_MONTH}')) WHERE m BETWEEN 1 AND 12""")
def c_future(spark, d):
    s = spans_(spark, d).where(F.col("text").rlike(_MONTH)).select("span_id", F.regexp_extract("text", _MONTH, 2).cast("int").alias("m"), F.regexp_extract("text", _MONTH, 3).cast("int").alias("y"))
    return s.where("m between 1 and 12").withColumn("future", text.month_in_future(F.col("m"), F.col("y"), "2025-06-15"))


@query(f"SELECT scan_id, coalesce(photo, 0) AS photo, floor(sum(CAST(floor(coalesce(confidence, 0) * 1000 + 0.5) AS BIGINT)) / count(*) * 100 + 0.5) / 100000 AS mean_confidence FROM {LAST_SPANS} GROUP BY 1, 2")
def c_mean_confidence(spark, d):
    s = spans_(spark, d).groupBy("scan_id", F.coalesce("photo", F.lit(0)).alias("photo")).agg(F.avg(F.floor(F.coalesce("confidence", F.lit(0.0)) * 1000 + 0.5)).alias("m"))
    return s.select("scan_id", "photo", (F.floor(F.col("m") * 100 + 0.5) / 100000).alias("mean_confidence"))


@query("SELECT key_id, CASE WHEN length(w) <= 4 THEN NULL WHEN length(w) <= 8 THEN 85.0::DOUBLE ELSE 78.0::DOUBLE END AS threshold FROM (SELECT key_id, trim(regexp_replace(regexp_replace(lower(coalesce(common_name,'')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) w FROM product_keys)")
def c_fuzzy_threshold(spark, d):
    k = table(spark, d, "product_keys")
    return k.select("key_id", text.fuzzy_threshold(text.words_key(F.col("common_name"))).alias("threshold"))


@query("SELECT key_id, CASE WHEN barcode IS NOT NULL THEN 'PRESENT' WHEN scan_id IS NOT NULL THEN 'CONFIRMED_ABSENT' ELSE 'NOT_VISIBLE' END AS state FROM product_keys")
def c_presence(spark, d):
    return table(spark, d, "product_keys").select("key_id", text.presence(F.col("barcode").isNotNull(), F.col("scan_id").isNotNull()).alias("state"))


@query("SELECT finding_id, severity FROM findings WHERE severity IS NULL OR upper(trim(severity)) NOT IN ('CRITICAL', 'MAJOR', 'MINOR')")
def c_bad_severity(spark, d):
    """Findings whose severity is none of the known ones; ``severity_checked`` fails on them."""
    return table(spark, d, "findings").where(text.severity(F.col("severity")).isNull()).select("finding_id", "severity")


_BLOCK_SQL = "list_reduce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda a, x: CASE WHEN regexp_matches(a, '[,:;.&/-]\\s*$') THEN a || ' ' || x ELSE a || ', ' || x END)"


@query(f"SELECT listing_id, {_BLOCK_SQL} AS block FROM {LAST_LISTINGS} WHERE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 0")
def c_join_block(spark, d):
    s = listings_(spark, d).select("listing_id", recovery.joined_block(F.split("text", "\n")).alias("block"))
    return s.where("block <> ''")


_CJK = text.CJK


@query(f"SELECT span_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{_CJK}([ ]?[0-9])', '₹\\1', 'g'), '{_CJK}', '', 'g'), '\\s+', ' ', 'g')) AS text FROM {LAST_SPANS} WHERE text IS NOT NULL")
def c_visible(spark, d):
    return spans_(spark, d).where("text is not null").select("span_id", text.visible(F.col("text")).alias("text"))


_ISO = "list_transform(regexp_extract_all(text, '([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})', 1), lambda x: strftime(try_strptime(x, '%d %B %Y'), '%Y-%m-%d'))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_ISO}, lambda x: x IS NOT NULL))), ',') AS dates FROM documents WHERE text IS NOT NULL")
def c_date_values(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(F.array_sort(extraction.date_tokens(F.col("text"))), ",").alias("dates"))


@query()
def c_dates_in(spark, d):
    """Every date of every span in any of the three forms, in order (positions have no SQL twin; tested on fixtures)."""
    s = spans_(spark, d).where("text rlike '[0-9]'")
    return s.select("span_id", F.posexplode(extraction.dates_in(F.col("text"))).alias("pos", "x")).select("span_id", "pos", "x.year", "x.month", "x.day", "x.token")


@query(f"""SELECT span_id, regexp_matches(l, '(^|[^a-z])(off|save)($|[^a-z])') OR contains(l,'unit sale price') OR contains(l,'unit price') OR contains(l,'per unit') OR contains(l,'per 100') OR contains(l,'special price') OR contains(l,'our price') OR contains(l,'offer') OR contains(l,'deal price') OR contains(l,'discount') OR contains(l,'cashback') OR contains(l,'you pay') OR contains(l,'you save') OR contains(l,'selling price') AS no_price,
 contains(l,'serving size') OR contains(l,'per serve') OR contains(l,'per 100 g') OR contains(l,'per 100 ml') OR contains(l,'manufactured') OR contains(l,'mfg') OR contains(l,'packed on') OR contains(l,'expiry') OR contains(l,'best before') OR contains(l,'use by') OR contains(l,'batch') OR contains(l,'model') AS no_quantity FROM (SELECT span_id, lower(text) l FROM {LAST_SPANS} WHERE text IS NOT NULL)""")
def c_disqualified(spark, d):
    c = F.col("text")
    return spans_(spark, d).where("text is not null").select("span_id", extraction.disqualified("retail_sale_price", c).alias("no_price"), extraction.disqualified("net_quantity", c).alias("no_quantity"))


# ---- boxes and scales -------------------------------------------------------------------

_R = lambda c: F.floor(c * 1000 + 0.5) / 1000


@query(f"SELECT span_id, floor(w / (h / 2.5) * 1000 + 0.5) / 1000 AS w_mm, floor(w / (h / 2.5 * (h / 2.5)) * 0.4 * 1000 + 0.5) / 1000 AS err_mm FROM {LAST_SPANS} WHERE h > 0 AND w IS NOT NULL")
def d_lengths(spark, d):
    """Width of every span in millimetres with its error, were its line 2.5 mm high."""
    s = spans_(spark, d).where("h > 0 and w is not null").withColumn("k", F.col("h") / 2.5)
    return s.select("span_id", _R(geometry.px_to_mm(F.col("w"), F.col("k"))).alias("w_mm"), _R(geometry.mm_uncertainty(F.col("w"), F.col("k"), F.lit(0.4))).alias("err_mm"))


@query(f"SELECT span_id, floor(h / 2.5 * 1000 + 0.5) / 1000 AS px_per_mm, floor(h / 2.5 * 0.1 / 2.5 * 1000 + 0.5) / 1000 AS sigma FROM {LAST_SPANS} WHERE h > 0")
def d_known_scale(spark, d):
    s = spans_(spark, d).where("h > 0").select("span_id", geometry.known_scale(F.col("h"), F.lit(2.5), F.lit(0.1)).alias("k"))
    return s.select("span_id", _R(F.col("k.px_per_mm")).alias("px_per_mm"), _R(F.col("k.sigma")).alias("sigma"))


@query(f"""SELECT span_id, CASE t WHEN 1 THEN 2000 - y WHEN 2 THEN 1500 - x WHEN 3 THEN y ELSE x END AS rx, CASE t WHEN 1 THEN x WHEN 2 THEN 2000 - y WHEN 3 THEN 1500 - x ELSE y END AS ry FROM (SELECT span_id, x, y, coalesce(photo, 0) % 4 t FROM {LAST_SPANS} WHERE x IS NOT NULL AND y IS NOT NULL)""")
def d_turned_points(spark, d):
    s = spans_(spark, d).where("x is not null and y is not null").withColumn("t", F.coalesce("photo", F.lit(0)) % 4 * 90)
    x, y = geometry.rotated_point(F.col("x"), F.col("y"), F.col("t"), F.lit(1500.0), F.lit(2000.0))
    return s.select("span_id", x.alias("rx"), y.alias("ry"))


@query(f"""SELECT scan_id, photo, floor((x1-x0) * (y1-y0) / 144.0 / 100 * 1000 + 0.5) / 1000 AS area_cm2 FROM (SELECT scan_id, coalesce(photo,0) photo, min(coalesce(x,0)) x0, max(coalesce(x,0)+coalesce(w,0)) x1, min(coalesce(y,0)) y0, max(coalesce(y,0)+coalesce(h,0)) y1 FROM {LAST_SPANS} GROUP BY 1,2)""")
def d_panel_areas(spark, d):
    """Area of the printed panel of every page at 12 pixels a millimetre."""
    s = spans_(spark, d)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    e = s.groupBy("scan_id", F.coalesce("photo", F.lit(0)).alias("photo")).agg(F.min(z("x")).alias("x0"), F.max(z("x") + z("w")).alias("x1"), F.min(z("y")).alias("y0"), F.max(z("y") + z("h")).alias("y1"))
    quad = F.array(*(F.array(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    return e.select("scan_id", "photo", _R(geometry.panel_area_cm2(quad, F.lit(12.0))).alias("area_cm2"))


@query(f"""SELECT span_id, least(x, x+w, x+w+3, x+3) AS px, least(y, y+2, y+h, y+h+2) AS py, greatest(x, x+w, x+w+3, x+3) - least(x, x+w, x+w+3, x+3) AS pw, greatest(y, y+2, y+h, y+h+2) - least(y, y+2, y+h, y+h+2) AS ph FROM {LAST_SPANS} WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL""")
def d_polygon_boxes(spark, d):
    """The upright box of every span's slanted outline (a polygon of four points made from its box)."""
    p = lambda a, b: F.array(F.expr(a), F.expr(b))
    s = spans_(spark, d).where("x is not null and y is not null and w is not null and h is not null")
    b = geometry.polygon_box(F.array(p("x", "y"), p("x + w", "y + 2"), p("x + w + 3", "y + h + 2"), p("x + 3", "y + h")))
    return s.select("span_id", b.alias("b")).select("span_id", F.col("b.x").alias("px"), F.col("b.y").alias("py"), F.col("b.w").alias("pw"), F.col("b.h").alias("ph"))


@query(f"SELECT scan_id, c.score > 0 AS found, CASE WHEN c.score > 0 THEN least(1.0, greatest(1, floor(c.score / 6)) / 3) ELSE 0.2 END::DOUBLE AS confidence FROM (SELECT scan_id, struct_pack(score := {{score}}) c FROM (SELECT scan_id, lower(coalesce(product_name,'')) t FROM {LAST_SCANS}))".replace("{score}", "list_max([" + ", ".join("+".join(f"CASE WHEN contains(t, '{w}') THEN {len(w)} ELSE 0 END" for w in ws) for ws in extraction.CATEGORIES.values()) + "])"))
def f_confidence(spark, d):
    """How sure the category of every scan's product name is (words anywhere in the name)."""
    c = extraction.category(F.col("product_name"), whole_words=False)
    return scans_(spark, d).select("scan_id", c.alias("c")).select("scan_id", (F.col("c.score") > 0).alias("found"), F.col("c.confidence").alias("confidence"))


@query(f"""SELECT listing_id, contains(l,'wholesale') OR contains(l,'not for retail') AS wholesale, regexp_matches(l, '(^|[^a-z])import(ed|er|s)?($|[^a-z])') OR coalesce(is_imported, false) AS imported, contains(l,'institutional') OR contains(l,'industrial use') OR contains(l,'for export') AS special_use,
 contains(l,'genetically modified') OR regexp_matches(l, '(^|[^a-z])gmo?($|[^a-z])') AS gm FROM (SELECT listing_id, is_imported, lower(concat_ws(' ', title, text)) l FROM {LAST_LISTINGS})""")
def f_context_flags(spark, d):
    s = listings_(spark, d)
    flags = extraction.context_flags(F.concat_ws(" ", "title", "text"), F.col("is_imported"))
    return s.select("listing_id", *flags)
