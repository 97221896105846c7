"""The core's named queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import fuzzy, geometry, text
from labelloom.operators import extraction, layout, metrics, packages
from labelloom.plans import repository
from labelloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LAST_SCANS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ingested_at DESC) rn_ FROM scans WHERE scan_id IS NOT NULL) WHERE rn_ = 1)"""
LAST_SPANS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY ingested_at DESC) rn_ FROM text_spans WHERE span_id IS NOT NULL) WHERE rn_ = 1)"""
LAST_LISTINGS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY ingested_at DESC) rn_ FROM listings WHERE listing_id IS NOT NULL) WHERE rn_ = 1)"""


def scans_(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    s = table(spark, d, "scans")
    cols = cols or ("scan_id", "created_at", "inspector_id", "product_name", "category", "verdict", "n_violations")
    return repository.latest(s.select(*dict.fromkeys([*cols, "ingested_at"])), "scan_id", "ingested_at", *cols)


def spans_(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "text_spans")
    return repository.latest(s, "span_id", "ingested_at", "text", "x", "y")


def listings_(spark: SparkSession, d: str) -> DataFrame:
    return repository.latest(table(spark, d, "listings").select("listing_id", "title", "text", "platform", "seller", "price", "is_imported", "ingested_at"), "listing_id", "ingested_at", "title", "text", "price")


# ---- scalar functions -------------------------------------------------------------------


@query("""SELECT key_id, u AS unit_base,
  CASE WHEN u IN ('kg','l') THEN net_quantity*1000 WHEN u IN ('g','ml') THEN net_quantity END AS quantity_base,
  CASE WHEN u IN ('kg','g') THEN 'mass' WHEN u IN ('ml','l') THEN 'volume' WHEN u IN ('N','U') THEN 'number' END AS dimension
FROM (SELECT key_id, net_quantity, CASE lower(trim(unit)) WHEN 'gm' THEN 'g' WHEN 'gms' THEN 'g' WHEN 'gram' THEN 'g' WHEN 'grams' THEN 'g' WHEN 'g' THEN 'g' WHEN 'kg' THEN 'kg' WHEN 'kgs' THEN 'kg'
  WHEN 'kilogram' THEN 'kg' WHEN 'ml' THEN 'ml' WHEN 'mls' THEN 'ml' WHEN 'millilitre' THEN 'ml' WHEN 'milliliter' THEN 'ml' WHEN 'l' THEN 'l' WHEN 'ltr' THEN 'l' WHEN 'litre' THEN 'l' WHEN 'liter' THEN 'l' WHEN 'n' THEN 'N' WHEN 'u' THEN 'U' ELSE trim(unit) END AS u FROM product_keys)""")
def c_base_quantity(spark, d):
    k = table(spark, d, "product_keys")
    return k.select("key_id", text.base_unit(F.col("unit")).alias("unit_base"), text.base_quantity(F.col("net_quantity"), F.col("unit")).alias("quantity_base"), text.dimension(F.col("unit")).alias("dimension"))


@query("""SELECT key_id, regexp_replace(lower(coalesce(brand,'')), '[^a-z0-9]+', '', 'g') AS brand_key,
  trim(regexp_replace(regexp_replace(lower(coalesce(common_name,'')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name_words FROM product_keys""")
def c_name_keys(spark, d):
    return table(spark, d, "product_keys").select("key_id", text.name_key(F.col("brand")).alias("brand_key"), text.words_key(F.col("common_name")).alias("name_words"))


@query("""SELECT key_id, r AS ref, CASE WHEN length(r)=0 THEN CASE WHEN length(h)=0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE levenshtein(r,h)::DOUBLE/length(r) END AS cer
FROM (SELECT key_id, regexp_replace(coalesce(brand,''), '\\s+', '', 'g') r, regexp_replace(coalesce(common_name,''), '\\s+', '', 'g') h FROM product_keys)""")
def c_error_rate(spark, d):
    k = table(spark, d, "product_keys")
    return k.select("key_id", F.regexp_replace(F.coalesce("brand", F.lit("")), r"\s+", "").alias("ref"), text.character_error_rate(F.col("brand"), F.col("common_name")).alias("cer"))


@query("""SELECT key_id, barcode, regexp_matches(barcode, '^([0-9]{8}|[0-9]{12,14})$') AND
  (10 - (SELECT sum(CAST(substr(reverse(barcode), i::INT, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FROM range(2, length(barcode)+1) t(i)) % 10) % 10 = CAST(substr(reverse(barcode),1,1) AS INT) AS valid
FROM product_keys WHERE barcode IS NOT NULL""")
def c_gtin(spark, d):
    return packages.valid_codes(table(spark, d, "product_keys"))


_PHONE, _EMAIL = text.PHONE, text.EMAIL


@query(f"""SELECT listing_id, regexp_matches(text, '{_PHONE}') AS phone, regexp_matches(text, '{_EMAIL}') AS email, nullif(regexp_extract(text, '{text.TOLL_FREE}', 2), '') AS toll_free
FROM {LAST_LISTINGS}""")
def c_contacts(spark, d):
    c = F.col("text")
    return listings_(spark, d).select("listing_id", text.has_phone(c).alias("phone"), text.has_email(c).alias("email"), text.toll_free(c).alias("toll_free"))


@query("""SELECT span_id, regexp_matches(k, '(^| )(save|offer|discount|special price)($| )') AS promo, regexp_matches(k, '(^| )(protein|carbohydrate|carbs|fat|energy|calories|kcal)($| )') AS nutrition,
  CASE """ + " ".join(f"WHEN regexp_matches(k, '(^| ){n}($| )') THEN '{n}'" for n in text.NOUNS) + f""" END AS noun
FROM (SELECT span_id, trim(regexp_replace(regexp_replace(lower(coalesce(text,'')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) k FROM {LAST_SPANS})""")
def c_context_words(spark, d):
    s, c = spans_(spark, d), F.col("text")
    return s.select("span_id", text.any_word(text.PROMO, c).alias("promo"), text.any_word(text.NUTRITION, c).alias("nutrition"), text.commodity_noun(c).alias("noun"))


@query(f"""SELECT span_id, len(list_filter(regexp_split_to_array(text, '[,\\n]'), lambda p: trim(p) <> '' AND NOT regexp_matches(lower(trim(p)), '^[^a-z0-9]*(india|bharat)[^a-z0-9]*$') AND NOT regexp_matches(lower(p), 'www[.]|@|https?:')))
  + CAST(regexp_matches(text, '(^|[^0-9A-Za-z_])([0-9]{{6}}|[0-9]{{3}} [0-9]{{3}})($|[^0-9A-Za-z_])|[A-Za-z] *- *[0-9]{{1,3}}($|[^0-9A-Za-z_])') AS INT) AS components
FROM {LAST_SPANS} WHERE text IS NOT NULL AND contains(lower(text), 'mfd by')""")
def c_address_parts(spark, d):
    s = spans_(spark, d).where(F.lower("text").contains("mfd by"))
    return s.select("span_id", text.address_components(F.col("text")).cast("long").alias("components"))


@query()
def c_clean(spark, d):
    """Cleaned text of every span (look-around patterns have no SQL twin; tested on fixtures)."""
    return spans_(spark, d).select("span_id", text.clean(F.col("text")).alias("text"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})', 1))) AS n_dates FROM documents""")
def c_dates(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce(F.size(extraction.date_tokens(F.col("text"))), F.lit(0)).cast("long").alias("n_dates"))


@query(f"""SELECT span_id, n_dev * 2 >= n_all AND n_all > 0 AND n_dev >= 2 AND confidence >= 0.8 AS devanagari FROM (SELECT span_id, coalesce(confidence,0) confidence,
 length(regexp_replace(coalesce(text,''), '[\\s0-9०-९]+', '', 'g')) n_all, length(regexp_replace(regexp_replace(coalesce(text,''), '[\\s0-9०-९]+', '', 'g'), '[^ऀ-ॿ]', '', 'g')) n_dev FROM {LAST_SPANS})""")
def c_devanagari(spark, d):
    score = F.coalesce("confidence", F.lit(0.0))
    return spans_(spark, d).select("span_id", text.prefers_devanagari(F.col("text"), F.lit(2.0), score).alias("devanagari"))


@query()
def c_anchor_fuzzy(spark, d):
    """Damaged labels: the best fuzzy anchor of two groups per distinct line (difflib has no SQL twin)."""
    lines = spans_(spark, d).where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    a = lines.withColumn("q", fuzzy.anchor(F.col("text"), "net_qty")).withColumn("c", fuzzy.anchor(F.col("text"), "consumer_care"))
    return a.where("q.anchor is not null or c.anchor is not null").select("text", "n", F.col("q.anchor").alias("net_qty"), F.col("q.score").alias("q_score"), F.col("c.anchor").alias("care"), F.col("c.score").alias("c_score"))


@query()
def c_address_repair(spark, d):
    """Address lines with damaged words put right against the words of all address lines."""
    lines = spans_(spark, d).where("text is not null").select("span_id", "text").where(fuzzy.is_address(F.col("text")))
    words = fuzzy.common_words(lines, "text")
    fixed = lines.withColumn("r", fuzzy.repaired(F.col("text"), words))
    return fixed.select("span_id", F.col("r.text").alias("text"), F.size("r.fixes").alias("n_fixes"))


# ---- boxes and layout -------------------------------------------------------------------

_ZERO = "coalesce(photo,0) photo, coalesce(x,0) x, coalesce(y,0) y, coalesce(w,0) w, coalesce(h,0) h"


@query(f"""SELECT span_id, length(trim(text)) >= 3 AND h >= 1.5 * greatest(w, 1.0) AS tall, floor(w*h*1000+0.5)/1000 AS area, floor((x+w/2)*1000+0.5)/1000 AS cx FROM {LAST_SPANS} WHERE x IS NOT NULL""")
def d_box_facts(spark, d):
    r = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return spans_(spark, d).where("x is not null").select("span_id", geometry.is_vertical(F.col("w"), F.col("h"), F.col("text")).alias("tall"), r(F.col("w") * F.col("h")).alias("area"), r(F.col("x") + F.col("w") / 2).alias("cx"))


@query(f"""WITH s AS (SELECT span_id, scan_id, {_ZERO} FROM {LAST_SPANS}), p AS (SELECT *, lag(x) OVER o px, lag(y) OVER o py, lag(w) OVER o pw, lag(h) OVER o ph FROM s WINDOW o AS (PARTITION BY scan_id, photo ORDER BY y, x, span_id))
SELECT span_id, floor(CASE WHEN u > 0 THEN i/u ELSE 0 END * 10000 + 0.5)/10000 AS iou FROM (SELECT span_id, i, w*h+pw*ph-i u FROM (SELECT *, greatest(0, least(x+w,px+pw)-greatest(x,px)) * greatest(0, least(y+h,py+ph)-greatest(y,py)) i FROM p WHERE px IS NOT NULL))""")
def d_previous_iou(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("scan_id", "photo").orderBy("y", "x", "span_id")
    s = layout.boxes(spans_(spark, d)).withColumn("b", geometry.box())
    s = s.withColumn("p", F.lag("b").over(o)).where("p is not null")
    return s.select("span_id", (F.floor(geometry.iou(F.col("b"), F.col("p")) * 10000 + 0.5) / 10000).alias("iou"))


@query()
def d_reading_order(spark, d):
    return layout.reading_order(spans_(spark, d))


@query()
def d_lines(spark, d):
    s = spans_(spark, d)
    return layout.line_boxes(s, layout.line_groups(s)).select("scan_id", "photo", "line_no", "text", "x", "y", "w", "h")


@query(f"""WITH s AS (SELECT span_id, scan_id, {_ZERO} FROM {LAST_SPANS}), p AS (SELECT a.span_id, b.span_id neighbour_id, b.x-a.x-a.w gap FROM s a JOIN s b ON a.scan_id=b.scan_id AND a.photo=b.photo AND a.span_id<>b.span_id
 WHERE a.h>=0 AND abs(a.y+a.h/2-b.y-b.h/2) <= 0.5*a.h AND b.x>=a.x+a.w AND b.x-a.x-a.w<=400)
SELECT span_id, neighbour_id, floor(gap*1000+0.5)/1000 AS gap, rank FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY gap, neighbour_id) rank FROM p) WHERE rank<=1""")
def d_right_of(spark, d):
    return layout.right_neighbours(spans_(spark, d)).withColumn("gap", F.floor(F.col("gap") * 1000 + 0.5) / 1000)


@query(f"""WITH s AS (SELECT span_id, scan_id, {_ZERO} FROM {LAST_SPANS}), p AS (SELECT a.span_id, b.span_id below_id, b.y-a.y-a.h gap FROM s a JOIN s b ON a.scan_id=b.scan_id AND a.photo=b.photo AND a.span_id<>b.span_id
 WHERE a.h>=1 AND b.h>=1 AND b.y>=a.y+a.h-0.5*a.h AND b.y-a.y-a.h<=1.2*a.h AND (abs(a.x-b.x)<=1.5*a.h OR least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x)>=0.5*least(a.w,b.w)))
SELECT span_id, below_id FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY gap, below_id) rn FROM p) WHERE rn=1""")
def d_below(spark, d):
    return layout.below_neighbours(spans_(spark, d)).select("span_id", "below_id")


@query(f"""WITH s AS (SELECT span_id, scan_id, {_ZERO} FROM {LAST_SPANS})
SELECT a.span_id, floor(min(CASE WHEN b.x+b.w<=a.x THEN a.x-b.x-b.w END)*1000+0.5)/1000 AS gap_left, floor(min(CASE WHEN b.x>=a.x+a.w THEN b.x-a.x-a.w END)*1000+0.5)/1000 AS gap_right
FROM s a LEFT JOIN s b ON a.scan_id=b.scan_id AND a.photo=b.photo AND a.span_id<>b.span_id AND b.y<a.y+a.h AND b.y+b.h>a.y GROUP BY 1""")
def d_side_gaps(spark, d):
    r = lambda c: (F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c)
    return layout.side_gaps(spans_(spark, d)).select("span_id", r("gap_left"), r("gap_right"))


@query(f"""WITH s AS (SELECT scan_id, coalesce(photo,0) photo, angle FROM {LAST_SPANS} WHERE angle IS NOT NULL AND coalesce(w,0) >= 3*coalesce(h,0)), m AS (SELECT scan_id, photo, median(angle) m, count(*) n FROM s GROUP BY 1,2)
SELECT scan_id, photo, floor(median(abs(angle-m))*10000+0.5)/10000 AS mad, max(n)>=5 AND median(abs(angle-m))>2 AS curved FROM s JOIN m USING (scan_id, photo) GROUP BY 1,2""")
def d_curved(spark, d):
    return layout.curved_pages(spans_(spark, d)).withColumn("mad", F.floor(F.col("mad") * 10000 + 0.5) / 10000)


@query(f"""SELECT scan_id, coalesce(photo,0) AS photo, CAST(sum(CASE WHEN coalesce(h,0)>=1.5*greatest(coalesce(w,0),1) THEN 0 ELSE length(trim(text)) END) AS BIGINT) AS wide, CAST(sum(CASE WHEN coalesce(h,0)>=1.5*greatest(coalesce(w,0),1) THEN length(trim(text)) ELSE 0 END) AS BIGINT) AS tall
FROM {LAST_SPANS} WHERE length(trim(text))>=3 GROUP BY 1,2""")
def d_orientation(spark, d):
    return layout.page_orientation(spans_(spark, d)).select("scan_id", "photo", "wide", "tall")


@query()
def d_overlap_suppressed(spark, d):
    return layout.overlap_suppressed(spans_(spark, d))


@query(f"""WITH s AS (SELECT scan_id, {_ZERO}, text FROM {LAST_SPANS}), e AS (SELECT scan_id, photo, min(y) y0, max(y+h) y1 FROM s GROUP BY 1,2)
SELECT scan_id, photo, bool_or(hit) AS present, bool_or(hit AND y+h/2 <= y0+0.25*(y1-y0)) AS at_top FROM (SELECT *, coalesce(regexp_matches(lower(text), '(^|[^a-z0-9])net($|[^a-z0-9])'), false) hit FROM s) JOIN e USING (scan_id, photo) GROUP BY 1,2""")
def d_top_token(spark, d):
    return layout.top_tokens(spans_(spark, d), "net")


# ---- extraction and listings ------------------------------------------------------------

_FIELD_SQL = " UNION ALL ".join(f"SELECT listing_id, line_no, '{f}' field, trim(regexp_extract(lower(line), '{p}', {g}), ' ') v, line FROM l" for f, (p, g) in extraction.FIELDS.items())


@query(f"""WITH l AS (SELECT * FROM (SELECT listing_id, generate_subscripts(a, 1) - 1 line_no, trim(unnest(a)) line FROM (SELECT listing_id, string_split(text, chr(10)) a FROM {LAST_LISTINGS} WHERE text IS NOT NULL)) WHERE line <> ''),
 h AS ({_FIELD_SQL}) SELECT listing_id, field, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, field ORDER BY line_no, v) rn FROM h WHERE v <> '') WHERE rn=1""")
def e_listing_fields(spark, d):
    lines = extraction.lines_of(listings_(spark, d), "listing_id", "text")
    return extraction.first_fields(lines, ["listing_id"], ["line_no"], "line").select("listing_id", "field", "value")


_SPAN_FIELD_SQL = " UNION ALL ".join(f"SELECT scan_id, photo, y, x, span_id, '{f}' field, trim(regexp_extract(lower(text), '{p}', {g}), ' ') v FROM l" for f, (p, g) in extraction.FIELDS.items())


@query(f"""WITH l AS (SELECT scan_id, coalesce(photo,0) photo, coalesce(y,0) y, coalesce(x,0) x, span_id, text FROM {LAST_SPANS} WHERE text IS NOT NULL), h AS ({_SPAN_FIELD_SQL})
SELECT scan_id, field, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, field ORDER BY photo, y, x, span_id) rn FROM h WHERE v <> '') WHERE rn=1""")
def e_scan_fields(spark, d):
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    s = spans_(spark, d).where("text is not null").select("scan_id", z("photo"), z("y"), z("x"), "span_id", "text")
    return extraction.first_fields(s, ["scan_id"], ["photo", "y", "x", "span_id"], "text").select("scan_id", "field", "value")


@query()
def e_scan_declarations(spark, d):
    """Typed declarations per scan with the derived last day."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    s = spans_(spark, d).where("text is not null").select("scan_id", z("photo"), z("y"), z("x"), "span_id", text.clean(F.col("text")).alias("text"))
    p = extraction.pivoted(extraction.first_fields(s, ["scan_id"], ["photo", "y", "x", "span_id"], "text"), ["scan_id"])
    return p.withColumn("good_until", extraction.expiry(F.col("manufacture_date"), F.col("shelf_months")))


@query(f"""WITH l AS (SELECT * FROM (SELECT listing_id, generate_subscripts(a, 1) - 1 row_no, trim(unnest(a)) line FROM (SELECT listing_id, string_split(text, chr(10)) a FROM {LAST_LISTINGS} WHERE text IS NOT NULL)) WHERE line <> ''),
 w AS (SELECT listing_id, row_no, generate_subscripts(a,1)-1 word_no, unnest(a) word FROM (SELECT listing_id, row_no, regexp_split_to_array(line, '\\s+') a FROM l)), b AS (SELECT *, greatest(6.0, length(word)*8.0)::DOUBLE w FROM w)
SELECT listing_id, row_no, word_no, word, (10 + coalesce(sum(w+6) OVER (PARTITION BY listing_id, row_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS x, (10+row_no*24)::DOUBLE AS y FROM b""")
def a_listing_boxes(spark, d):
    return extraction.word_boxes(listings_(spark, d), "listing_id", "text").select("listing_id", "row_no", "word_no", "word", "x", "y")


def _category_sql(column: str, whole: bool, source: str, key: str) -> str:
    def hit(w: str) -> str:
        if not whole:
            return f"contains(t, '{w}')"
        s = w.strip()
        return f"regexp_matches(t, '(^|[^a-z]){s}" + ("(s|es)?($|[^a-z])')" if len(s) <= 4 else "')")

    rows = ", ".join("struct_pack(score := " + "+".join(f"CASE WHEN {hit(w)} THEN {len(w)} ELSE 0 END" for w in ws) + f", k := {-i}, c := '{n}')" for i, (n, ws) in enumerate(extraction.CATEGORIES.items()))
    return f"SELECT {key}, CASE WHEN b.score > 0 THEN b.c ELSE 'other' END AS category, b.score AS score FROM (SELECT {key}, list_max([{rows}]) b FROM (SELECT {key}, lower(coalesce({column},'')) t FROM {source}))"


@query(_category_sql("title", False, LAST_LISTINGS, "listing_id"))
def f_listing_category(spark, d):
    c = extraction.category(F.col("title"), whole_words=False)
    return listings_(spark, d).select("listing_id", c.alias("c")).select("listing_id", "c.category", "c.score")


@query(_category_sql("product_name", True, LAST_SCANS, "scan_id"))
def f_scan_category(spark, d):
    c = extraction.category(F.col("product_name"), whole_words=True)
    return scans_(spark, d).select("scan_id", c.alias("c")).select("scan_id", "c.category", "c.score")


# ---- packages and the whole store -------------------------------------------------------


@query(f"""WITH s AS (SELECT span_id, scan_id, coalesce(photo,0) photo, coalesce(y,0) y, coalesce(h,0) h FROM {LAST_SPANS}), p AS (SELECT scan_id, photo, max(y+h) ph FROM s GROUP BY 1,2),
 o AS (SELECT *, coalesce(sum(ph+80) OVER (PARTITION BY scan_id ORDER BY photo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) off FROM p) SELECT span_id, floor((y+off)*100+0.5)/100 AS y_stacked FROM s JOIN o USING (scan_id, photo)""")
def k_stacked(spark, d):
    return packages.stacked(spans_(spark, d)).select("span_id", (F.floor(F.col("y_stacked") * 100 + 0.5) / 100).alias("y_stacked"))


@query(f"""SELECT scan_id, lang, span_id, text FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, lang ORDER BY coalesce(source_engine LIKE '%zoom%', false), text IS NULL, coalesce(confidence,-1) DESC, photo NULLS FIRST, span_id) rn2 FROM {LAST_SPANS}) WHERE rn2=1""")
def k_best_readings(spark, d):
    s = spans_(spark, d).select("scan_id", "lang", "span_id", "text", "confidence", "photo", "source_engine")
    return packages.best_readings(s, ["scan_id", "lang"], "text", "confidence", ["photo", "span_id"], F.col("source_engine").contains("zoom")).select("scan_id", "lang", "span_id", "text")


@query("""WITH k AS (SELECT scan_id, barcode, CASE WHEN isnan(net_quantity) THEN NULL WHEN lower(unit) IN ('kg','l') THEN net_quantity*1000 WHEN lower(unit) IN ('g','ml') THEN net_quantity END q, CASE WHEN lower(unit) IN ('kg','g') THEN 'mass' ELSE 'volume' END dim FROM product_keys WHERE scan_id IS NOT NULL),
 p AS (SELECT scan_id, dim, min(q) q0, max(q) q1 FROM k GROUP BY 1,2), g AS (SELECT scan_id, min(q0) q_min, max(q1) q_max, bool_or(q1-q0 > 0.01*q1) differs FROM p GROUP BY 1), c AS (SELECT scan_id, count(DISTINCT barcode) n FROM k GROUP BY 1)
SELECT scan_id, n AS n_barcodes, q_min, q_max, n>1 OR coalesce(differs,false) AS conflict FROM c JOIN g USING (scan_id)""")
def k_conflicts(spark, d):
    return packages.identity_conflicts(table(spark, d, "product_keys"))


@query()
def k_identity(spark, d):
    """Product identity of each key (the SQL twin would differ in the text of decimals)."""
    return packages.product_identity(table(spark, d, "product_keys"))


# ---- repository -------------------------------------------------------------------------


@query(f"""SELECT scan_id, epoch_us(created_at) AS at_us, product_name, category, verdict, n_violations FROM {LAST_SCANS} WHERE (product_name ILIKE '%care%' OR category ILIKE '%care%') AND verdict='non_compliant' ORDER BY created_at DESC, scan_id LIMIT 50 OFFSET 5""")
def l_search(spark, d):
    s = repository.search(scans_(spark, d), "care", "non_compliant", 50, 5)
    return s.select("scan_id", F.unix_micros("created_at").alias("at_us"), "product_name", "category", "verdict", "n_violations")


@query("""SELECT code, scan_id, at_us FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY at_us DESC, scan_id DESC) rn FROM (SELECT ltrim(barcode,'0') code, scan_id, epoch_us(typed_at) at_us FROM product_keys WHERE barcode IS NOT NULL AND scan_id IS NOT NULL)) WHERE rn=1 AND code<>''""")
def l_latest_by_code(spark, d):
    k = table(spark, d, "product_keys").where("barcode is not null and scan_id is not null").withColumnRenamed("typed_at", "created_at")
    return repository.latest_by_code(k, F.col("barcode")).select("code", "scan_id", F.unix_micros("created_at").alias("at_us"))


@query(f"""SELECT s.scan_id, s.product_name, count(a.action_id) AS n_actions, arg_max(a.action_taken, struct_pack(t := a.acted_at, i := a.action_id)) AS last_action, coalesce(string_agg(a.action_taken, '>' ORDER BY a.acted_at, a.action_id), '') AS history FROM {LAST_SCANS} s LEFT JOIN actions a USING (scan_id) GROUP BY 1,2""")
def l_details(spark, d):
    return repository.details(scans_(spark, d), table(spark, d, "actions"))


@query(f"SELECT verdict, count(*) AS n FROM {LAST_SCANS} GROUP BY 1")
def l_verdicts(spark, d):
    return scans_(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT rule_id, min(citation) AS citation, count(*) AS n FROM findings WHERE outcome='VIOLATION' GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 15")
def l_top_rules(spark, d):
    return repository.top_rules(table(spark, d, "findings"))


@query(f"SELECT category, count(*) AS n FROM {LAST_SCANS} WHERE verdict='non_compliant' GROUP BY 1")
def l_by_category(spark, d):
    return scans_(spark, d).where("verdict = 'non_compliant'").groupBy("category").agg(F.count("*").alias("n"))


@query(f"SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE verdict='non_compliant') AS bad FROM {LAST_SCANS} GROUP BY 1 ORDER BY day DESC LIMIT 30")
def l_daily(spark, d):
    return repository.daily(scans_(spark, d))


@query("""SELECT scan_id, o IS NOT NULL AND (c IS NULL OR o > c) AS is_open FROM (SELECT scan_id, max(struct_pack(t := acted_at, i := action_id)) FILTER (WHERE action_taken='overridden') o, max(struct_pack(t := acted_at, i := action_id)) FILTER (WHERE action_taken='confirmed') c FROM actions GROUP BY 1)""")
def l_last_event_open(spark, d):
    a = table(spark, d, "actions")
    return repository.last_event_open(a, "scan_id", "acted_at", "action_id", F.col("action_taken") == "overridden", F.col("action_taken") == "confirmed")


@query("""SELECT uid, full_name, staff_role FROM inspectors WHERE status='active' AND upper(trim(uid)) IN (SELECT upper(trim(user_id)) FROM actions)""")
def l_credentials(spark, d):
    r = table(spark, d, "inspectors")
    typed = table(spark, d, "actions").select(F.lower("user_id").alias("uid")).distinct().join(r.select(F.lower("uid").alias("uid"), F.upper("full_name").alias("name")), "uid")
    return repository.credentials(typed, r, "uid", "name").select("uid", "full_name", "staff_role")


@query(f"SELECT scan_id, epoch_us(created_at) AS at_us FROM {LAST_SCANS} WHERE created_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' - INTERVAL 365 DAY")
def b_expired(spark, d):
    return repository.expired(scans_(spark, d), "2025-06-01 00:00:00", 365).select("scan_id", F.unix_micros("created_at").alias("at_us"))


@query(f"SELECT finding_id FROM findings WHERE scan_id NOT IN (SELECT scan_id FROM {LAST_SCANS} WHERE created_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' - INTERVAL 365 DAY)")
def b_retained(spark, d):
    gone = repository.expired(scans_(spark, d), "2025-06-01 00:00:00", 365)
    return repository.retained(table(spark, d, "findings"), gone).select("finding_id")


@query(f"SELECT scan_id, epoch_us(ingested_at) AS at_us, verdict FROM {LAST_SCANS}")
def b_upserted(spark, d):
    return scans_(spark, d).select("scan_id", F.unix_micros("ingested_at").alias("at_us"), "verdict")


@query("SELECT scan_id, rule_id, count(*) AS n FROM findings f WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.scan_id=f.scan_id AND a.rule_id=f.rule_id) GROUP BY 1,2")
def j_unreviewed(spark, d):
    return repository.unmatched(table(spark, d, "findings"), table(spark, d, "actions")).groupBy("scan_id", "rule_id").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT scan_id, CASE outcome WHEN 'VIOLATION' THEN 0 WHEN 'INDETERMINATE' THEN 1 ELSE 2 END o, CASE upper(trim(severity)) WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END r, rule_id FROM findings WHERE outcome<>'NOT_APPLICABLE')
SELECT scan_id, count(*) AS n_shown, first(rule_id ORDER BY o,r,rule_id) AS worst, string_agg(rule_id, ',' ORDER BY o,r,rule_id) AS rules FROM f GROUP BY 1""")
def j_ranked_views(spark, d):
    return repository.ranked_views(table(spark, d, "findings"))


@query("""SELECT scan_id, v AS n_violation, u AS n_undecided, k AS n_ok, CASE WHEN v>0 THEN false WHEN u>0 THEN NULL WHEN k>0 THEN true END AS compliant FROM (SELECT scan_id, count(*) FILTER (WHERE outcome='VIOLATION') v, count(*) FILTER (WHERE outcome='INDETERMINATE') u, count(*) FILTER (WHERE outcome='COMPLIANT') k FROM (SELECT DISTINCT scan_id, rule_id, outcome FROM findings) GROUP BY 1)""")
def j_verdicts(spark, d):
    return repository.verdicts(table(spark, d, "findings"))


@query("SELECT upper(trim(severity)) AS severity, outcome, count(*) AS n FROM findings GROUP BY 1,2")
def j_summary(spark, d):
    return table(spark, d, "findings").groupBy(text.severity(F.col("severity")).alias("severity"), "outcome").agg(F.count("*").alias("n"))


# ---- metrics ----------------------------------------------------------------------------

_TRUTH = "SELECT f.rule_id, f.outcome='VIOLATION' p, coalesce(a.t,false) t FROM findings f LEFT JOIN (SELECT scan_id, rule_id, bool_or(action_taken='confirmed') t FROM actions GROUP BY 1,2) a USING (scan_id, rule_id)"


@query(f"""WITH c AS (SELECT rule_id, count(*) FILTER (WHERE p AND t) tp, count(*) FILTER (WHERE p AND NOT t) fp, count(*) FILTER (WHERE NOT p AND t) fn FROM ({_TRUTH}) GROUP BY ROLLUP(rule_id)),
 s AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END p, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END r FROM c)
SELECT rule_id, tp, fp, fn, floor(p*10000+0.5)/10000 AS "precision", floor(r*10000+0.5)/10000 AS recall, floor(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END*10000+0.5)/10000 AS f1 FROM s""")
def m_detection(spark, d):
    f, a = table(spark, d, "findings"), table(spark, d, "actions")
    t = a.groupBy("scan_id", "rule_id").agg(F.bool_or(F.col("action_taken") == "confirmed").alias("t"))
    rows = f.join(t, ["scan_id", "rule_id"], "left").select("rule_id", (F.col("outcome") == "VIOLATION").alias("p"), F.coalesce("t", F.lit(False)).alias("t"))
    return metrics.detection_scores(rows, "rule_id", "p", "t")


@query("SELECT count(*) AS n, floor(avg(CASE WHEN outcome='INDETERMINATE' THEN 1.0 ELSE 0 END)*10000+0.5)/10000 AS abstained FROM findings")
def m_abstention(spark, d):
    r = table(spark, d, "findings").agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "INDETERMINATE").cast("int")).alias("a"))
    return r.select("n", (F.floor(F.col("a") * 10000 + 0.5) / 10000).alias("abstained"))


@query(f"""WITH t AS (SELECT listing_id, price, try_cast(replace(regexp_extract(lower(text), '{extraction.FIELDS['retail_sale_price'][0]}', 1), ',', '') AS DOUBLE) v FROM {LAST_LISTINGS})
SELECT count(*) AS n, floor(avg(abs(v-price))*10000+0.5)/10000 AS mae, max(abs(v-price)) AS worst, floor(avg(CASE WHEN abs(v-price)<=0.5 THEN 1.0 ELSE 0 END)*10000+0.5)/10000 AS within FROM t WHERE v IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)""")
def m_measurement(spark, d):
    v = F.regexp_replace(F.regexp_extract(F.lower("text"), *extraction.FIELDS["retail_sale_price"]), ",", "").try_cast("double")
    rows = listings_(spark, d).where("not isnan(price)").select("price", v.alias("v"))
    r = lambda c: (F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c)
    return metrics.measurement_errors(rows, "v", "price", 0.5).select("n", r("mae"), "worst", r("within"))


@query(f"SELECT scan_id, count(DISTINCT photo) AS n_views, count(DISTINCT text) AS n_values FROM {LAST_SPANS} GROUP BY 1")
def m_stability(spark, d):
    return metrics.stability(spans_(spark, d), "scan_id", "photo", "text")


@query("""WITH e AS (SELECT scan_id, list_distinct(list(rule_id)) r FROM findings WHERE outcome='VIOLATION' GROUP BY 1), p AS (SELECT scan_id, list_distinct(list(rule_id)) r FROM findings WHERE outcome='INDETERMINATE' GROUP BY 1), a AS (SELECT scan_id, list_distinct(list(rule_id)) r FROM actions WHERE action_taken='confirmed' GROUP BY 1),
 j AS (SELECT a.scan_id, coalesce(a.r, []) x, coalesce(p.r, []) q, coalesce(e.r, []) g FROM a LEFT JOIN p USING (scan_id) LEFT JOIN e USING (scan_id))
SELECT scan_id, len(list_intersect(x,g)) AS caught, len(list_filter(x, lambda i: NOT list_contains(g,i))) AS missed, len(list_filter(q, lambda i: NOT list_contains(x,i) AND list_contains(g,i))) AS excused, len(list_filter(g, lambda i: NOT list_contains(x,i) AND NOT list_contains(q,i))) AS false_alarms FROM j""")
def m_sets(spark, d):
    f, a = table(spark, d, "findings"), table(spark, d, "actions")
    sets = lambda df, n: df.groupBy("scan_id").agg(F.collect_set("rule_id").alias(n))
    e = sets(a.where("action_taken = 'confirmed'"), "x").join(sets(f.where("outcome = 'INDETERMINATE'"), "q"), "scan_id", "left").join(sets(f.where("outcome = 'VIOLATION'"), "g"), "scan_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return e.select("scan_id", *(c for c in metrics.set_scores(z("x"), z("q"), z("g")))).select("scan_id", *(F.col(c).cast("long").alias(c) for c in ("caught", "missed", "excused", "false_alarms")))


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1,2""")
def x_windowed(spark, d):
    """The windowed stream's logic as a batch query (Structured Streaming runs it unchanged)."""
    from labelloom import streaming

    w = streaming.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query()
def b_crops(spark, d):
    """Crop rectangles of the findings with an evidence box, out of the nested payloads."""
    from labelloom.operators import nested
    from labelloom.sources import sinks

    findings = nested.typed_table(nested.flatten_payloads(table(spark, d, "scans")), "finding")
    return sinks.crops(findings, "evidence_bbox", F.lit(1200.0), F.lit(1600.0))


@query(f"""WITH s AS (SELECT span_id, scan_id, {_ZERO} FROM {LAST_SPANS})
SELECT a.span_id, floor(min(CASE WHEN b.y+b.h<=a.y THEN a.y-b.y-b.h END)*1000+0.5)/1000 AS gap_top, floor(min(CASE WHEN b.y>=a.y+a.h THEN b.y-a.y-a.h END)*1000+0.5)/1000 AS gap_bottom
FROM s a LEFT JOIN s b ON a.scan_id=b.scan_id AND a.photo=b.photo AND a.span_id<>b.span_id AND b.x<a.x+a.w AND b.x+b.w>a.x GROUP BY 1""")
def d_vertical_gaps(spark, d):
    from labelloom.operators import recovery

    r = lambda c: (F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c)
    return recovery.vertical_gaps(spans_(spark, d)).select("span_id", r("gap_top"), r("gap_bottom"))


@query(f"""SELECT span_id FROM {LAST_SPANS} WHERE regexp_matches(lower(trim(text)), '^[^a-z0-9]*(m[.]?r[.]?p[.]?|net (qty|quantity|wt|weight|contents?)|(mfg|mfd|pkd)[.]?( date| by)?|(manufactured|packed|marketed) (by|on)|consumer care|customer care|best before|batch no[.]?|country of origin|unit (sale )?price)[^a-z0-9]*$')""")
def c_bare_labels(spark, d):
    from labelloom.operators import recovery

    return spans_(spark, d).where(recovery.is_bare_label(F.col("text"))).select("span_id")


@query(f"""WITH k AS (SELECT scan_id, common_name v FROM (SELECT scan_id, common_name, row_number() OVER (PARTITION BY scan_id ORDER BY key_id) rn FROM product_keys WHERE scan_id IS NOT NULL AND common_name IS NOT NULL) WHERE rn=1),
 f AS (SELECT scan_id, product_name v FROM {LAST_SCANS} WHERE product_name IS NOT NULL), t AS (SELECT scan_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') t FROM {LAST_SPANS} WHERE text IS NOT NULL)
SELECT scan_id, v AS value, 0.9::DOUBLE AS confidence, 'first' AS source FROM f UNION ALL
SELECT scan_id, v, CASE WHEN a THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END, CASE WHEN a THEN 'second+first' ELSE 'second' END FROM (SELECT k.scan_id, v, coalesce(bool_or(contains(t, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g')) AND regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') <> ''), false) a
 FROM k LEFT JOIN t USING (scan_id) WHERE k.scan_id NOT IN (SELECT scan_id FROM f) GROUP BY 1, 2)""")
def e_completed_names(spark, d):
    from labelloom.operators import recovery

    found = scans_(spark, d).select("scan_id", F.col("product_name").alias("value"), F.lit(0.9).alias("confidence"))
    keys = table(spark, d, "product_keys").where("scan_id is not null and common_name is not null")
    second = keys.groupBy("scan_id").agg(F.min_by("common_name", "key_id").alias("value"))
    # lines of items whose name is missing; items with one need none
    need = second.join(found.where("value is not null"), "scan_id", "left_anti").select("scan_id")
    seen = spans_(spark, d).where("text is not null").join(need, "scan_id", "left_semi").select("scan_id", "text")
    return recovery.completed(found, second, ["scan_id"], seen)


@query()
def s_synthetic_lines(spark, d):
    """Lines of as many synthetic labels as there are scans (generated; no table to compare with)."""
    from labelloom.operators import synthetic

    return synthetic.manifests(synthetic.specifications(spark, scans_(spark, d).count()))
