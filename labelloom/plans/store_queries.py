"""Queries over the stored scans, packs, listings and findings, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelloom.functions import geometry, text
from labelloom.operators import declarations, extraction, layout, metrics, nested, packages
from labelloom.plans.queries import LAST_LISTINGS, LAST_SCANS, LAST_SPANS, listings_, query, scans_, spans_
from labelloom.session import table

AS_OF = "2026-06-30"


# ---- declarations of pages and packs ----------------------------------------------------


def _pages(spark, d):
    s = spans_(spark, d).select("scan_id", "photo", "span_id", text.clean(F.col("text")).alias("text"), "x", "y", "w", "h", "confidence", "angle", "vertical")
    return declarations.declarations(s, AS_OF)


@query()
def e_page_declarations(spark, d):
    """Every field of every page, pass by pass (order-dependent reading; tested on fixtures and recorded dumps)."""
    return _pages(spark, d)


@query()
def e_pack_declarations(spark, d):
    """The surest reading of every field of every scan over its photos."""
    return declarations.of_packs(_pages(spark, d))


@query()
def k_context_photo(spark, d):
    """The photo of every scan on which most fields were read; its context is the pack's."""
    return packages.fullest_photo(_pages(spark, d), ["scan_id"], "photo", F.col("present"))


@query()
def n_listing_declarations(spark, d):
    """Listings as packs: their lines as a page, the title (without its quantity) as the common name where none is stated."""
    s = listings_(spark, d)
    lines = extraction.lines_of(s, "listing_id", "text").select(F.col("listing_id").cast("string").alias("scan_id"), F.lit(0).alias("photo"), F.col("line_no").cast("long").alias("span_id"), text.clean(F.col("line")).alias("text"))
    lines = lines.select("*", F.lit(10.0).alias("x"), (10.0 + 24.0 * F.col("span_id")).alias("y"), (8.0 * F.length("text")).alias("w"), F.lit(16.0).alias("h"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("angle"))
    read = declarations.declarations(lines, AS_OF).drop("photo")
    name = F.trim(F.regexp_replace("title", r"(?i)[0-9]+([.][0-9]+)?\s*(kg|g|gm|ml|l|ltr|litre)\b", ""))
    title = s.where("title is not null").select(F.col("listing_id").cast("string").alias("scan_id"), F.lit("common_name").alias("field_id"), F.nullif(name, F.lit("")).alias("named"))
    out = read.join(title, ["scan_id", "field_id"], "left")
    take = ~F.col("present") & F.col("named").isNotNull()
    return out.select(
        F.col("scan_id").cast("long").alias("listing_id"), "field_id", (F.col("present") | take).alias("present"), F.when(take, F.col("named")).otherwise(F.col("value_text")).alias("value_text"), "value_num", "unit",
        F.when(take, 0.75).otherwise(F.col("confidence")).alias("confidence"), F.when(take, "title").otherwise(F.col("how")).alias("how"),
    )


_NAME_SQL = "nullif(trim(regexp_replace(title, '(?i)[0-9]+([.][0-9]+)?\\s*(kg|g|gm|ml|l|ltr|litre)\\b', '', 'g')), '')"


@query(f"SELECT listing_id, {_NAME_SQL} AS common_name FROM {LAST_LISTINGS} WHERE {_NAME_SQL} IS NOT NULL")
def n_title_names(spark, d):
    name = F.nullif(F.trim(F.regexp_replace("title", r"(?i)[0-9]+([.][0-9]+)?\s*(kg|g|gm|ml|l|ltr|litre)\b", "")), F.lit(""))
    return listings_(spark, d).select("listing_id", name.alias("common_name")).where("common_name is not null")


# ---- words of listings as boxes ---------------------------------------------------------

_BOXES = f"""(SELECT listing_id, row_no, word_no, word, w, (10 + coalesce(sum(w+6) OVER (PARTITION BY listing_id, row_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE x, (10+row_no*24)::DOUBLE y
 FROM (SELECT *, greatest(6.0, length(word)*8.0)::DOUBLE w FROM (SELECT listing_id, row_no, generate_subscripts(a,1)-1 word_no, unnest(a) word FROM (SELECT listing_id, row_no, regexp_split_to_array(line, '\\s+') a FROM (SELECT * FROM (SELECT listing_id, generate_subscripts(a, 1) - 1 row_no, trim(unnest(a)) line FROM (SELECT listing_id, string_split(text, chr(10)) a FROM {LAST_LISTINGS} WHERE text IS NOT NULL)) WHERE line <> '')))))"""


def _word_boxes(spark, d):
    b = extraction.word_boxes(listings_(spark, d), "listing_id", "text")
    return b.select(F.col("listing_id").alias("scan_id"), F.lit(0).alias("photo"), (F.col("listing_id") * 1000000 + F.col("row_no") * 1000 + F.col("word_no")).alias("span_id"), F.col("word").alias("text"), "x", "y", "w", "h", F.lit(1.0).alias("confidence"), F.lit(0.0).alias("angle"))


@query(f"""SELECT listing_id * 1000000 + row_no * 1000 + word_no AS span_id, listing_id * 1000000 + row_no * 1000 + word_no + 1 AS neighbour_id, nx - x - w AS gap, 1 AS rank
FROM (SELECT *, lead(x) OVER (PARTITION BY listing_id, row_no ORDER BY word_no) nx FROM {_BOXES}) WHERE nx IS NOT NULL""")
def d_word_right(spark, d):
    """The word right of every word of the listings (boxes as laid out from the text)."""
    return layout.right_neighbours(_word_boxes(spark, d))


_TAG = "(^|[^a-z])(mrp|price)($|[^a-z])"


@query(f"""WITH b AS {_BOXES}, m AS (SELECT listing_id, row_no, word_no, try_cast(replace(regexp_extract(word, '^([0-9,]+([.][0-9]+)?)$', 1), ',', '') AS DOUBLE) v FROM b)
SELECT listing_id, v AS price FROM (SELECT b.listing_id, m.v, row_number() OVER (PARTITION BY b.listing_id ORDER BY b.row_no, b.word_no, m.word_no) rn FROM b JOIN m ON b.listing_id = m.listing_id AND b.row_no = m.row_no AND m.word_no > b.word_no
 WHERE regexp_matches(lower(b.word), '^rs[.]?$') AND m.v IS NOT NULL AND m.word_no = b.word_no + 1) WHERE rn = 1""")
def d_price_tokens(spark, d):
    """The first price of every listing that stands as a currency word with the nearest number right of it."""
    b = _word_boxes(spark, d)
    near = layout.right_neighbours(b)
    num = F.regexp_replace(F.regexp_extract("text", "^([0-9,]+([.][0-9]+)?)$", 1), ",", "").try_cast("double")
    tag = b.where(F.lower("text").rlike("^rs[.]?$")).select("span_id", F.col("scan_id").alias("listing_id"))
    value = b.select(F.col("span_id").alias("neighbour_id"), num.alias("price")).where("price is not null")
    hit = tag.join(near, "span_id").join(value, "neighbour_id")
    return hit.groupBy("listing_id").agg(F.min_by("price", F.struct("span_id", "neighbour_id")).alias("price"))


# ---- packs and products -----------------------------------------------------------------

_KEY = "CASE WHEN trim(barcode) <> '' THEN trim(barcode) WHEN b <> '' AND n <> '' AND q IS NOT NULL THEN b || '|' || n || '|' || CAST(q AS VARCHAR) || '|' || lower(trim(unit)) END"
_KEYED = f"(SELECT key_id, scan_id, brand, common_name, unit, q, coalesce(trim(barcode), '') <> '' AS sure, {_KEY} AS ident FROM (SELECT *, regexp_replace(lower(coalesce(brand,'')), '[^a-z0-9]+', '', 'g') b, regexp_replace(lower(coalesce(common_name,'')), '[^a-z0-9]+', '', 'g') n, CASE WHEN NOT isnan(net_quantity) THEN CAST(floor(net_quantity * 1000 + 0.5) AS BIGINT) END q FROM product_keys))"


def _keyed(spark, d):
    k = table(spark, d, "product_keys")
    q = F.when(~F.isnan("net_quantity"), F.floor(F.col("net_quantity") * 1000 + 0.5).cast("long"))
    code = F.nullif(F.trim("barcode"), F.lit(""))
    b, n = text.name_key(F.col("brand")), text.name_key(F.col("common_name"))
    attrs = F.when((b != "") & (n != "") & q.isNotNull(), F.concat_ws("|", b, n, q.cast("string"), F.lower(F.trim("unit"))))
    return k.select("key_id", "scan_id", "brand", "common_name", "unit", "net_quantity", code.isNotNull().alias("sure"), F.coalesce(code, attrs).alias("identity"))


@query(f"SELECT key_id, sure, ident AS identity FROM {_KEYED} WHERE ident IS NOT NULL")
def k_identities(spark, d):
    return _keyed(spark, d).where("identity is not null").select("key_id", "sure", "identity")


@query(f"SELECT ident AS identity, min(concat_ws(' ', brand, common_name, CAST(q AS VARCHAR), lower(trim(unit)))) AS label FROM {_KEYED} WHERE ident IS NOT NULL GROUP BY 1")
def k_labels(spark, d):
    k = _keyed(spark, d).where("identity is not null")
    return packages.product_label(k.select("key_id", "identity"), k.drop("identity"))


_CRAWLED = "(SELECT listing_id, ingested_at, CAST(floor(price*100+0.5) AS BIGINT) cents FROM listings WHERE listing_id IS NOT NULL AND price IS NOT NULL AND NOT isnan(price))"


def _crawled(spark, d):
    return table(spark, d, "listings").where("listing_id is not null and not isnan(price)").select("listing_id", "ingested_at", "price")


@query(f"SELECT listing_id, count(*) AS n_values, min(cents/100.0)::DOUBLE AS lo, max(cents/100.0)::DOUBLE AS hi, CAST(sum(k) AS BIGINT) AS n_rows FROM (SELECT listing_id, cents, count(ingested_at) k FROM {_CRAWLED} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1")
def k_differing_values(spark, d):
    """Listings that were crawled with more than one price."""
    return packages.differing_values(_crawled(spark, d), ["listing_id"], "price", "ingested_at")


@query(f"SELECT listing_id, string_agg(CAST(cents AS VARCHAR) || ' x ' || CAST(k AS VARCHAR), ', ' ORDER BY cents) AS prices, CAST(sum(k) AS BIGINT) AS n_rows, 0.9::DOUBLE AS confidence FROM (SELECT listing_id, cents, count(DISTINCT ingested_at) k FROM {_CRAWLED} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1")
def k_price_findings(spark, d):
    return packages.price_findings(_crawled(spark, d), ["listing_id"], "price", "ingested_at", F.lit(True))


_DECLARED = f"""(SELECT scan_id, d.v ->> '$.field_id' f, try_cast(d.v ->> '$.value' AS DOUBLE) n, coalesce(try_cast(d.v ->> '$.present' AS BOOLEAN), false) p FROM (SELECT scan_id, unnest(CASE json_type(j -> '$.declarations') WHEN 'ARRAY' THEN json_extract(j -> '$.declarations', '$[*]') ELSE [] END) v
 FROM (SELECT scan_id, CASE WHEN json_type(j0) = 'OBJECT' THEN j0 END j FROM (SELECT scan_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN CASE WHEN json_valid(payload::JSON ->> '$') THEN (payload::JSON ->> '$')::JSON END ELSE payload::JSON END END j0 FROM {LAST_SCANS}))) d WHERE json_type(d.v) = 'OBJECT')"""


def _declared(spark, d):
    r = nested.flatten_payloads(table(spark, d, "scans"), tags=["declaration"])
    v = F.from_json("record", "field_id string, value string, present boolean, source string, unit string")
    return r.select("scan_id", "pos", v.alias("r")).select("scan_id", "pos", "r.*", F.col("r.value").try_cast("double").alias("num"))


@query()
def k_stored_prices(spark, d):
    """Products with more than one stored price over all scans: identity from the typed keys, prices from the payloads."""
    price = _declared(spark, d).where("field_id = 'retail_sale_price' and coalesce(present, false) and num is not null").groupBy("scan_id").agg(F.max("num").alias("price"))
    k = _keyed(spark, d).where("identity is not null and scan_id is not null").select("identity", "sure", "scan_id").distinct()
    return packages.price_findings(k.join(price, "scan_id"), ["identity", "sure"], "price", "scan_id", F.col("sure"))


@query("""SELECT a.scan_id, a.key_id AS key_a, b.key_id AS key_b FROM (SELECT scan_id, key_id, q, lead(key_id) OVER w nk FROM (SELECT scan_id, key_id, CASE WHEN isnan(net_quantity) THEN NULL WHEN lower(unit) IN ('kg','l') THEN net_quantity*1000 WHEN lower(unit) IN ('g','ml') THEN net_quantity END q FROM product_keys WHERE scan_id IS NOT NULL) WHERE q IS NOT NULL WINDOW w AS (PARTITION BY scan_id ORDER BY key_id)) a
 JOIN (SELECT key_id, CASE WHEN isnan(net_quantity) THEN NULL WHEN lower(unit) IN ('kg','l') THEN net_quantity*1000 WHEN lower(unit) IN ('g','ml') THEN net_quantity END q FROM product_keys) b ON a.nk = b.key_id WHERE abs(a.q - b.q) > 0.01 * greatest(a.q, b.q)""")
def k_quantity_conflicts(spark, d):
    """Neighbouring views of one scan (in order of typing) whose contents differ by more than 1 %."""
    k = table(spark, d, "product_keys").where("scan_id is not null and not isnan(net_quantity)").select("scan_id", "key_id", text.base_quantity(F.col("net_quantity"), F.lower("unit")).alias("q")).where("q is not null")
    w = Window.partitionBy("scan_id").orderBy("key_id")
    k = k.withColumn("key_b", F.lead("key_id").over(w)).withColumn("q_b", F.lead("q").over(w))
    return k.where(F.abs(F.col("q") - F.col("q_b")) > 0.01 * F.greatest("q", "q_b")).select("scan_id", F.col("key_id").alias("key_a"), "key_b")


# ---- findings and views -----------------------------------------------------------------


@query("SELECT finding_id, outcome = 'VIOLATION' AS violation, outcome = 'INDETERMINATE' AS undecided, outcome = 'NOT_APPLICABLE' AS suppressed, outcome = 'VIOLATION' AND upper(trim(severity)) = 'CRITICAL' AS escalatable FROM findings")
def j_filters(spark, d):
    f = table(spark, d, "findings")
    o, s = F.col("outcome"), text.severity(F.col("severity"))
    return f.select("finding_id", (o == "VIOLATION").alias("violation"), (o == "INDETERMINATE").alias("undecided"), (o == "NOT_APPLICABLE").alias("suppressed"), ((o == "VIOLATION") & (F.upper(F.trim("severity")) == "CRITICAL") & (s.isNotNull() | F.col("severity").isNull())).alias("escalatable"))


_BUCKET = "CASE WHEN contains(l, 'not found') OR contains(l, 'missing') OR contains(l, 'absent') THEN 'missing' WHEN contains(l, ' mm') OR contains(l, 'height') OR contains(l, 'measure') THEN 'measure' ELSE 'by eye' END"


@query(f"SELECT scan_id, count(*) FILTER (WHERE b = 'missing') AS missing, count(*) FILTER (WHERE b = 'measure') AS measure, count(*) FILTER (WHERE b = 'by eye') AS by_eye FROM (SELECT scan_id, {_BUCKET} b FROM (SELECT scan_id, lower(coalesce(message, '')) l FROM findings WHERE outcome = 'INDETERMINATE')) GROUP BY 1")
def j_notes(spark, d):
    """What is open in every scan with undecided findings: nothing found, to be measured, or to be looked at."""
    low = F.lower(F.coalesce("message", F.lit("")))
    has = lambda *w: F.greatest(*(F.contains(low, F.lit(x)) for x in w))
    b = F.when(has("not found", "missing", "absent"), "missing").when(has(" mm", "height", "measure"), "measure").otherwise("by eye")
    f = table(spark, d, "findings").where("outcome = 'INDETERMINATE'").select("scan_id", b.alias("b"))
    return f.groupBy("scan_id").agg(F.count_if(F.col("b") == "missing").alias("missing"), F.count_if(F.col("b") == "measure").alias("measure"), F.count_if(F.col("b") == "by eye").alias("by_eye"))


_SIDE = "see (base|lid|cap|bottom|back|side|crimp|coding area)"


@query(f"SELECT scan_id, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '{_SIDE}', 1))))), ',') AS sides FROM {LAST_SPANS} WHERE regexp_matches(lower(text), '{_SIDE}') GROUP BY 1")
def j_capture_advice(spark, d):
    """Sides of packs that their own print refers to and that should be photographed too."""
    s = spans_(spark, d).where(F.lower("text").rlike(_SIDE))
    sides = s.select("scan_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_SIDE), F.lit(1))).alias("x")).distinct()
    return sides.groupBy("scan_id").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("sides"))


@query(f"SELECT scan_id, coalesce(photo,0) AS photo, count(*) FILTER (WHERE confidence >= 0.8 AND length(trim(text)) >= 3) AS good, count(*) FILTER (WHERE confidence >= 0.8 AND length(trim(text)) >= 3) < 3 AS retake FROM {LAST_SPANS} GROUP BY 1, 2")
def j_retakes(spark, d):
    """Photos of which fewer than three lines were read well."""
    good = F.count_if((F.col("confidence") >= 0.8) & (F.length(F.trim("text")) >= 3))
    return spans_(spark, d).groupBy("scan_id", F.coalesce("photo", F.lit(0)).alias("photo")).agg(good.alias("good"), (good < 3).alias("retake"))


@query(f"SELECT scan_id, inspector_id, image_path, verdict, n_violations FROM {LAST_SCANS} WHERE image_path IS NOT NULL")
def l_summaries(spark, d):
    return scans_(spark, d, "scan_id", "inspector_id", "image_path", "verdict", "n_violations").where("image_path is not null").select("scan_id", "inspector_id", "image_path", "verdict", "n_violations")


@query(f"SELECT (SELECT count(*) FROM {LAST_SCANS}) AS n_scans, (SELECT count(*) FROM findings) AS n_findings, (SELECT count(*) FROM actions) AS n_actions")
def l_totals(spark, d):
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(scans_(spark, d), "n_scans").crossJoin(n(table(spark, d, "findings"), "n_findings")).crossJoin(n(table(spark, d, "actions"), "n_actions"))


@query(f"""SELECT a.action_id, CASE WHEN s.scan_id IS NULL THEN 'no such scan' WHEN i.uid IS NULL THEN 'no such user' WHEN i.status <> 'active' THEN 'not active' WHEN a.action_taken = 'overridden' AND coalesce(trim(a.note), '') = '' THEN 'no reason' WHEN f.rule_id IS NULL THEN 'no such finding' ELSE 'ok' END AS state
FROM actions a LEFT JOIN (SELECT scan_id FROM {LAST_SCANS}) s USING (scan_id) LEFT JOIN inspectors i ON a.user_id = i.uid LEFT JOIN (SELECT DISTINCT scan_id, rule_id FROM findings) f ON a.scan_id = f.scan_id AND a.rule_id = f.rule_id""")
def l_action_states(spark, d):
    """Whether each appended action may stand: its scan, person, reason and finding exist."""
    a = table(spark, d, "actions")
    s = scans_(spark, d).select("scan_id", F.lit(1).alias("_s"))
    i = table(spark, d, "inspectors").select(F.col("uid").alias("user_id"), "status")
    f = table(spark, d, "findings").select("scan_id", "rule_id", F.lit(1).alias("_f")).distinct()
    j = a.join(s, "scan_id", "left").join(i, "user_id", "left").join(f, ["scan_id", "rule_id"], "left")
    reason = F.trim(F.coalesce("note", F.lit("")))
    state = F.when(F.col("_s").isNull(), "no such scan").when(F.col("status").isNull(), "no such user").when(F.col("status") != "active", "not active").when((F.col("action_taken") == "overridden") & (reason == ""), "no reason").when(F.col("_f").isNull(), "no such finding")
    return j.select("action_id", F.coalesce(state, F.lit("ok")).alias("state"))


# ---- scores -----------------------------------------------------------------------------

_FIELD_TRUTH = f"""(SELECT f, count(*) n, count(*) FILTER (WHERE p) found FROM {_DECLARED} WHERE f IS NOT NULL GROUP BY 1)"""


@query(f"SELECT f AS field_id, n, found, floor(found::DOUBLE / n * 10000 + 0.5) / 10000 AS share FROM {_FIELD_TRUTH}")
def m_field_counts(spark, d):
    """How often each field of the stored declarations was found."""
    x = _declared(spark, d).where("field_id is not null").groupBy("field_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("present", F.lit(False))).alias("found"))
    return x.select("field_id", "n", "found", metrics.rate(F.col("found"), F.col("n")).alias("share"))


@query(f"SELECT category, count(*) AS n, floor(avg(e) * 10000 + 0.5) / 10000 AS mean_cer FROM (SELECT s.category, levenshtein(a, b)::DOUBLE / length(a) e FROM (SELECT scan_id, category, regexp_replace(product_name, '\\s+', '', 'g') a FROM {LAST_SCANS} WHERE product_name IS NOT NULL) s JOIN (SELECT scan_id, regexp_replace(common_name, '\\s+', '', 'g') b FROM product_keys WHERE scan_id IS NOT NULL AND common_name IS NOT NULL) k USING (scan_id) WHERE length(a) > 0) GROUP BY 1")
def m_name_errors(spark, d):
    """Mean character error rate of typed names against the scans' names, per category."""
    s = scans_(spark, d).where("product_name is not null").select("scan_id", "category", "product_name")
    k = table(spark, d, "product_keys").where("scan_id is not null and common_name is not null").select("scan_id", "common_name")
    e = s.join(k, "scan_id").where(F.length(F.regexp_replace("product_name", r"\s+", "")) > 0).select("category", text.character_error_rate(F.col("product_name"), F.col("common_name")).alias("e"))
    return e.groupBy("category").agg(F.count("*").alias("n"), (F.floor(F.avg("e") * 10000 + 0.5) / 10000).alias("mean_cer"))


@query(f"""WITH r AS (SELECT s.category c, f.rule_id, f.outcome = 'VIOLATION' p, coalesce(a.t, false) t FROM findings f JOIN {LAST_SCANS} s USING (scan_id) LEFT JOIN (SELECT scan_id, rule_id, bool_or(action_taken = 'confirmed') t FROM actions GROUP BY 1, 2) a ON f.scan_id = a.scan_id AND f.rule_id = a.rule_id),
 c AS (SELECT c, count(*) FILTER (WHERE p AND t) tp, count(*) FILTER (WHERE p AND NOT t) fp, count(*) FILTER (WHERE NOT p AND t) fn FROM r GROUP BY ROLLUP (c))
SELECT c AS category, tp, fp, fn, floor(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END * 10000 + 0.5) / 10000 AS "precision", floor(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END * 10000 + 0.5) / 10000 AS recall FROM c""")
def m_by_configuration(spark, d):
    """Detection scores per configuration (here: the scans' category) and over all."""
    f, a = table(spark, d, "findings"), table(spark, d, "actions")
    t = a.groupBy("scan_id", "rule_id").agg(F.bool_or(F.col("action_taken") == "confirmed").alias("t"))
    r = f.join(scans_(spark, d).select("scan_id", "category"), "scan_id").join(t, ["scan_id", "rule_id"], "left").select("category", (F.col("outcome") == "VIOLATION").alias("p"), F.coalesce("t", F.lit(False)).alias("t"))
    return metrics.detection_scores(r, "category", "p", "t").select("category", "tp", "fp", "fn", "precision", "recall")


# ---- recogniser regions -----------------------------------------------------------------


@query(f"""SELECT scan_id, photo, floor(least(1.0, a) * 10000 + 0.5) / 10000 AS covered, a < 0.35 AS zoom FROM (SELECT scan_id, coalesce(photo,0) photo, (max(coalesce(x,0)+coalesce(w,0))-min(coalesce(x,0))) * (max(coalesce(y,0)+coalesce(h,0))-min(coalesce(y,0))) / (1500.0*2000.0) a FROM {LAST_SPANS} GROUP BY 1, 2)""")
def o_zoom(spark, d):
    """Photos whose text covers less than 35 % of the picture and should be read again from nearer."""
    return layout.zoom_candidates(spans_(spark, d), 1500.0, 2000.0)


@query(f"SELECT span_id FROM {LAST_SPANS} WHERE text IS NOT NULL AND NOT (coalesce(confidence, 0) >= 0.97 AND regexp_matches(text, '^[ -~]*$'))")
def o_second_reading(spark, d):
    """Lines for a second reading in Hindi: all but plain Latin ones that were read surely."""
    return spans_(spark, d).where(layout.wants_second_reading(F.col("text"), F.col("confidence"))).select("span_id")


@query(f"""SELECT span_id, rank FROM (SELECT span_id, row_number() OVER (PARTITION BY scan_id, coalesce(photo,0) ORDER BY coalesce(confidence,0), span_id) rank FROM {LAST_SPANS} WHERE coalesce(confidence,0) < 0.8) WHERE rank <= 20""")
def o_refine(spark, d):
    """The weakest lines of every photo, at most twenty, for another look (the limit is the feature)."""
    return layout.weakest(spans_(spark, d), 0.8, 20)


_BELOW = f"""WITH s AS (SELECT span_id, scan_id, coalesce(photo,0) photo, coalesce(x,0) x, coalesce(y,0) y, coalesce(w,0) w, coalesce(h,0) h FROM {LAST_SPANS}), p AS (SELECT a.span_id, b.span_id below_id, b.y-a.y-a.h gap FROM s a JOIN s b ON a.scan_id=b.scan_id AND a.photo=b.photo AND a.span_id<>b.span_id
 WHERE a.h>=1 AND b.h>=1 AND b.y>=a.y+a.h-0.5*a.h AND b.y-a.y-a.h<=1.2*a.h AND (abs(a.x-b.x)<=1.5*a.h OR least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x)>=0.5*least(a.w,b.w))),
 e AS (SELECT span_id, below_id FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY gap, below_id) rn FROM p) WHERE rn=1)"""


@query(f"""{_BELOW}, t AS (SELECT a.span_id, b.below_id FROM e a JOIN e b ON a.below_id = b.span_id WHERE b.below_id <> a.span_id)
SELECT span_id, 1 AS hop, below_id FROM e UNION ALL SELECT span_id, 2, below_id FROM t UNION ALL SELECT t.span_id, 3, e.below_id FROM t JOIN e ON t.below_id = e.span_id WHERE e.below_id <> t.span_id""")
def d_below_chains(spark, d):
    return layout.below_chains(spans_(spark, d)).select("span_id", "hop", "below_id")


@query()
def d_beside_vertical(spark, d):
    """Sideways lines stacked beside sideways lines (frontier search on one page)."""
    return layout.beside_vertical(spans_(spark, d))


@query(f"SELECT scan_id, photo, wide, tall, tall > wide AS turned FROM (SELECT scan_id, coalesce(photo,0) photo, CAST(sum(CASE WHEN coalesce(h,0)>=1.5*greatest(coalesce(w,0),1) THEN 0 ELSE length(trim(text)) END) AS BIGINT) wide, CAST(sum(CASE WHEN coalesce(h,0)>=1.5*greatest(coalesce(w,0),1) THEN length(trim(text)) ELSE 0 END) AS BIGINT) tall FROM {LAST_SPANS} WHERE length(trim(text))>=3 GROUP BY 1,2)")
def o_turned(spark, d):
    """Vote of the lines' shapes, weighted by their text, on whether a photo lies on its side."""
    return layout.page_orientation(spans_(spark, d)).select("scan_id", "photo", "wide", "tall", "turned")


@query(f"SELECT scan_id, photo, CASE WHEN abs(a) BETWEEN 10 AND 30 AND spread <= 3 THEN a ELSE 0 END AS tilt FROM (SELECT scan_id, coalesce(photo,0) photo, median(angle) a, max(angle)-min(angle) spread FROM {LAST_SPANS} WHERE length(trim(text))>=3 GROUP BY 1,2)")
def d_tilt(spark, d):
    return layout.page_orientation(spans_(spark, d)).select("scan_id", "photo", "tilt")


@query(f"SELECT scan_id, photo, CASE WHEN hi - lo <= 0.15 * m THEN floor(m * 1000 + 0.5) / 1000 END AS px_per_mm FROM (SELECT scan_id, coalesce(photo,0) photo, max(h)/2.5 hi, min(h)/2.5 lo, (max(h)/2.5 + min(h)/2.5)/2 m FROM {LAST_SPANS} WHERE h > 0 GROUP BY 1,2)")
def d_agreed_scales(spark, d):
    """A photo's scale from its highest and lowest line, were both 2.5 mm high: none where they disagree."""
    s = spans_(spark, d).where("h > 0").groupBy("scan_id", F.coalesce("photo", F.lit(0)).alias("photo")).agg((F.max("h") / 2.5).alias("hi"), (F.min("h") / 2.5).alias("lo"))
    k = geometry.agreed_scale(F.array("hi", "lo"))
    return s.select("scan_id", "photo", (F.floor(k * 1000 + 0.5) / 1000).alias("px_per_mm"))


@query(nested._UPTO + " SELECT scan_id, pos AS parent_pos, floor(try_cast(g ->> '$.cap_height_px' AS DOUBLE) / 12.0 * 10000 + 0.5) / 10000 AS mm, floor(0.5 / 12.0 * 10000 + 0.5) / 10000 AS uncertainty FROM (SELECT scan_id, pos, v -> '$.glyph' g FROM d) WHERE json_type(g) <> 'NULL' AND try_cast(g ->> '$.cap_height_px' AS DOUBLE) IS NOT NULL")
def d_glyph_heights(spark, d):
    """Heights of the measured glyphs at 12 pixels a millimetre."""
    g = nested.typed_table(nested.flatten_payloads(table(spark, d, "scans"), tags=["glyph"]), "glyph").where("cap_height_px is not null")
    r = lambda c: F.floor(F.col(c) * 10000 + 0.5) / 10000
    return g.select("scan_id", "parent_pos", geometry.glyph_height(F.col("cap_height_px"), F.lit(12.0)).alias("k")).select("scan_id", "parent_pos", r("k.mm").alias("mm"), r("k.uncertainty").alias("uncertainty"))


@query("SELECT key_id, 'brand' AS field_id, trim(brand) AS value FROM product_keys WHERE trim(brand) <> '' UNION ALL SELECT key_id, 'common_name', trim(common_name) FROM product_keys WHERE trim(common_name) <> '' UNION ALL SELECT key_id, 'unit', trim(unit) FROM product_keys WHERE trim(unit) <> ''")
def e_second_rows(spark, d):
    return extraction.second_reader_rows(table(spark, d, "product_keys"), "key_id", {"brand": "brand", "common_name": "common_name", "unit": "unit"})


@query(f"SELECT span_id FROM (SELECT span_id, text, coalesce(confidence,0) c, lag(text) OVER o pt, lag(coalesce(confidence,0)) OVER o pc FROM {LAST_SPANS} WHERE text IS NOT NULL WINDOW o AS (PARTITION BY scan_id, coalesce(photo,0) ORDER BY coalesce(y,0), coalesce(x,0), span_id)) WHERE c >= pc + 0.05 AND length(text) >= 0.6 * length(pt)")
def o_better_readings(spark, d):
    """The acceptance rule of second crops, between every line and the one before it."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    o = Window.partitionBy("scan_id", F.coalesce("photo", F.lit(0))).orderBy(z("y"), z("x"), "span_id")
    s = spans_(spark, d).where("text is not null").select("span_id", "text", z("confidence").alias("c"), F.lag("text").over(o).alias("pt"), F.lag(z("confidence")).over(o).alias("pc"))
    return s.where(layout.better_reading(F.col("pt"), F.col("pc"), F.col("text"), F.col("c"))).select("span_id")
