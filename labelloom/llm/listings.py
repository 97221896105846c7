"""Product listings that describe the same item (problem 3).

Method: standard identifiers (GTIN with a valid check digit), part numbers and attributes (brand,
goods words with their variant, dimension, content per unit, number of units) are extracted and
normalised. Listings are joined on reliable keys - the full set of attributes, one identifier, or
one part number of a brand - into connected components. The components are guarded as a whole:
an identifier whose attribute sets contradict each other in any attribute links only sets that
agree in all of them, and a component that came to contradict itself over several identifiers
falls back to the attribute keys.

What a word of a title is, is learned from the corpus by frequency and position, not from
lists: a word of the maker stands in labelled names of makers and, where a listing names
its maker, in that listing's own; sales talk stands in brackets and stars, or is no more frequent
among listings with the same maker, variant and content than elsewhere; a word of the shop stands in the
listing's own seller; every other word belongs to the goods. Misspelt words follow a far commoner neighbour (segment join), or one
that names goods of the same maker and content; words run together are split into two
commoner ones.

Scale: two passes over the rows, each row parsed where it stands; what is learned are partial
aggregates over distinct words and is joined back, so that nothing the corpus decides travels to
the driver and no list has a bound. Components run over attribute sets, not over listings,
so a hot product is one node.

Defined results: of rows with one listing_id the last ingested counts; a listing without
goods words or content links by identifier only; where no maker is found the key is all that is
left of the title; null title or text counts as empty; price, seller and platform play no role;
mentions of other sizes and other goods in the text are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.lookalikes import canonical_text
from labelloom.llm.names import _LISTS, _LONG, abbreviations, brand_core, evidence, fold, roots, same_pairs, segment_join
from labelloom.session import cut, table

#: A word is sales talk if this share of it stands in brackets, or if its share among listings of
#: one maker, variant and content is below the second figure (in at least so many comparisons).
BRACKETED, STICKY, COMPARED = 0.15, 0.2, 20
#: A word is the maker's if this share of it stands in titles of listings whose labelled maker has it.
OWN = 0.2
#: Greatest share of a slip beside the word it is a slip of, one and two edits away.
SLIP = (0.03, 0.015)
#: Two contents this near, of which one was converted, are one nominal content.
SNAP = 0.02

# Units and what they are in base units.
UNITS = {
    "kg": ("g", 1000.0), "kgs": ("g", 1000.0), "kilo": ("g", 1000.0), "kilogram": ("g", 1000.0), "kilograms": ("g", 1000.0), "g": ("g", 1.0), "gm": ("g", 1.0), "gms": ("g", 1.0), "gram": ("g", 1.0), "grams": ("g", 1.0), "mg": ("g", 0.001), "oz": ("g", 28.349523),
    "l": ("ml", 1000.0), "ltr": ("ml", 1000.0), "litre": ("ml", 1000.0), "litres": ("ml", 1000.0), "liter": ("ml", 1000.0), "ml": ("ml", 1.0), "millilitre": ("ml", 1.0), "millilitres": ("ml", 1.0), "cl": ("ml", 10.0), "fl oz": ("ml", 29.573530),
}
_NUM = r"(?:\d+(?:\.\d+)?|half|quarter|1/2|1/4|3/4)"
_SIZE = rf"({_NUM})\s*(fl\.?\s?oz|{'|'.join(sorted((u for u in UNITS if u != 'fl oz'), key=len, reverse=True))})\b\.?"
SIZE = re.compile(_SIZE)
COUNTS = [
    re.compile(rf"\b(\d+)\s*(?:x|\*|×)\s*{_SIZE}"), re.compile(rf"{_SIZE}\s*(?:x|\*|×)\s*(\d+)\b"), re.compile(r"\b(?:pack|set|case|box|bundle)\s+of\s+(\d+)\b"), re.compile(r"\b(\d+)\s*(?:pcs|pc|pieces|units|nos)\b"), re.compile(rf"\b(\d+)\s*n\b(?=\s*{_NUM})"),
]
# Words for numbers of units.
MULTIPLES = {"twin pack": 2, "twin": 2, "triple pack": 3, "triple": 3, "duo pack": 2, "quad pack": 4}
FRACTIONS = {"half": 0.5, "1/2": 0.5, "quarter": 0.25, "1/4": 0.25, "3/4": 0.75}
# How the lines that name an attribute begin.
BRAND_LINE = re.compile(r"^(?:brand(?: name)?|make|maker|manufacturer|marketed under the name)\s*(?:[:=-]\s*|\s)(.+)$")
VARIANT_LINE = re.compile(r"^(?:variant|flavour/fragrance|flavou?r|fragrance|scent|colou?r|type)\s*[:=-]\s*(.+)$")
CONTENT_LINE = re.compile(r"^(?:net|contents?|quantity|weight|volume|size|pack size)\b")
CARE = re.compile(r"@([a-z0-9-]+)\.")
GTIN = re.compile(r"(?<![\d-])(\d{12,14})(?![\d-])|(?:gtin|ean|upc|barcode|bar code)(?:-?\d+)?\W{0,3}(\d{8}|\d{12,14})(?!\d)")
PART = re.compile(r"\b(?:model|part|item|article|art|sku|mpn|ref|style)\.?\s*(?:no|number|code|id)?\.?\s*[:#=-]\s*([a-z0-9](?:[a-z0-9/.-]|[ ](?=\d)){2,24})")
# Words without a meaning of their own in titles.
STOP = {"with", "each", "by", "in", "of", "and", "for", "the", "a", "n", "pack", "from", "to", "s"}
# What a variant is called beside its name.
_KIND = re.compile(r"\b(?:variant|flavou?r|fragrance(?! free))\b")


def gtin_valid(code: str) -> bool:
    digits = [int(c) for c in reversed(code)]
    return sum(d * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10 == 0 and any(digits)


def sizes(text: str) -> list[tuple[str, float, bool]]:
    """(dimension, amount in base units, converted from another system) of each size in a text."""
    out = []
    for n, u in SIZE.findall(text):
        dim, f = UNITS[re.sub(r"\.?\s?oz", " oz", u) if u.startswith("fl") else u]
        v = (FRACTIONS[n] if n in FRACTIONS else float(n)) * f
        out.append((dim, round(v, 3), "oz" in u))
    return out


def units_of(text: str) -> int | None:
    for i, r in enumerate(COUNTS):
        if m := r.search(text):
            return int((m.groups()[-1] if i == 1 else m.group(1))[:9])
    for w, n in MULTIPLES.items():
        if re.search(rf"\b{w}\b", text):
            return n
    return None


def identifiers(lines: list[str]) -> list[str]:
    """Valid standard identifiers, filled to 14 digits, each once."""
    out = [g.zfill(14) for x in lines if "care" not in x for m in GTIN.finditer(x) if gtin_valid(g := m.group(1) or m.group(2))]
    return sorted(set(out))


def part_number(lines: list[str]) -> str | None:
    """The first labelled part number: letters and digits only, with at least one digit."""
    for x in lines:
        p = re.sub(r"[^a-z0-9]", "", m.group(1)) if (m := PART.search(x)) else ""
        if len(p) >= 3 and any(c.isdigit() for c in p):
            return p
    return None


def _lines(text: str | None) -> list[str]:
    return [x for x in (canonical_text(t, "en").strip().lower() for t in (text or "").split("\n")) if x]


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text)


def light(title: str | None, text: str | None, seller: str | None) -> dict:
    """What one listing says about itself without the corpus."""
    own = _lines(text)
    t = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", canonical_text(title or "", "en")).lower()
    brand = next((m.group(1) for x in own if (m := BRAND_LINE.match(x))), None) or next((m.group(1) for x in own if (m := CARE.search(x))), None)
    variant = next((m.group(1) for x in own if (m := VARIANT_LINE.match(x))), None)
    content = [x for x in own if CONTENT_LINE.match(x)]
    found = next((s[0] for s in (sizes(t), *(sizes(x) for x in content)) if s), None)
    counts = [n for n in (units_of(t), *(units_of(x) for x in content)) if n]
    rest = PART.sub(" | ", GTIN.sub(" | ", t))
    for r in (COUNTS[0], COUNTS[1], COUNTS[4], SIZE, *COUNTS[2:4]):
        rest = r.sub(" | ", rest)
    for w in MULTIPLES:
        rest = re.sub(rf"\b{w}\b", " | ", rest)
    rest = _KIND.sub(lambda m: " " * len(m[0]), rest)
    inside = [(m.start(), m.end()) for m in re.finditer(r"\([^()]*\)|\[[^\[\]]*\]|\*\*.+?\*\*", rest)]
    if by := re.search(r"\bby((?:\s+[^\s|]+){1,4})\s*$", rest):  # a name at the very end
        inside.append(by.span(1))
    at = [(m[0], next((k for k, (s, e) in enumerate(inside) if s <= m.start() < e), -1)) for m in re.finditer(r"[^\W_]+|\|", rest)]
    at = [(w, k) for w, k in at if w not in STOP]
    pairs = [f"{a} {b}" if a != "|" and b != "|" else None for (a, _), (b, _) in zip([("|", -1), *at], [*at, ("|", -1)])]
    both = [i == j >= 0 for (_, i), (_, j) in zip([("|", -1), *at], [*at, ("|", -1)])]
    words = [{"w": w, "apart": k >= 0, "left": pairs[i], "right": pairs[i + 1], "left_apart": both[i], "right_apart": both[i + 1]} for i, (w, k) in enumerate(at) if w != "|"]
    maker = _words(brand) if brand else []
    return {
        "core": (brand_core(maker, _LISTS, _LONG)[0] if maker else None) or None, "maker": sorted({fold(w) for w in maker}), "shop": sorted({fold(w) for w in _words(canonical_text(seller or "", "en"))}), "variant": [w for w in _words(_KIND.sub(" ", variant or "")) if w not in STOP],
        "dim": found[0] if found else None, "size": found[1] if found else None, "converted": bool(found and found[2]), "units": max(counts) if counts else 1,
        "gtins": identifiers([t, *own]), "part": part_number([t, *own]), "words": words,
    }


LIGHT = "listing_id long, core string, maker array<string>, shop array<string>, variant array<string>, dim string, size double, converted boolean, units int, gtins array<string>, part string, words array<struct<w:string,apart:boolean,left:string,right:string,left_apart:boolean,right_apart:boolean>>"


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    word = pa.struct([("w", pa.string()), ("apart", pa.bool_()), ("left", pa.string()), ("right", pa.string()), ("left_apart", pa.bool_()), ("right_apart", pa.bool_())])
    types = [pa.string(), strings, strings, strings, pa.string(), pa.float64(), pa.bool_(), pa.int32(), strings, pa.string(), pa.list_(word)]
    names = ["core", "maker", "shop", "variant", "dim", "size", "converted", "units", "gtins", "part", "words"]
    for b in batches:
        out = [light(*x) for x in zip(*(b.column(c).to_pylist() for c in ("title", "text", "seller")))]
        yield pa.RecordBatch.from_arrays([b.column("listing_id"), *(pa.array([o[n] for o in out], t) for n, t in zip(names, types))], names=["listing_id", *names])


def last_listings(listings: DataFrame) -> DataFrame:
    """One row per listing_id: the last ingested (ties by content)."""
    s = listings.where("listing_id is not null").select(F.col("listing_id").cast("long").alias("listing_id"), "title", "text", "seller", "ingested_at")
    at = F.coalesce(F.col("ingested_at").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800)))
    s = s.withColumn("_v", F.struct(at.alias("at"), F.xxhash64("title", "text", "seller").alias("h")))
    w = s.groupBy("listing_id").agg(F.max("_v").alias("_v"))
    return s.join(w, ["listing_id", "_v"], "left_semi").dropDuplicates(["listing_id"]).drop("_v")


def nominal(rows: DataFrame) -> DataFrame:
    """rows with contents converted from another system replaced by the nearest content stated by others within SNAP."""
    step = F.floor(F.log(F.greatest("size", F.lit(1e-6))) / SNAP).cast("long")
    stated = rows.where("not converted and size > 0").select("dim", F.col("size").alias("to")).distinct()
    stated = stated.withColumn("band", F.explode(F.array(*(F.floor(F.log("to") / SNAP).cast("long") + d for d in (-1, 0, 1)))))
    odd = rows.where("converted and size > 0").select("dim", "size").distinct().withColumn("band", step)
    near = odd.join(stated, ["dim", "band"]).where(F.abs(F.col("to") - F.col("size")) <= SNAP * F.col("size"))
    near = near.groupBy("dim", "size").agg(F.min_by("to", F.struct(F.abs(F.col("to") - F.col("size")), "to")).alias("to")).withColumn("converted", F.lit(True))
    return rows.join(near, ["dim", "size", "converted"], "left").withColumn("size", F.coalesce("to", "size")).drop("to", "converted")


def _spelt(tokens: DataFrame) -> DataFrame:
    """(w, root): the word each word of titles and variants is a slip of, itself if none; words run together are split (two rows)."""
    counts = cut(tokens.groupBy("w").agg(F.count("*").alias("n")).select(F.lit("").alias("scope"), "w", "n"))
    words = counts.where(F.length("w") <= 40)
    n = lambda c, m: counts.select(F.col("w").alias(c), F.col("n").alias(m))
    parts = words.where(F.length("w") >= 6).select("w", "n", F.explode(F.sequence(F.lit(3), F.length("w") - 3)).alias("i"))
    parts = parts.select("w", "n", F.expr("substring(w, 1, i)").alias("a"), F.expr("substring(w, i + 1)").alias("b"))
    parts = parts.join(n("a", "n_a"), "a").join(n("b", "n_b"), "b").where("n_a > n and n_b > n")
    parts = parts.groupBy("w").agg(F.max(F.struct(F.least("n_a", "n_b").alias("m"), "a", "b")).alias("m")).select("w", F.array("m.a", "m.b").alias("parts"))
    things = tokens.where("thing is not null").groupBy(F.lit("").alias("scope"), "w", "thing").agg(F.count("*").alias("n"))
    links = evidence(cut(segment_join(words, words, guard=True)), things)
    short = abbreviations(words, things)
    slip = lambda d, shared: (F.col("n_w") - 1 <= F.col("n_c") * F.when(d <= 1, SLIP[0]).otherwise(SLIP[1])) | (shared >= 0.5)
    root = roots(links, words, slip).select("w", "root")
    root = root.join(short.select("w", "c"), "w", "left").withColumn("root", F.when(F.col("root") == F.col("w"), F.coalesce("c", "w")).otherwise(F.col("root")))
    # what a slip or a shortening stands for may be shortened itself
    root = root.join(short.select(F.col("w").alias("root"), F.col("c").alias("further")), "root", "left").select("w", F.coalesce("further", "root").alias("root"))
    whole = counts.select("w").join(root, "w", "left").join(parts, "w", "left")
    return whole.select("w", F.explode(F.coalesce("parts", F.array(F.coalesce("root", "w")))).alias("root"))


def word_roles(tokens: DataFrame) -> DataFrame:
    """(root, role): maker, talk, goods, or both where a word of variants is sales talk as well.

    tokens: (root, apart, maker: a word of the listing's labelled maker or null, labelled: in a
    variant line, thing, sure: hash of maker, variant and content where all are labelled).
    """
    n = tokens.where("not labelled").groupBy("root").agg(
        F.count("*").alias("n"), F.count_if("apart").alias("n_apart"), F.count_if(F.col("maker")).alias("n_maker"), F.count_if(F.col("maker").isNotNull()).alias("n_known"),
        F.count_if(F.col("shop")).alias("n_shop"), F.count_if(F.col("shop").isNotNull()).alias("n_sold"),
    )
    variant = tokens.where("labelled").select("root", F.lit(True).alias("is_variant")).distinct()
    seen = tokens.where("sure is not null and not labelled").groupBy("sure", "root").agg(F.countDistinct("listing_id").alias("c"))
    size = tokens.where("sure is not null").groupBy("sure").agg(F.countDistinct("listing_id").alias("m")).where("m > 1")
    sticky = seen.join(size, "sure").groupBy("root").agg(F.sum(F.expr("c * (c - 1)")).alias("hits"), F.sum(F.expr("c * (m - 1)")).alias("compared"))
    r = n.join(variant, "root", "left").join(sticky, "root", "left")
    loose = (F.coalesce("compared", F.lit(0)) >= COMPARED) & (F.col("hits") < STICKY * F.col("compared"))
    apart = F.col("n_apart") >= BRACKETED * F.col("n")
    shop = (F.col("n_sold") > 0) & (F.col("n_shop") >= OWN * F.col("n_sold"))
    talk = F.col("is_variant").isNull() & (apart | loose | shop)
    maker = (F.col("n_known") > 0) & (F.col("n_maker") >= OWN * F.col("n_known"))
    return r.select("root", F.when(maker, "maker").when(talk, "talk").when(apart, "both").otherwise("goods").alias("role"))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cores = [brand_core(w, _LISTS, _LONG)[0] or None if w else None for w in b.column("names").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("names"), pa.array(cores, pa.string())], names=["names", "title_core"])


def attributes(listings: DataFrame) -> DataFrame:
    """(listing_id, brand, goods, dim, size, units, gtins, part) of each listing, all normalised; goods is a sorted array."""
    rows = cut(last_listings(listings).mapInArrow(_light, LIGHT))
    rows = cut(nominal(rows))
    sized = F.col("size").isNotNull()
    thing = F.when(sized & F.col("core").isNotNull(), F.xxhash64("core", "dim", "size", "units"))
    sure = F.when(sized & F.col("core").isNotNull() & (F.size("variant") > 0), F.xxhash64("core", F.array_sort("variant"), "dim", "size", "units"))
    each = rows.select("listing_id", "maker", "shop", "words", "variant", thing.alias("thing"), sure.alias("sure"))
    fold_udf = F.pandas_udf(lambda s: s.map(fold), "string")
    title = each.select("listing_id", "maker", "shop", "thing", "sure", F.explode("words").alias("z")).select("listing_id", "maker", "shop", "thing", "sure", "z.*", F.lit(False).alias("labelled"))
    none = F.lit(None).cast("string")
    said = each.select("listing_id", "maker", "shop", "thing", "sure", F.explode("variant").alias("w"), F.lit(False).alias("apart"), none.alias("left"), none.alias("right"), F.lit(False).alias("left_apart"), F.lit(False).alias("right_apart"), F.lit(True).alias("labelled"))
    tokens = cut(title.unionByName(said))
    spelt = cut(_spelt(tokens.select("w", "thing")))
    makers = rows.select(F.explode("maker").alias("m")).distinct()
    spelt = cut(spelt.withColumn("m", fold_udf("root")))
    tokens = tokens.withColumnRenamed("maker", "own").join(spelt, "w")
    # of a listing that names its maker: whether the word is the maker's; a word no maker has is none anywhere
    tokens = cut(tokens.select("listing_id", "root", "apart", "left", "right", "left_apart", "right_apart", "labelled", "thing", "sure", F.when(F.size("own") > 0, F.array_contains("own", F.col("m"))).alias("maker"), F.when(F.size("shop") > 0, F.array_contains("shop", F.col("m"))).alias("shop")))
    named = spelt.select("root", "m").distinct().join(makers, "m", "left_semi").select("root", F.lit(True).alias("named"))
    roles = word_roles(tokens).join(named, "root", "left")
    # words of makers that stand only in titles without a label
    unsure = tokens.where("not labelled").groupBy("root").agg(F.count_if(F.col("maker").isNotNull()).alias("k"))
    roles = roles.join(unsure, "root", "left").select("root", F.when(F.col("named") & (F.coalesce("k", F.lit(0)) == 0), "maker").when((F.col("role") == "maker") & F.col("named").isNull(), "goods").otherwise(F.col("role")).alias("role"))
    # a word of variants that is also one of sales talk is told by the two words it stands in
    two = tokens.where("right is not null").groupBy("right").agg(F.count("*").alias("n"), F.count_if("right_apart").alias("k")).where(F.col("k") >= BRACKETED * F.col("n")).select(F.col("right").alias("two"))
    two = cut(two)
    known = tokens.join(roles, "root", "left").join(two.select(F.col("two").alias("left"), F.lit(True).alias("l")), "left", "left").join(two.select(F.col("two").alias("right"), F.lit(True).alias("r")), "right", "left")
    role = F.when(F.col("labelled"), "goods").when((F.col("role") == "both") & (F.col("l") | F.col("r")), "talk").when(F.col("role") == "both", "goods").otherwise(F.coalesce("role", F.lit("goods")))
    sets = known.withColumn("role", role).groupBy("listing_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") == "goods", F.col("root")))).alias("goods"), F.array_sort(F.collect_set(F.when(F.col("role") == "maker", F.col("root")))).alias("names")
    )
    sets = cut(sets)
    cores = sets.where(F.size("names") > 0).select("names").distinct().mapInArrow(_cores, "names array<string>, title_core string")
    sets = sets.join(cores, "names", "left").select("listing_id", "goods", "title_core")
    parsed = rows.select("listing_id", "core", "dim", "size", "units", "gtins", "part").join(sets, "listing_id", "left")
    parsed = cut(parsed.withColumn("sure", F.col("core").isNotNull()).withColumn("core", F.coalesce("core", "title_core")).withColumn("goods", F.when(F.size("goods") > 0, F.col("goods"))).drop("title_core"))
    # a labelled name counts more than one from a title
    count = parsed.where("core is not null").groupBy("core").agg(F.sum(F.when(F.col("sure"), 5).otherwise(1)).alias("n"))
    count = cut(count.select(F.lit("").alias("scope"), F.col("core").alias("w"), "n"))
    things = parsed.where("core is not null and goods is not null").groupBy(F.lit("").alias("scope"), F.col("core").alias("w"), F.array_join("goods", " ").alias("thing")).agg(F.count("*").alias("n"))
    links = evidence(cut(segment_join(count, count, guard=True)), things)
    up = roots(links, count).select(F.col("w").alias("core"), F.col("root").alias("brand"))
    return parsed.join(up, "core", "left").drop("core", "sure")


PLAIN = ["brand", "dim", "size", "units"]


def _agree(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, hub goods g, bad): whether the attribute sets of a group contradict each other in any attribute."""
    spread = [F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in PLAIN]
    widest = F.max(F.struct(F.size(F.coalesce("goods", F.array().cast("array<string>"))).alias("k"), "goods"))["goods"]
    bad = spread[0]
    for x in spread[1:]:
        bad = bad | x
    return sets.groupBy(*by).agg(widest.alias("g"), bad.alias("bad"))


def _outside(goods: Column, hub: Column) -> Column:
    return F.coalesce(F.size(F.array_except(goods, hub)) > 0, F.lit(False))


def _contradictory(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by) of groups that contradict themselves; goods agree where one set of words holds the other."""
    a = _agree(sets, by)
    wide = sets.join(a, by).where(F.col("bad") | _outside(F.col("goods"), F.col("g")))
    return wide.select(*by).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of an undirected edge list (node, to): the least node wins; ends when nothing moves."""
    edges = cut(edges.unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct())
    label = cut(edges.select("node").distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        least = edges.join(label.withColumnRenamed("node", "to").withColumnRenamed("label", "l"), "to").groupBy("node").agg(F.min("l").alias("l"))
        nxt = label.join(least, "node").select("node", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("moved"))
        jump = nxt.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nxt = cut(nxt.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), "moved"))
        label = nxt.select("node", "label")
        if nxt.where("moved").isEmpty():
            break
    return label


def product_groups(listings: DataFrame) -> DataFrame:
    """(listing_id, product_id): guarded connected components over reliable keys."""
    a = attributes(listings)
    whole = F.col("goods").isNotNull() & F.col("size").isNotNull() & (F.col("brand").isNotNull() | (F.size("goods") > 1))
    key = F.xxhash64(F.coalesce("brand", F.lit("")), "goods", "dim", "size", "units")
    # a set without any identifier stays alone when it is not whole; others are told apart by their values
    loose = F.xxhash64(F.lit("loose"), *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in PLAIN), F.coalesce(F.array_join("goods", " "), F.lit("?")), "part", F.array_join("gtins", " "))
    ident = F.concat(F.transform("gtins", lambda g: F.concat(F.lit("g:"), g)), F.when(F.col("part").isNotNull() & F.col("brand").isNotNull(), F.array(F.concat(F.lit("p:"), "brand", F.lit(":"), "part"))).otherwise(F.array().cast("array<string>")))
    a = a.withColumn("ident", ident)
    node = F.when(whole, key).when(F.size("ident") > 0, loose).otherwise(F.xxhash64(F.lit("single"), "listing_id"))
    a = cut(a.withColumn("node", node))
    sets = cut(a.where(F.size("ident") > 0).select("node", *PLAIN, "goods", F.explode("ident").alias("ident")).distinct())
    bad = cut(_contradictory(sets, ["ident"]))
    good = sets.join(bad, "ident", "left_anti").groupBy("ident").agg(F.min("node").alias("to"))
    edges = sets.join(good, "ident").where("node <> to").select("node", "to")
    # an identifier that contradicts itself still joins the sets that agree in everything but words left out
    full = sets.join(bad, "ident", "left_semi").where(" and ".join(f"{c} is not null" for c in [*PLAIN, "goods"]))
    split = ["ident", *PLAIN]
    hub = full.groupBy(*split).agg(F.max(F.struct(F.size("goods").alias("k"), "goods", "node")).alias("h"))
    again = full.join(hub, split).where(~_outside(F.col("goods"), F.col("h.goods")) & (F.col("node") != F.col("h.node"))).select("node", F.col("h.node").alias("to"))
    label = components(cut(edges.unionByName(again)))
    # the guard of the whole: what contradicts itself over several identifiers falls back to its keys
    torn = _contradictory(sets.drop("ident").distinct().join(label, "node"), ["label"])
    label = label.join(torn, "label", "left_anti")
    return a.join(label, "node", "left").select("listing_id", F.coalesce("label", "node").alias("product_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_pairs(cut(product_groups(table(spark, sf_dir, "listings"))), "listing_id", ["product_id"])


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(listing_id, product_id, n_links): the product of each listing and its number of links."""
    g = cut(product_groups(table(spark, sf_dir, "listings")))
    n = g.groupBy("product_id").agg((F.count("*") - 1).alias("n_links"))
    return g.join(n, "product_id").select("listing_id", "product_id", "n_links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
