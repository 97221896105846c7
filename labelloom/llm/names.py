"""Variant spellings of names typed by people (problem 1).

Method: pigeonhole segment join. A name's words are folded (case, doubled letters, sounds that
are written in several ways); a folded word of at most k plain edits from another shares one of
k+1 segments with it, at a position shifted by at most k. Segments of all words form an inverted
index, probed with the position-shifted substrings of each word. Segments of words of up to SHORT letters
would be so short that one key holds a share of all words; such words meet in what is left of them
when up to k letters are taken out, which for k edits (a swap of neighbours is one) some such rest of
both always is. Candidates are verified with an edit distance banded by k. The join runs three times: words of goods against the
vocabulary of frequent words, brand cores against each other, and, for names whose words ran
together, whole goods names inside one brand. Words the vocabulary lacks, and names that hold
such words, are then joined with each other inside their brand.

Shortened words of goods are learned: a word whose letters stand in the same order in a commoner
one, and which stands beside the same words, is short for it. Shortened kinds of business follow from
rules. Given names, legal forms and regional words for goods are published lists.

A variant joins the most frequent spelling in reach (a star, not a chain: the root must itself
be in reach), guarded by frequency: two spellings that are both common stay apart.

Scale: words, cores and goods names are aggregated before they are joined; an index key is nearly a whole
word, or (segment number, length, substring of four letters and more), so no group of one brand meets as a whole; only the vocabulary of goods
words, of bounded size, and the fixed word lists reach the driver.

Defined results: a row with a null brand or common_name links to nothing; names without a
letter or digit neither; repeated rows of one key are one; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.lookalikes import canonical_text
from labelloom.session import cut, table

#: Most frequent words of goods names that count as vocabulary.
VOCABULARY = 3000
#: A spelling this many times rarer than a neighbour is a slip of it and no word of the vocabulary.
SLIPS = 12

#: Words of up to this many letters are joined by what is left without one or two letters, longer ones by segments.
SHORT = 16

#: A spelling this rare beside a neighbour one or two edits away is a slip of it; else this share of its rows must fit.
RARE, SHARED = (0.5, 0.25), 0.5

# Words that come before or after a firm's name and say nothing about it.
TITLES = "the shri sri shree shrii sh smt messrs ms".split()
LEGAL = "pvt private ltd limited llp p inc corp plc gmbh".split()
# Kinds of business as firms write them out; how they are shortened follows from rules (see _short_of).
BUSINESS = (
    "agencies agro bakery beverages brothers care chemicals company consumer cosmetics dairy daughters distributors enterprises exports farm farms foods group healthcare herbals home homecare imports industries international "
    "kitchen laboratories marketing mills motors naturals oils organics paints papers pharma plastics products services solutions sons spices stores sweets technologies textiles traders trading wellness works and"
).split()
# Given names with their common short and pet forms.
GIVEN = {
    "william": "will bill billy willy liam", "theodore": "ted teddy theo", "robert": "rob bob bobby robbie bert", "elizabeth": "liz lizzie beth betty eliza bess", "richard": "rick dick richie ricky", "margaret": "peggy maggie meg marge greta",
    "jonathan": "jon johnny nathan jonny", "lakshminarayan": "laxmi lachhu narayan lakshmi", "dorothy": "dottie dolly dot dora", "katherine": "kate kitty kathy katie kat", "rajendra": "raj raju rajen", "alexander": "alex lex sandy al", "james": "jim jimmy jamie",
    "charles": "charlie chuck chas", "edward": "ed eddie ned", "thomas": "tom tommy", "michael": "mike mick mickey", "joseph": "joe joey", "samuel": "sam sammy", "benjamin": "ben benny", "daniel": "dan danny", "anthony": "tony", "andrew": "andy drew", "christopher": "chris kit",
    "matthew": "matt", "patrick": "pat paddy", "henry": "harry hank", "frederick": "fred freddie", "susan": "sue susie", "rebecca": "becky becca", "victoria": "vicky tori", "jennifer": "jen jenny", "patricia": "patty trish", "deborah": "deb debbie", "eleanor": "ellie nell nora",
    "isabella": "bella izzy", "abigail": "abby gail", "suresh": "suri", "venkatesh": "venky venkat", "subramaniam": "subbu mani", "krishnamurthy": "krishna murthy", "ramachandran": "ram chandran",
}
# Hindi and other regional words for goods and their usual English.
GOODS = {
    "haldi": "turmeric", "besan": "chickpea flour", "aloo": "potato", "lal mirch": "chilli", "mirch": "chilli", "desi ghee": "clarified butter", "ghee": "clarified butter", "tel": "oil", "talc": "talcum powder", "wafers": "chips", "cookies": "biscuits", "preserve": "jam", "cold drink": "soft drink",
    "nutri nuggets": "soya chunks", "nuggets": "soya chunks", "t paste": "toothpaste", "tooth paste": "toothpaste", "for": "", "of": "",
}


def fold(word: str) -> str:
    """One spelling for sounds that are written in several ways."""
    w = word.lower()
    for a, b in (("ph", "f"), ("ck", "k")):
        w = w.replace(a, b)
    w = re.sub("e{2,}", "i", re.sub("o{2,}", "u", w))
    w = w.translate(str.maketrans("cqwyz", "kkvis"))
    w = w[:1] + w[1:].replace("h", "")
    return re.sub(r"(.)\1+", r"\1", w)


def edits(a: str, b: str, k: int) -> int:
    """Edit distance (a swap of neighbours counts once) inside a band of k; k+1 if beyond."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [k + 1] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            c = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, now[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, before[j - 2] + 1)
            now[j] = c
        if min(now) > k:
            return k + 1
        before, row = row, now
    return min(row[-1], k + 1)


def reach(n: int) -> int:
    """Edits allowed for a folded word of n letters."""
    return 0 if n <= 3 else 1 if n <= 5 else 2


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k+1 segments of a word of n letters, as even as possible."""
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def plain_edits(n: int) -> int:
    """Plain edits the pigeonholes are cut for: a swap of neighbours is two of them."""
    return min(2 * reach(n), max(0, n - 1))


def without(w: str, k: int) -> set[str]:
    """w, and what is left of it when up to k letters are taken out."""
    out = last = {w}
    for _ in range(k):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def _indexed(w: str) -> set[str]:
    if len(w) <= SHORT:
        return without(w, k) if (k := reach(len(w))) else set()
    return {f"{i}:{len(w)}:{w[at : at + size]}" for i, (at, size) in enumerate(segments(len(w), plain_edits(len(w))))}


def _probes(w: str) -> set[str]:
    """Rests for the short words in reach, and for the long ones substrings that can equal a segment: edits before
    segment i shift it by at most i, edits after it by at most k-i, and both shifts add up to the difference of the lengths."""
    if not (r := reach(len(w))):
        return set()
    keys = without(w, r) if len(w) - r <= SHORT else set()
    for n in range(max(SHORT + 1, len(w) - r), len(w) + r + 1):
        k, d = plain_edits(n), len(w) - n
        for i, (at, size) in enumerate(segments(n, k)):
            lo, hi = max(at - i, at + d - (k - i), 0), min(at + i, at + d + (k - i), len(w) - size)
            for start in range(lo, hi + 1):
                keys.add(f"{i}:{n}:{w[start : start + size]}")
    return keys


def _expand(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # a word has many keys
                part = b.slice(at, 1000)
                keys = [list(make(w)) for w in part.column("w").to_pylist()]
                of = pa.array([i for i, ks in enumerate(keys) for _ in ks], pa.int32())
                rest = [part.column(c).take(of) for c in ("scope", "w", "n")]
                yield pa.RecordBatch.from_arrays([rest[0], pa.array([k for ks in keys for k in ks], pa.string()), *rest[1:]], names=["scope", "seg", "w", "n"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(s, a, c, d) for s, a, c in zip(*(b.column(x).to_pylist() for x in ("scope", "w", "c"))) if (d := edits(a, c, r := min(reach(len(a)), reach(len(c))))) <= r]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["scope", "w", "c", "d"])


def segment_join(probe: DataFrame, index: DataFrame, guard: bool = False) -> DataFrame:
    """(scope, w, c, d): words w of ``probe`` and c of ``index`` (both: scope, w[, n]) in reach of each other.

    With ``guard`` only pairs from a rarer w to a commoner c (ties by spelling) are verified, by the counts n.
    """
    schema = "scope string, seg string, w string, n long"
    given = lambda df: df.select("scope", "w", F.col("n").cast("long") if "n" in df.columns else F.lit(0).cast("long").alias("n"))
    at = F.xxhash64("scope", "seg").alias("at")
    left = given(probe).mapInArrow(_expand(_probes), schema).select(at, "scope", "w", F.col("n").alias("n_w"))
    right = given(index).mapInArrow(_expand(_indexed), schema).select(at, "scope", F.col("w").alias("c"), F.col("n").alias("n_c"))
    pairs = left.join(right, ["at", "scope"]).where("w <> c")
    if guard:
        pairs = pairs.where(_upward())
    # two swaps of neighbours are four plain edits
    near = pairs.where(F.levenshtein("w", "c", 4) >= 0).select("scope", "w", "c").distinct()
    return near.mapInArrow(_verified, "scope string, w string, c string, d int")


def _upward():
    """Links lead to the neighbour that is first in (count, spelling)."""
    return (F.col("n_c") > F.col("n_w")) | ((F.col("n_c") == F.col("n_w")) & (F.col("c") < F.col("w")))


def _may_link(d, shared):
    """A spelling joins a commoner neighbour if it is rare beside it, or most of its rows name things the neighbour has too.

    Both are shares, the same at every size. One or two rows say too little against a link; that only adds links.
    """
    rare = F.col("n_w") <= F.col("n_c") * F.when(d <= 1, RARE[0]).otherwise(RARE[1])
    return _upward() & (rare | (shared >= SHARED) | (F.col("n_w") <= 2))


def evidence(links: DataFrame, things: DataFrame) -> DataFrame:
    """links with ``shared``: the share of w's rows whose thing is named with c as well. things: (scope, w, thing, n)."""
    mine = links.select("scope", "w", "c").join(things, ["scope", "w"])
    theirs = things.select("scope", F.col("w").alias("c"), "thing", F.lit(1).alias("hit"))
    share = mine.join(theirs, ["scope", "c", "thing"], "left").groupBy("scope", "w", "c").agg((F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("shared"))
    return links.join(share, ["scope", "w", "c"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))


def _skeleton(c: str):
    """First letter and the consonants after it, doubled ones once."""
    return F.regexp_replace(F.concat(F.substring(c, 1, 1), F.regexp_replace(F.expr(f"substring({c}, 2)"), "[aeiou]", "")), r"(.)\1", "$1")


def abbreviations(words: DataFrame, things: DataFrame, least: float = 0.25) -> DataFrame:
    """(w, c, shared): words w that shorten a commoner word c and name the same things.

    w has the first letter of c and its other letters in c's order, and is the beginning of c, has all
    its consonants, its first three, or its first two and the last; ``shared`` is the share of w's things that are named with
    c as well. words: (scope, w, n), things: (scope, w, thing, n), of one scope.
    """
    s = words.where(F.length("w") >= 3).select("w", "n", _skeleton("w").alias("k"))
    key = lambda kind, *parts: F.xxhash64(F.lit(kind), F.concat(*parts))
    three = F.when(F.length("k") >= 3, key("3", F.substring("k", 1, 3)))
    ends = F.when(F.length("k") >= 4, key("e", F.substring("k", 1, 2), F.substring("k", -1, 1)))
    probe = s.select("w", F.col("n").alias("n_w"), F.explode(F.array_compact(F.array(key("b", "w"), key("k", "k"), three, ends))).alias("key"))
    starts = F.transform(F.sequence(F.lit(3), F.length("w") - 1), lambda i: key("b", F.substring(F.col("w"), F.lit(1), i)))
    index = s.where(F.length("w") >= 4).select(F.col("w").alias("c"), F.col("n").alias("n_c"), F.explode(F.array_compact(F.concat(starts, F.array(key("k", "k"), three, ends)))).alias("key"))
    # the letters of w in order in c: p is the place behind the last one found
    inside = F.expr("aggregate(split(w, ''), 1, (p, x) -> if(p = 0 or x = '', p, if(locate(x, c, p) = 0, 0, locate(x, c, p) + 1))) > 0")
    pairs = probe.join(index, "key").where("n_c > n_w and length(c) > length(w)").select("w", "c", "n_c").distinct().where(inside)
    seen = evidence(pairs.select(F.lit("").alias("scope"), "w", "c", "n_c"), things).where(F.col("shared") >= least)
    return seen.groupBy("w").agg(F.max(F.struct("shared", "n_c", "c")).alias("m")).select("w", "m.c", "m.shared")


def roots(links: DataFrame, counts: DataFrame, may_link=_may_link) -> DataFrame:
    """(scope, w, root): each word's most frequent spelling in reach, guarded by frequency.

    links: (scope, w, c, d, shared); counts: (scope, w, n). The nearest neighbour wins, then the most
    frequent; paths upward are followed to their end by pointer jumping.
    """
    n_w = counts.select("scope", "w", F.col("n").alias("n_w"))
    n_c = counts.select("scope", F.col("w").alias("c"), F.col("n").alias("n_c"))
    up = links.join(n_w, ["scope", "w"]).join(n_c, ["scope", "c"]).where(_upward() & may_link(F.col("d"), F.col("shared")))
    near = up.groupBy("scope", "w").agg(F.min(F.struct("d", (-F.col("n_c")).alias("m"), "c")).alias("b")).select("scope", "w", F.col("b.c").alias("p"))
    near = cut(near)  # only words that link; the others are their own root
    while True:  # two jumps a round, as most paths are short
        hop = near.select("scope", F.col("w").alias("p"), F.col("p").alias("q"))
        far = near.join(hop, ["scope", "p"], "left").select("scope", "w", F.coalesce("q", "p").alias("p"))
        far = cut(far.join(hop, ["scope", "p"], "left").select("scope", "w", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("more")))
        near = far.drop("more")
        if far.where("more").isEmpty():
            break
    return counts.select("scope", "w").join(near, ["scope", "w"], "left").select("scope", "w", F.coalesce("p", "w").alias("root"))


_LISTS: dict[str, tuple[str, str]] = {}
for _w in TITLES:
    _LISTS[fold(_w)] = ("title", "")
for _w in LEGAL:
    _LISTS[fold(_w)] = ("legal", "")
for _w in BUSINESS:
    _LISTS[fold(_w)] = ("business", _w)
for _full, _short in GIVEN.items():
    for _w in [_full, *_short.split()]:
        _LISTS.setdefault(fold(_w), ("given", _full))
# plain and folded spellings of the longer words, for slips
_LONG = [(fold(w), w, _LISTS[fold(w)]) for w in [*BUSINESS, *(x for full, short in GIVEN.items() for x in [full, *short.split()]), "limited", "private", "shri", "shree"] if len(w) >= 4]


def _short_of(w: str, full: str) -> bool:
    """w shortens a kind of business: same first letter, its other letters in order, and either its
    beginning, or consonants only but for one vowel or its last letters."""
    if not 2 <= len(w) < len(full) or w[0] != full[0] or len(full) < 4:
        return False
    if full.startswith(w):
        return len(w) >= 3 or full == "company"
    rest = iter(full[1:])
    if not all(c in rest for c in w[1:]):
        return False
    return sum(c in "aeiou" for c in w[1:].rstrip("s")) <= (1 if len(w) > 3 else 0)


_FIRM: dict[str, tuple[str, str] | None] = {}


def _firm_word(w: str, lists: dict, long: list) -> tuple[str, str] | None:
    if w not in _FIRM:
        if len(_FIRM) > 200_000:
            _FIRM.clear()  # a memo, no list
        _FIRM[w] = _firm_kind(w, lists, long)
    return _FIRM[w]


def _firm_kind(w: str, lists: dict, long: list) -> tuple[str, str] | None:
    f = fold(w)
    if f in lists:
        return lists[f]
    if len(w) == 1:
        return ("business", "") if w in "tn" else None  # T. Co., Sons n Daughters
    if w in ("hc", "cp"):
        return ("business", "")  # initials of two kinds
    if len(w) <= 7:
        for full in BUSINESS:
            if full[0] == w[0] and _short_of(w, full):
                return ("business", full)
    if len(w) >= 4:
        for i in _long_near(w, f, long):
            g, plain, kind = long[i]
            if len(plain) == 4 and len(w) == 4 and sorted(w) == sorted(plain) and edits(w, plain, 1) <= 1:
                return kind  # two letters swapped
            if len(plain) >= 5:
                k = 2 if len(plain) >= 8 else 1
                if edits(w, plain, k) <= k or (len(g) >= 6 and edits(f, g, 1) <= 1):
                    return kind
    return None


_NEAR: dict[tuple[str, str], list[int]] = {}  # made by each worker


def _long_near(w: str, f: str, long: list) -> list[int]:
    """Places in the list of longer words that may be within one or two edits, in order."""
    if not _NEAR:
        for i, (g, plain, _) in enumerate(long):
            for kind, rests in (("4", {"".join(sorted(plain))} if len(plain) == 4 else ()), ("w", without(plain, 2 if len(plain) >= 8 else 1) if len(plain) >= 5 else ()), ("f", without(g, 1) if len(plain) >= 5 and len(g) >= 6 else ())):
                for r in rests:
                    _NEAR.setdefault((kind, r), []).append(i)
    most = max(len(plain) for _, plain, _ in long) + 2
    keys = [("4", "".join(sorted(w)))] if len(w) == 4 else []
    keys += [("w", r) for r in without(w, 2 if len(w) >= 6 else 1)] if len(w) <= most else []
    keys += [("f", r) for r in without(f, 1)] if len(f) <= most else []
    return sorted({i for k in keys for i in _NEAR.get(k, ())})


_BARE: dict[str, tuple[str, list[str]]] = {}


def _bare(core: str, long: list) -> tuple[str, list[str]]:
    """A core without what ran together with it (kinds of business, given names or titles), and these kinds."""
    if core not in _BARE:
        if len(_BARE) > 200_000:
            _BARE.clear()  # a memo, no list
        own, kinds, cutting = core, [], True
        while cutting and len(own) > 9:
            cutting = False
            for g, _, k in long:
                if len(g) >= 4 and len(own) - len(g) >= 5 and k[0] in ("business", "given", "legal"):
                    if own.endswith(g):
                        own, cutting = own[: -len(g)], True
                        kinds.append(k[1])
                    elif own.startswith(g):
                        own, cutting = own[len(g) :], True
                    if cutting:
                        break
        _BARE[core] = own, kinds
    return _BARE[core]


def brand_core(words: list[str], lists: dict, long: list) -> tuple[str, str]:
    """(folded own part of a firm's name, its kind of business)."""
    own, kinds, given = [], [], []
    for w in words:
        f = fold(w)
        if not f or f == "s":
            continue
        k = _firm_word(w, lists, long)
        if k is None:
            own.append(f)
        elif k[0] == "business":
            kinds.append(k[1])
        elif k[0] == "given":
            given.append(k[1])
    if len(own) > 1:
        own = [x for x in own if len(x) > 1] or own
    core = fold("".join(own))
    core, cut_off = _bare(core, long)
    kinds += cut_off
    if core.startswith("sri") and len(core) >= 8:
        core = core[3:]  # a title run together with the name
    if not core:
        core = fold("".join(given + kinds))
    return core, (kinds[0] if kinds else "")


def goods_words(words: list[str], fixes: dict[str, str], known: set[str]) -> list[str]:
    """Canonical words of a goods name in typed order; unknown ones folded and marked."""
    out: list[str] = []
    i = 0
    words = [fixes.get(w, w) for w in words]
    words = [x for w in words for x in w.split()]
    while i < len(words):
        two = " ".join(words[i : i + 2])
        if len(words) > i + 1 and two in GOODS:
            out += GOODS[two].split()
            i += 2
            continue
        w = words[i]
        if w in GOODS:
            out += GOODS[w].split()
        elif w in known:
            out.append(w)
        else:
            out.append("?" + fold(w))
        i += 1
    return out


def _tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column("key_id")]
        for c in ("brand", "common_name"):
            words = [re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", canonical_text(t, "en")).lower().replace("'", "")) if t is not None else [] for t in b.column(c).to_pylist()]
            cols.append(pa.array(words, pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays(cols, names=["key_id", "b", "n"])


def _vocabulary(words: DataFrame) -> list[str]:
    """Goods words, most frequent first: rare in brands, one of each folded form, and no slip of a far more frequent word."""
    fold_udf = F.pandas_udf(lambda s: s.map(fold), "string")
    w = words.where("n_name >= 3 and n_brand * 2 <= n_name and length(w) >= 3").where(~F.col("w").rlike("^[0-9]+$") & ~F.col("w").isin(list(GOODS)))
    w = w.select("w", F.col("n_name").alias("n"), fold_udf("w").alias("f"))
    w = cut(w.groupBy("f").agg(F.max(F.struct("n", "w")).alias("m")).select("f", "m.w", "m.n"))
    # plain and folded forms in one join, told apart by the scope
    form = w.select(F.explode(F.array(F.struct(F.lit("w").alias("scope"), F.col("w")), F.struct(F.lit("f").alias("scope"), F.col("f").alias("w")))).alias("x"), "n").select("x.scope", "x.w", "n")
    near = cut(segment_join(form, form, guard=True))
    n = lambda c: w.select(F.lit("f").alias("scope"), F.col("f").alias(c), F.col("w").alias(f"w_{c}"))
    near = near.join(n("w"), ["scope", "w"], "left").join(n("c"), ["scope", "c"], "left").select(F.coalesce("w_w", "w").alias("w"), F.coalesce("w_c", "c").alias("c"))
    counts = w.select("w", "n")
    slips = near.join(counts, "w").join(counts.select(F.col("w").alias("c"), F.col("n").alias("n_c")), "c").where(F.col("n_c") >= SLIPS * F.col("n")).select("w").distinct()
    rows = w.join(slips, "w", "left_anti").orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()  # bounded
    n_of = {r["w"]: r["n"] for r in rows}
    # two words run together are no word
    return [x for x in n_of if not any(n_of.get(x[:i], 0) > n_of[x] and n_of.get(x[i:], 0) > n_of[x] for i in range(3, len(x) - 2))]


def spellings(vocabulary: list[str]) -> dict[str, str]:
    """Folded and plain spellings of vocabulary and fixed words, and what they stand for."""
    out: dict[str, str] = {}
    for w in vocabulary:
        out.setdefault(fold(w), w)
        out.setdefault(w, w)
    for w, v in GOODS.items():
        if " " not in w:
            out.setdefault(fold(w), v)
            out.setdefault(w, v)
        else:
            out.setdefault(fold(w.replace(" ", "")), v)
    return out


class _Splitter:
    """Words that are two words of the vocabulary run together, with at most one slip in all."""

    def __init__(self, known: dict[str, str]) -> None:
        self.known, self.near = known, {}
        for i, g in enumerate(known):
            for r in without(g, 1) if len(g) >= 3 else ():
                self.near.setdefault(r, []).append((i, g))

    def _slip(self, y: str) -> str | None:
        hits = {x for r in without(y, 1) for x in self.near.get(r, ())}
        return min((x for x in hits if edits(y, x[1], 1) <= 1), default=(0, None))[1]

    def of(self, w: str) -> str | None:
        known = self.known
        parts = {i: (fold(w[:i]), fold(w[i:])) for i in range(2, len(w) - 1)}
        for i, (a, b) in parts.items():
            if a in known and b in known and min(i, len(w) - i) > 2:
                return f"{known[a]} {known[b]}"
        for i in range(3, len(w) - 2):
            a, b = parts[i]
            for x, y, flip in ((a, b, False), (b, a, True)):
                if x in known and len(y) >= 3 and (near := self._slip(y)):
                    pair = (known[x], known[near])
                    return " ".join(reversed(pair) if flip else pair)
        return None


def _resolve(vocabulary: list[str]):
    """Per row: brand core, goods words and the goods name in one, with swapped fields put right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(vocabulary)
        folded = spellings(vocabulary)
        split, made = _Splitter(folded), {}
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for key, brand, name, found in zip(*(b.column(c).to_pylist() for c in ("key_id", "b", "n", "fix"))):
                sides, found = [], dict(found or [])
                for words in (brand, name):
                    fixes = {}
                    for w in words:
                        if w in known or w in GOODS:
                            continue
                        if (f := fold(w)) in folded:
                            fixes[w] = folded[f]
                        elif w in found:
                            fixes[w] = found[w]
                        else:
                            if w not in made:
                                if len(made) > 200_000:
                                    made.clear()  # a memo, no list
                                made[w] = (split.of(w) if len(w) >= 6 else None) or ""
                            if made[w]:
                                fixes[w] = made[w]
                    goods = goods_words(words, fixes, known)
                    sides.append((words, goods, sum(not g.startswith("?") for g in goods) / max(1, len(goods))))
                (wb, gb, sb), (wn, gn, sn) = sides
                if sb > sn and sb >= 0.5:
                    (wb, gn) = (wn, gb)
                # loose letters of one word: "gevi rili"
                core, _ = brand_core(wb, _LISTS, _LONG)
                if len(gn) > 1 and sum(g.startswith("?") for g in gn) > 1:
                    gn = _rejoined(gn, folded)
                if core and gn:
                    for c, v in zip(cols, (key, core, " ".join(sorted({x for g in gn for x in g.split()})), "".join(g.lstrip("?") for g in gn))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["key_id", "core", "goods_key", "squashed"])

    return run


def _rejoined(goods: list[str], folded: dict[str, str]) -> list[str]:
    """Two unknown neighbours that are one known word with a gap inside."""
    out: list[str] = []
    for g in goods:
        if out and out[-1].startswith("?") and g.startswith("?") and (w := folded.get(fold(out[-1][1:] + g[1:]))):
            out[-1] = w
        else:
            out.append(g)
    return out


def linked_names(keys: DataFrame) -> DataFrame:
    """(key_id, brand_id, goods_id): rows with equal ids mean the same brand and the same goods."""
    rows = keys.select(F.col("key_id").cast("long").alias("key_id"), "brand", "common_name").where("key_id is not null and brand is not null and common_name is not null").dropDuplicates(["key_id"])
    rows = cut(rows.mapInArrow(_tidy, "key_id long, b array<string>, n array<string>"))
    each = rows.select(F.explode("b").alias("w"), F.lit(1).alias("is_b")).unionByName(rows.select(F.explode("n").alias("w"), F.lit(0).alias("is_b")))
    words = cut(each.groupBy("w").agg(F.sum("is_b").alias("n_brand"), F.sum(1 - F.col("is_b")).alias("n_name")))
    short = cut(shortened(rows, words))
    vocabulary = _vocabulary(words.join(short.select("w"), "w", "left_anti"))
    spark = keys.sparkSession
    if not vocabulary:
        vocabulary = ["-"]
    # slips of goods words, by the segment join against the vocabulary
    index = spark.createDataFrame([(v, f, i) for i, (f, v) in enumerate(spellings(vocabulary).items()) if len(f) >= 4], "v string, f string, rank int")
    fold_udf = F.pandas_udf(lambda s: s.map(fold), "string")
    odd = words.join(F.broadcast(index.select(F.col("f").alias("w"))), "w", "left_anti").select("w", fold_udf("w").alias("f"))
    # a word is tried as typed and folded
    odd = odd.select("w", F.explode(F.array_distinct(F.array("w", "f"))).alias("f"))
    odd = cut(odd.where(F.length("f") >= 4))
    hits = segment_join(odd.select(F.lit("").alias("scope"), F.col("f").alias("w")).distinct(), index.select(F.lit("").alias("scope"), F.col("f").alias("w")))
    hits = hits.join(F.broadcast(index.select(F.col("f").alias("c"), "v", "rank")), "c")
    best = hits.groupBy("w").agg(F.min(F.struct("d", "rank", "v")).alias("b")).select(F.col("w").alias("f"), "b", F.col("b.v").alias("v"))
    fixes = odd.join(best, "f").groupBy("w").agg(F.min(F.struct("b", "v")).alias("m"))
    fixes = fixes.select("w", "m.v").join(short.select("w"), "w", "left_anti")
    fixes = fixes.unionByName(short.select("w", F.col("c").alias("v")))
    found = rows.select("key_id", F.explode(F.array_distinct(F.concat("b", "n"))).alias("w")).join(fixes, "w").groupBy("key_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("fix"))
    parts = cut(rows.join(found, "key_id", "left").mapInArrow(_resolve(vocabulary), "key_id long, core string, goods_key string, squashed string"))
    named = cut(parts.groupBy("core", "goods_key", "squashed").agg(F.count("*").alias("n")))
    # brand cores against each other
    things = named.groupBy(F.lit("").alias("scope"), F.col("core").alias("w"), F.col("goods_key").alias("thing")).agg(F.sum("n").alias("n"))
    cores = cut(things.groupBy("scope", "w").agg(F.sum("n").alias("n")))
    links = evidence(cut(segment_join(cores, cores, guard=True)), things)
    up = roots(links, cores).select(F.col("w").alias("core"), F.col("root").alias("brand_id"))
    spelt = named.join(up, "core").groupBy("brand_id", "goods_key", "squashed").agg(F.sum("n").alias("n"))
    # goods names with words still unknown, whole and inside one brand
    names = cut(_commonest(spelt, "goods_key", "squashed"))
    unknown = names.where(F.col("goods_key").contains("?"))
    probe = unknown.select(F.col("brand_id").alias("scope"), F.col("squashed").alias("w")).distinct()
    target = names.where(~F.col("goods_key").contains("?")).select(F.col("brand_id").alias("scope"), F.col("squashed").alias("w"), "goods_key", "n")
    near = segment_join(probe, target.select("scope", "w").distinct())
    same = probe.join(target.select("scope", "w").distinct(), ["scope", "w"]).select("scope", "w", F.col("w").alias("c"), F.lit(0).alias("d"))
    near = near.unionByName(same).join(target.select("scope", F.col("w").alias("c"), F.col("goods_key").alias("to"), "n"), ["scope", "c"])
    near = near.groupBy("scope", "w").agg(F.min(F.struct("d", (-F.col("n")).alias("m"), "to")).alias("b"))
    moved = cut(unknown.join(near.select(F.col("scope").alias("brand_id"), F.col("w").alias("squashed"), "b"), ["brand_id", "squashed"]).select("brand_id", "goods_key", F.col("b.to").alias("to")))
    rest = cut(spelt.where(F.col("goods_key").contains("?")).join(moved.select("brand_id", "goods_key"), ["brand_id", "goods_key"], "left_anti"))
    to = moved.unionByName(_rare_names(rest))
    ids = named.select("core", "goods_key").distinct().join(up, "core").join(to, ["brand_id", "goods_key"], "left").select("core", "goods_key", "brand_id", F.coalesce("to", "goods_key").alias("goods_id"))
    return parts.select("key_id", "core", "goods_key").join(ids, ["core", "goods_key"]).select("key_id", "brand_id", "goods_id")


def _commonest(spelt: DataFrame, key: str, as_: str) -> DataFrame:
    """(brand_id, key, n, as_): the rows of each name, and its commonest spelling (ties by spelling)."""
    best = F.min(F.struct((-F.col("n")).alias("m"), "squashed"))["squashed"]
    one = spelt.groupBy("brand_id", key, "squashed").agg(F.sum("n").alias("n"))
    return one.groupBy("brand_id", key).agg(F.sum("n").alias("n"), best.alias(as_))


def shortened(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(w, c): words of goods names that are short for another word, learned from the words they stand beside.

    rows: (key_id, n: words of the goods name), words: (w, n_name). A shortening stands beside the words its
    full form stands beside; shortenings of shortenings lead to the full word.
    """
    each = rows.where(F.size("n") >= 2).select("key_id", F.explode(F.array_distinct("n")).alias("w"))
    beside = each.join(each.select("key_id", F.col("w").alias("thing")), "key_id").where("w <> thing").groupBy(F.lit("").alias("scope"), "w", "thing").agg(F.count("*").alias("n"))
    counts = words.where("n_name > 0").select(F.lit("").alias("scope"), "w", F.col("n_name").alias("n"))
    found = cut(abbreviations(counts, cut(beside), least=SHARED).select("w", "c"))
    up = found.select(F.col("w").alias("c"), F.col("c").alias("d"))
    return found.join(up, "c", "left").select("w", F.coalesce("d", "c").alias("c"))


def _rare_names(rest: DataFrame) -> DataFrame:
    """(brand_id, goods_key, to) of names that hold words the vocabulary lacks: these words, and then the whole names, against those of the same brand.

    rest: (brand_id, goods_key, squashed, n).
    """
    odd = cut(rest.select(F.col("brand_id").alias("scope"), F.explode(F.split("goods_key", " ")).alias("g"), "n").where(F.col("g").startswith("?")).groupBy("scope", F.expr("substring(g, 2)").alias("w")).agg(F.sum("n").alias("n")))
    up = roots(segment_join(odd, odd, guard=True).withColumn("shared", F.lit(0.0)), odd).where("w <> root")
    up = up.select(F.col("scope").alias("brand_id"), F.concat(F.lit("?"), "w").alias("g"), F.concat(F.lit("?"), "root").alias("root"))
    better = rest.select("brand_id", "goods_key").distinct().withColumn("g", F.explode(F.split("goods_key", " "))).join(up, ["brand_id", "g"]).groupBy("brand_id", "goods_key").agg(F.map_from_entries(F.collect_list(F.struct("g", "root"))).alias("m"))
    words = F.transform(F.split("goods_key", " "), lambda g: F.when(F.col("m").isNull(), g).otherwise(F.coalesce(F.col("m")[g], g)))
    rest = cut(rest.join(better, ["brand_id", "goods_key"], "left").select("brand_id", "goods_key", "squashed", "n", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("name")))
    names = cut(_commonest(rest, "name", "w"))
    whole = cut(names.groupBy(F.col("brand_id").alias("scope"), "w").agg(F.sum("n").alias("n"), F.max(F.struct("n", "name"))["name"].alias("key")))
    key = lambda c: whole.select("scope", F.col("w").alias(c), F.filter(F.split("key", " "), lambda g: ~g.startswith("?")).alias(f"known_{c}"))
    # names with known words of their own on both sides are different goods, however near
    links = segment_join(whole, whole, guard=True).join(key("w"), ["scope", "w"]).join(key("c"), ["scope", "c"])
    links = links.where((F.size(F.array_except("known_w", "known_c")) == 0) | (F.size(F.array_except("known_c", "known_w")) == 0))
    root = roots(links.select("scope", "w", "c", "d", F.lit(0.0).alias("shared")), whole)
    to = root.join(whole.select("scope", F.col("w").alias("root"), F.col("key").alias("to")), ["scope", "root"]).select(F.col("scope").alias("brand_id"), "w", "to")
    return rest.select("brand_id", "goods_key", "name").distinct().join(names.join(to, ["brand_id", "w"]).select("brand_id", "name", "to"), ["brand_id", "name"]).select("brand_id", "goods_key", "to")


def same_pairs(ids: DataFrame, key: str, by: list[str]) -> DataFrame:
    """All pairs (smaller key first) of rows that agree on ``by``; the result is the pairs."""
    a = ids.select(*by, F.col(key).alias(f"{key}_a"))
    b = ids.select(*by, F.col(key).alias(f"{key}_b"))
    return a.join(b, by).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_pairs(cut(linked_names(table(spark, sf_dir, "product_keys"))), "key_id", ["brand_id", "goods_id"])


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_id, brand_id, goods_id, n_links): the class of each row and the number of its links."""
    ids = cut(linked_names(table(spark, sf_dir, "product_keys")))
    n = ids.groupBy("brand_id", "goods_id").agg((F.count("*") - 1).alias("n_links"))
    return ids.join(n, ["brand_id", "goods_id"]).select("key_id", "brand_id", "goods_id", "n_links")


QUERIES = {"p1_found": p1_found, "p1_links": p1_links}
