"""One form for visually identical text (problem 2).

Method: a vocabulary trie is traversed with a weighted edit automaton in which look-alikes,
ignorable characters, separate accents and compatibility forms cost nothing; a token that reaches a
vocabulary word takes its spelling (the most frequent one), every other token is normalised by table.
Letters that are only nearly alike (Greek rho for p, Armenian, Cherokee and Coptic letters, small
capitals) are in the automaton alone: the vocabulary has to confirm them. The vocabulary holds the
ordinary tokens of the corpus itself by language, most frequent first, up to the documented
bound VOCABULARY; a token beyond the bound is treated by table.

Scale: lines of plain ASCII in a Latin language never leave the JVM; the vocabulary is one
partial aggregate; no line is shuffled but for the choice of a re-sent row's last version.

Defined results: null and empty texts have no suspects and stay as they are; of rows with one
span_id the last ingested counts; an unknown or null language is judged by the letters of the line.
Devanagari letters with a nukta have two spellings that are both proper: they are no suspects, and
come out as letter and nukta where Unicode composes none, else as the composed letter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import table

VOCABULARY = 50_000

# Letters drawn alike, other script first, Latin second.
CYRILLIC_LATIN = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҮY ԌG ԚQ ԜW"
GREEK_LATIN = "οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX Ϲc"
OTHER_LATIN = "ɡg ɑa ıi KK ÅÅ"
LATIN_CYRILLIC = "aа eе oо pр cс yу xх AА BВ EЕ KК MМ HН OО PР CС TТ YУ XХ ëё ËЁ"
GREEK_CYRILLIC = "οо ΑА ΒВ ΕЕ ΚК ΜМ ΗН ΟО ΡР ΤТ ΧХ"
LATIN_GREEK = "oο vν AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ óό"
CYRILLIC_GREEK = "оο АΑ ВΒ ЕΕ КΚ МΜ НΗ ОΟ РΡ ТΤ ХΧ"
# Marks drawn like an ordinary ASCII mark.
MARKS = {"\u2010": "-", "\u2011": "-", "\u2215": "/", "\u2044": "/", "\u2024": ".", "\u201a": ",", "\ua789": ":", "\u2236": ":", "\u037e": ";", "\u02d0": ":"}
# Gaps other than U+0020, and characters that are not drawn.
GAPS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_IGNORED = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Further ranges of characters that are not drawn (fillers, variation selectors, tags, deprecated marks).
_IGNORED_RANGES = ((0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
IGNORABLE = frozenset(_IGNORED) | {chr(c) for a, b in _IGNORED_RANGES for c in range(a, b + 1)}
# Letters nearly alike, the other letter first; only a word of the vocabulary confirms them.
NEAR_LATIN = (
    "ρp υu τt ιi κk ηn ωw γy χx αa εe σo օo ոn սu հh զq ցg ԁd ⲟo ⲥc ⲣp ⲭx Ⲁa ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ ᴀa ʙb ᴄc ᴅd ᴇe ɢg ʜh ɪi ᴊj ᴋk ʟl ᴍm ɴn ᴏo ᴘp ʀr ꜱs ᴛt ᴜu ᴠv ᴡw ʏy ᴢz ɩi кk тt мm нh вb п​n гr".replace("\u200b", "")
)
NEAR_CYRILLIC = "kк tт mм hн bв nп rг uи ᴋк ᴛт ᴍм ʜн ʙв κк τт μм ηп αа εе ρр χх σо υу"
NEAR_GREEK = "pρ uυ tτ iι kκ nη wω yγ xχ aα eε рρ тτ кκ хχ аα еε ᴋκ ᴛτ"
LANGUAGES = {"en": "LATIN", "fr": "LATIN", "ru": "CYRILLIC", "el": "GREEK", "hi": "DEVANAGARI"}


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


TO = {
    "LATIN": _pairs(CYRILLIC_LATIN) | _pairs(GREEK_LATIN) | _pairs(OTHER_LATIN),
    "CYRILLIC": _pairs(LATIN_CYRILLIC) | _pairs(GREEK_CYRILLIC),
    "GREEK": _pairs(LATIN_GREEK) | _pairs(CYRILLIC_GREEK),
    "DEVANAGARI": {},
}
NEAR = {"LATIN": _pairs(NEAR_LATIN), "CYRILLIC": _pairs(NEAR_CYRILLIC), "GREEK": _pairs(NEAR_GREEK), "DEVANAGARI": {}}
JOINERS = "\u200c\u200d"


def _script(c: str) -> str | None:
    o = ord(c)
    if not c.isalpha() and unicodedata.category(c)[0] != "M":
        return None
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "LATIN"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "GREEK"
    if 0x400 <= o < 0x530:
        return "CYRILLIC"
    if 0x900 <= o < 0x980:
        return "DEVANAGARI"
    return None


def _compat(c: str) -> str:
    """Width, ligature, letter-like and mathematical forms of ASCII; others stay."""
    o = ord(c)
    if o in (0x212A, 0x212B, 0x2126):
        return unicodedata.normalize("NFC", c)
    if 0xFF01 <= o <= 0xFF5E:
        return chr(o - 0xFEE0)
    if 0xFB00 <= o <= 0xFB06 or 0x2160 <= o <= 0x217F or 0x1D400 <= o <= 0x1D7FF or 0xFFE8 <= o <= 0xFFEE:
        n = unicodedata.normalize("NFKC", c)
        return n if n.isascii() else c
    return c


def _shaping(text: str, i: int) -> bool:
    """A joiner directly after a virama shapes a conjunct and is text."""
    return text[i] in JOINERS and i > 0 and unicodedata.combining(text[i - 1]) == 9


def _drop(text: str) -> str:
    return "".join(c for i, c in enumerate(text) if c not in IGNORABLE or _shaping(text, i))


def _composed(text: str) -> str:
    """Canonical composition outside Devanagari, whose composed letters are excluded from it."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text
    return "".join(x if any("ऀ" <= c < "ঀ" for c in x) else unicodedata.normalize("NFC", x) for x in re.findall(r"[ऀ-ॿ]+|[^ऀ-ॿ]+", text))


def line_script(text: str, lang: str | None) -> str:
    """The language's script, unless the line's unmistakable letters are all of others."""
    named = LANGUAGES.get(lang)
    if named and (text.isascii() or named != "LATIN"):
        return named
    seen: dict[str, int] = {}
    for c in text:
        s = _script(c)
        if s and not any(c in TO[k] for k in ("LATIN", "CYRILLIC", "GREEK") if k != s):
            seen[s] = seen.get(s, 0) + 1
    if named in seen or not seen:
        return named or "LATIN"
    return max(seen, key=lambda k: (seen[k], k == "LATIN"))


def _marks(text: str, i: int) -> int:
    """How many combining marks follow the character at i."""
    k = i + 1
    while k < len(text) and unicodedata.combining(text[k]) not in (0, 9):
        k += 1
    return k - i - 1


class Trie:
    """Vocabulary trie; each node keeps the best word that ends there."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.root: dict = {}
        self.words = {w for w, _ in words}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            if n > node.get("", (None, -1))[1]:
                node[""] = (word, n)
        self.classes: dict[str, dict[str, str]] = {}
        for script in TO:
            classes: dict[str, str] = {}
            for to in (TO[script], NEAR[script]):
                for a, b in to.items():
                    classes[a] = "".join(dict.fromkeys(classes.get(a, a) + b))
            self.classes[script] = classes

    def canonical(self, token: str, script: str = "LATIN", budget: float = 0.0) -> str | None:
        """The cheapest vocabulary word; look-alikes, ignorables and separate accents are free, others cost 1."""
        classes = self.classes[script]
        states = [(0.0, 0, self.root)]
        best: tuple[float, int, str] | None = None
        done = set()
        while states:
            cost, i, node = states.pop()
            if (id(node), i, cost) in done:
                continue
            done.add((id(node), i, cost))
            if i == len(token):
                if "" in node and (best is None or (cost, -node[""][1]) < best[:2]):
                    best = (cost, -node[""][1], node[""][0])
                continue
            c = token[i]
            if c in IGNORABLE and not _shaping(token, i):
                states.append((cost, i + 1, node))
                continue
            marks = _marks(token, i)
            readings = dict.fromkeys([c, *classes.get(c, ""), _compat(c)])
            if marks:  # a letter and its accents are one step
                tail = token[i + 1 : i + 1 + marks]
                readings = dict.fromkeys(unicodedata.normalize("NFC", r + tail) for r in readings)
            for r in readings:
                nxt = node
                for d in r:
                    nxt = nxt.get(d)
                    if nxt is None:
                        break
                if nxt is not None:
                    states.append((cost, i + 1 + marks, nxt))
            if cost + 1 <= budget:
                states += [(cost + 1, i + 1 + marks, nxt) for d, nxt in node.items() if d and d not in readings]
        return best[2] if best else None


def _confirmed(token: str, script: str, trie: Trie | None) -> str | None:
    """The vocabulary's spelling of a token, if it is one of the script; words that stand so themselves stay."""
    if trie is None or script == "DEVANAGARI" or token in trie.words:
        return None
    word = trie.canonical(token, script)
    return word if word is not None and {s for c in word if (s := _script(c))} <= {script} else None


def _token(token: str, script: str, trie: Trie | None) -> str:
    t = _composed("".join(_compat(MARKS.get(c, c)) for c in _drop(token)))
    scripts = {s for c in t if (s := _script(c))}
    if scripts <= {script} and not any(c in TO[script] or c in NEAR[script] for c in t):
        if t != token and (word := _confirmed(token, script, trie)) is not None:
            return word
        return t
    to = TO.get(script, {})
    # letters that only this script has, or only another
    own = any(_script(c) == script for c in t)
    other = [c for c in t if _script(c) not in (None, script)]
    if script == "DEVANAGARI" or (other and any(c not in to for c in other)):
        # a word of this script with some letters of others, which the vocabulary confirms
        if own and (word := _confirmed(token, script, trie)) is not None:
            return word
        if "LATIN" in scripts and len(scripts) > 1 and all(c in TO["LATIN"] for c in t if _script(c) not in (None, "LATIN", "DEVANAGARI")):
            script, to = "LATIN", TO["LATIN"]
        else:
            return t  # properly written in another script
    elif script in ("CYRILLIC", "GREEK") and not own and (any(c.isdigit() for c in t) or (len(other) > 1 and t.isascii() and t.isupper()) or t.islower() and t in _UNITS):
        return t  # a code or a unit
    if (word := _confirmed(token, script, trie)) is not None:
        return word
    return "".join(to.get(c, c) for c in t)


# Unit symbols that stay Latin in any language.
_UNITS = {"g", "kg", "mg", "ml", "l", "cl", "mm", "cm", "m", "kcal", "oz"}


def canonical_text(text: str, lang: str | None, trie: Trie | None = None) -> str:
    """The one form of a line; equal to the line exactly if nothing in it is a look-alike."""
    script = line_script(text, lang)
    if script == "LATIN" and text.isascii():
        return text
    spaced = "".join(" " if c in GAPS else c for c in text)
    if spaced.isascii() and script in ("LATIN", "DEVANAGARI"):
        return spaced
    return " ".join(_token(t, script, trie) if t else t for t in spaced.split(" "))


def one_spelling(text: str) -> str:
    """Devanagari letters with a nukta in their one form; other text stays."""
    return text if text.isascii() else re.sub("[\u0900-\u097f]+", lambda m: unicodedata.normalize("NFC", m[0]), text)


def last_rows(spans: DataFrame) -> DataFrame:
    """One row per span_id: the last ingested (ties by content)."""
    keep = [c for c in spans.columns if c != "span_id"]
    order = F.struct(F.coalesce(F.col("ingested_at").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("_at"), F.xxhash64(*keep).alias("_h"))
    s = spans.where("span_id is not null").withColumn("_v", order)
    w = s.groupBy("span_id").agg(F.max("_v").alias("_v"))
    return s.join(w, ["span_id", "_v"], "left_semi").dropDuplicates(["span_id"]).drop("_v")


def vocabulary(spans: DataFrame, bound: int = VOCABULARY) -> list[tuple[str, int]]:
    """Frequent tokens that are ordinary in their language (at most ``bound`` of them)."""
    native = {"en": r"^[!-~]+$", "fr": r"^[!-~À-ſ]+$", "ru": r"^[А-яЁё]+$", "el": r"^[Ͱ-Ͽ]+$"}
    rule = F.lit(False)
    for lang, pattern in native.items():
        rule = rule | ((F.col("lang") == lang) & F.col("w").rlike(pattern))
    words = spans.where("text is not null").select("lang", F.explode(F.split("text", " ")).alias("w")).where(rule & (F.length("w").between(2, 40)))
    top = words.groupBy("w").count().where("count >= 3").orderBy(F.desc("count"), "w").limit(bound)
    return [(r[0], r[1]) for r in top.collect()]


def _suspects(words: list[tuple[str, int]], with_text: bool):
    names = ["span_id", "text"] if with_text else ["span_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(words)
        known: dict[tuple[str, str | None], str] = {}
        for b in batches:
            ids, out = [], []
            for i, text, lang in zip(b.column("span_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist()):
                key = (text, lang)
                if (form := known.get(key)) is None:
                    form = canonical_text(text, lang, trie)
                    if len(known) < 50_000:
                        known[key] = form
                spelt = one_spelling(form) if with_text else form
                if spelt != text:
                    ids.append(i)
                    out.append(spelt)
            cols = [pa.array(ids, pa.int64())] + ([pa.array(out, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _screened(spans: DataFrame) -> DataFrame:
    """Lines that can hold a suspect: any character beyond ASCII, or Latin letters elsewhere."""
    s = spans.select(F.col("span_id").cast("long").alias("span_id"), "text", "lang", "ingested_at")
    s = last_rows(s).where("text is not null")
    return s.where(F.col("text").rlike(r"[^\x00-\x7e]") | F.col("lang").isin("ru", "el"))


def suspects(spans: DataFrame) -> DataFrame:
    """(span_id) of lines with a character that only looks ordinary."""
    return _screened(spans).mapInArrow(_suspects(vocabulary(spans), False), "span_id long")


def canonical_spans(spans: DataFrame) -> DataFrame:
    """(span_id, text, changed): every line in its one form."""
    changed = _screened(spans).mapInArrow(_suspects(vocabulary(spans), True), "span_id long, text string")
    changed = changed.withColumnRenamed("text", "form")
    s = last_rows(spans.select(F.col("span_id").cast("long").alias("span_id"), "text", "ingested_at"))
    return s.join(changed, "span_id", "left").select("span_id", F.coalesce("form", "text").alias("text"), F.col("form").isNotNull().alias("changed"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspects(table(spark, sf_dir, "text_spans"))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_spans(table(spark, sf_dir, "text_spans"))


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
