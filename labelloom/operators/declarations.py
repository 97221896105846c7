"""Spans of a page to declarations: labels, values beside and below them, and unlabelled fallbacks.

A page is read in passes; a pass only looks for fields that earlier ones have not found. Labels
come from one table of phrases, values from small readers (amount, quantity, date, block, name,
country); a reader takes the text after its label up to the next label, then the cell to
the right, then the lines below. Confidence falls from pass to pass and is multiplied by that
of the spans.

Work is split by (scan_id, photo), so a booklet is spread over its pages; the best reading of a
pack is chosen by a partial aggregate.

Defined results: null and blank spans are no lines; every field comes out once a page, with
present = false where nothing was found; texts are never cut; a label without a value gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.layout import PAGE, boxes, rows_of
from labelloom.operators.paged import by_group

# Label wordings by field, English and Hindi.
LABELS = {
    "retail_sale_price": ["m.r.p", "mrp", "maximum retail price", "max retail price", "अधिकतम खुदरा मूल्य", "अ खु मू", "एम आर पी"],
    "net_quantity": ["net quantity", "net qty", "net weight", "net wt", "net volume", "net vol", "net contents", "net content", "contents", "शुद्ध मात्रा", "शुद्ध वजन", "शुद्ध भार", "कुल मात्रा", "नेट वजन", "नेट मात्रा"],
    "unit_sale_price": ["unit sale price", "unit price", "price per unit", "u.s.p", "usp", "इकाई मूल्य", "इकाई बिक्री मूल्य"],
    "manufacture_date": [
        "mfg date", "mfd date", "date of mfg", "date of mfd", "date of manufacture", "date of packing", "date of import", "manufacturing date", "manufactured date", "manufactured on", "mfg on", "mfd on", "mfg", "mfd", "pkd on", "pkd date", "pkd", "packed on", "packing date", "packed date", "month and year of import", "import date",
        "निर्माण तिथि", "निर्माण की तिथि", "उत्पादन तिथि", "पैकिंग तिथि", "पैक करने की तिथि",
    ],
    "expiry_date": ["best before", "use by", "use before", "expiry date", "exp date", "expires on", "expiry", "exp"],
    "manufacturer_details": [
        "manufactured by", "manufactured and marketed by", "manufactured for", "mfd by", "mfg by", "mfd and mktd by", "marketed by", "mktd by", "mkt by", "packed by", "packed and marketed by", "pkd by", "packed for", "imported by", "imported and distributed by", "imported and marketed by", "distributed by", "manufacturer",
        "packer", "importer", "name and address of", "made in india by", "निर्माता", "विपणनकर्ता", "आयातक", "पैककर्ता", "द्वारा निर्मित",
    ],
    "consumer_care": ["consumer care", "customer care", "consumer services", "customer service", "customer support", "consumer helpline", "consumer cell", "customer cell", "consumer relations", "toll free", "helpline", "for feedback", "for complaints", "for queries", "consumer complaints", "उपभोक्ता सेवा", "ग्राहक सेवा", "उपभोक्ता शिकायत"],
    "common_name": ["generic name", "common name", "commodity", "product type", "name of product"],
    "country_of_origin": ["country of origin", "made in", "product of", "origin", "मूल देश"],
}
FIELDS = list(LABELS)
BLOCKS = ("manufacturer_details", "consumer_care")
# Countries that stand on goods after "made in" and "product of".
COUNTRIES = "india|bharat|china|p\\.?r\\.? ?c|taiwan|thailand|vietnam|bangladesh|nepal|sri lanka|indonesia|malaysia|japan|korea|south korea|singapore|hong kong|turkey|italy|germany|france|spain|switzerland|netherlands|belgium|poland|ireland|uk|u\\.k|united kingdom|england|usa|u\\.s\\.a|united states|canada|mexico|brazil|australia|new zealand|uae|saudi arabia|egypt|south africa|भारत|चीन"
# Units of quantities as printed, and the one they stand for; Hindi names too.
UNITS = {
    "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg", "g": "g", "gm": "g", "gms": "g", "gram": "g", "grams": "g", "mg": "mg", "ml": "ml", "mls": "ml", "millilitre": "ml", "millilitres": "ml", "l": "l", "ltr": "l", "litre": "l", "litres": "l", "liter": "l", "n": "N", "u": "U", "pc": "N", "pcs": "N", "piece": "N", "pieces": "N",
    "nos": "N", "no": "N", "unit": "N", "units": "N", "tablets": "N", "capsules": "N", "किलोग्राम": "kg", "किग्रा": "kg", "कि.ग्रा": "kg", "ग्राम": "g", "ग्रा": "g", "मिली": "ml", "मि.ली": "ml", "लीटर": "l", "ली": "l", "नग": "N",
}
NOT_METRIC = ("fl oz", "fl. oz", "oz", "lbs", "lb", "cc")
# Words of lines whose amounts are no price, or whose figures are no quantity of the pack.
NOT_A_PRICE = ["unit", "per ", "offer", "discount", "cashback", "special price", "our price", "deal", "save", "off", "you pay", "selling price"]
NOT_A_QUANTITY = ["serving", "serve", "per 100", "mfg", "mfd", "packed on", "expiry", "best before", "use by", "batch", "model"]
ELSEWHERE = re.compile(r"m\.?r\.?p\b.{0,80}\bsee\b.{0,30}\b(?:base|bottom|lid|cap|crimp|side|above|below|coding)", re.I | re.S)
CODED = re.compile(r"(?:net|qty|quantity|vol).{0,80}\bsee\b.{0,20}\bcoding", re.I | re.S)
TOLL = re.compile(r"(?<!\d)1[89]00[\s-]?\d{3}[\s-]?\d{3,4}(?!\d)")
MAIL = re.compile(r"[\w.+-]+\s?@\s?[\w-]+\s?\.\s?[a-z]{2,}", re.I)
PHONE = re.compile(r"(?<!\d)(?:\+?91[\s-]?)?\(?\d(?:[\s()-]{0,2}\d){9,10}(?!\d)")

_NUMBER = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_UNIT = "|".join(sorted((re.escape(u) for u in UNITS), key=len, reverse=True))
_END = r"(?![A-Za-zऀ-ॿ])"
AMOUNT = re.compile(rf"^[\s:;.\-–(₹]*(?:(?:rs|inr|re|रु|रू)\b[.:]?\s*|₹\s*|[^\w\s]\s*|[A-Za-z](?=\d+\.\d\d))?[:\s]*({_NUMBER})(?P<more>.{{0,14}})", re.I | re.S)
QUANTITY = re.compile(rf"(?<![\d.,])(?:(\d{{1,3}})\s*[x×*]\s*)?({_NUMBER})\s*({_UNIT}){_END}\.?(?:\s*[x×*]\s*(\d{{1,3}})\b)?", re.I)
RATE = re.compile(rf"(?<!\d)(?<![\dOo][.\s])({_NUMBER})\s*(?:/|per|प्रति)\s*(?:\d+\s*)?({_UNIT}|unit|(?<=\.\d\d/)[96q&](?![\d.])){_END}", re.I)
BARE_RATE = re.compile(r"^[\s:.(-]*(?:(?:rs\.?|₹|\W)\s*)?(\d+\.\d{2,3})(?!\d|\s*\d)", re.I)
PRICE_CELL = re.compile(rf"\W*(?:(?:rs\.?|₹|inr)\W*(?:{_NUMBER})|\d+(?:,\d{{2,3}})*\.\d{{2}}|(?:{_NUMBER})\s*/-)\s*(?:/-)?\W*(?:\(.*)?", re.I)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DATE = re.compile(
    r"(?<![\d/.])(?P<d>\d{1,2})\s*[/.-]\s*(?P<m>\d{1,2})\s*[/.-]\s*(?P<y>\d{4}|\d{2})(?!\d|/\d)"
    rf"|(?<![A-Za-z])(?:(?P<dd>\d{{1,2}})\s*(?:st|nd|rd|th)?[\s/.,-]*)?(?P<mon>{'|'.join(MONTHS)})[a-z]*[\s/.,'’-]*(?P<yy>\d{{4}}|\d{{2}})(?!\d)"
    r"|(?<![\d/.])(?P<mm>\d{1,2})\s*[/.-]\s*(?P<yyyy>\d{4})(?!\d|/\d)",
    re.I,
)
SPAN_OF_TIME = re.compile(r"(\d{1,3})\s*(month|day|year)s?", re.I)


def _label_pattern(phrase: str) -> str:
    words = phrase.replace("and", "&").split() if " and " in phrase else phrase.split()
    parts = [r"(?:and|&|,)" if w == "&" else r"\.?\s*".join(w.replace(".", "")) if "." in w else re.escape(w) for w in words]
    return r"[\s.]*".join(parts)


_PHRASES = sorted(((p, f) for f, ps in LABELS.items() for p in ps), key=lambda x: -len(x[0]))
_LABEL = re.compile(r"(?<![A-Za-zऀ-ॿ])(?:" + "|".join(f"(?P<l{i}>{_label_pattern(p)})" for i, (p, _) in enumerate(_PHRASES)) + r")(?![A-Za-zऀ-ॿ])[.:\s-]*", re.I)


_LONG_PHRASES = [(q, f, p.count(" ") + 1, Counter(q)) for p, f in _PHRASES if len(q := p.replace(".", "")) >= 7 and p.isascii() and f != "expiry_date"]


def labels(text: str) -> list[tuple[str, int, int]]:
    """(field, start, end) of the labels of a text, the longest wording at each place."""
    return [(_PHRASES[int(m.lastgroup[1:])][1], m.start(), m.end()) for m in _LABEL.finditer(text)]


def past_labels(tail: str) -> str:
    """The text after further labels and remarks in brackets at its beginning."""
    while m := re.match(r"^\W*\([^)\d]*\)", tail) or _LABEL.match(tail.lstrip(" /&,")):
        tail = tail[m.end() :] if m.re is not _LABEL else tail.lstrip(" /&,")[m.end() :]
    return tail


def _float(t: str) -> float:
    return float(t.replace(",", ""))


def year(t: str) -> int | None:
    y = int(t) + (2000 if len(t) <= 2 else 0)
    return y if 2000 <= y <= 2045 else None


def mended(text: str) -> str:
    """Months of coded dates with figures read for their letters: 0CT, AU6, 5EP."""
    return re.sub(r"(?<![A-Za-z0-9])([A-Z0-9]{3})(?=[\s/.'’-]?\d{2,4}(?!\d))", lambda m: w if not m[1].isdigit() and (w := m[1].translate(str.maketrans("05168", "OSIGB"))).lower() in MONTHS else m[1], text)


def dates_in(text: str | None) -> list[tuple[int, int, int | None, str]]:
    """Every date of a text, in order and once: (year, month, day or None, as written)."""
    out: dict[tuple, tuple] = {}
    for m in DATE.finditer(mended(text or "")):
        g = m.groupdict()
        y = year(g["y"] or g["yy"] or g["yyyy"])
        month = MONTHS.index(g["mon"][:3].lower()) + 1 if g["mon"] else int(g["m"] or g["mm"])
        day = int(g["d"] or g["dd"]) if g["d"] or g["dd"] else None
        if y and 1 <= month <= 12 and (day is None or 1 <= day <= 31):
            out.setdefault((y, month, day), (y, month, day, m[0].strip()))
    return list(out.values())


def amount(tail: str) -> float | None:
    """The price right after a label; a rate is none."""
    m = AMOUNT.match(tail)
    if not m or re.match(rf"\s*(?:/(?!-)|per\b|%|प्रति|(?:{'|'.join(MONTHS)}))", m["more"], re.I) or (re.match(r"[A-Za-z]", m["more"]) and not re.search(r"\.\d\d$", m[1])):
        return None
    if m[1] in ("7", "2") and (n := re.match(rf"\s+({_NUMBER})", m["more"])):
        return _float(n[1])  # the rupee sign read as a figure
    return _float(m[1])


def unit_of(t: str) -> str:
    """The unit of a rate; a single figure or mark in its place is a misread g."""
    return UNITS.get(t.lower(), "g" if t in "96q&" else "N")


def quantity(tail: str) -> tuple[float, str] | None:
    """Amount and unit; packs of several are the total."""
    m = QUANTITY.search(tail)
    if not m:
        m = re.match(rf"^\W*({_NUMBER})\s[96q&]\W*$", tail)  # a misread g at the end
        return (_float(m[1]), "g") if m else None
    v = _float(m[2]) * int(m[1] or 1) * int(m[4] or 1)
    return round(v, 6), UNITS[m[3].lower()]


class Line:
    __slots__ = ("text", "x", "y", "w", "h", "conf", "labels")

    def __init__(self, text: str, x: float, y: float, w: float, h: float, conf: float) -> None:
        self.text, self.x, self.y, self.w, self.h, self.conf = text, x, y, w, h, conf
        self.labels = labels(text)

    @property
    def bare(self) -> bool:
        """A label and nothing else (brackets aside)."""
        if not self.labels:
            return False
        rest = re.sub(r"\([^)]*\)|₹|\brs\b|[\W_]", "", self.text[self.labels[-1][2] :], flags=re.I)
        return self.labels[0][1] <= 12 and not rest


def page_lines(text: list, x: list, y: list, w: list, h: list, conf: list, vertical: list) -> list[Line]:
    """Lines in reading order: one span each, a bare label joined with the value beside it."""
    out: list[Line] = []
    flat = [i for i in range(len(text)) if text[i] and text[i].strip() and not vertical[i]]
    rows = [[flat[k] for k in row] for row in rows_of([x[i] for i in flat], [y[i] for i in flat], [h[i] for i in flat])] if flat else []
    median = sorted(h[i] for i in flat)[len(flat) // 2] if flat else 1.0
    for row in rows:
        taken = False
        for k, i in enumerate(row):
            if taken:
                taken = False
                continue
            line = Line(text[i].strip(), x[i], y[i], w[i], h[i], conf[i])
            if line.bare and k + 1 < len(row):
                j = row[k + 1]
                value = text[j].strip()
                near = -0.5 * h[i] <= x[j] - x[i] - w[i] <= 14 * median
                if near and not labels(value) and (re.match(r"^[\s:(–-]*(?:₹|rs|inr|रु|\d|[a-z]{3}[\s/.-]*\d)", value, re.I) or line.labels[-1][0] in ("country_of_origin", "common_name", *BLOCKS)):
                    line = Line(f"{line.text} {value}", x[i], min(y[i], y[j]), x[j] + w[j] - x[i], max(h[i], h[j]), (conf[i] + conf[j]) / 2)
                    taken = True
            out.append(line)
    out += [Line(text[i].strip(), x[i], y[i], w[i], h[i], conf[i]) for i in range(len(text)) if vertical[i] and text[i] and text[i].strip()]
    return out


def below(line: Line, lines: list[Line], limit: int) -> list[Line]:
    """Lines under a line in its column, one after the other, until the print leaves space."""
    out, at = [], line
    while len(out) < limit:
        under = [o for o in lines if o is not line and o not in out and o.y + o.h / 2 - at.y - at.h / 2 > 0.3 * min(at.h, o.h) and o.y - at.y - at.h <= 1.2 * at.h]
        under = [o for o in under if abs(o.x - at.x) <= 1.5 * at.h or min(o.x + o.w, at.x + at.w) - max(o.x, at.x) >= 0.5 * min(o.w, at.w)]
        if not under:
            break
        at = min(under, key=lambda o: (o.y + o.h / 2, o.x))
        out.append(at)
    return out


def beside(line: Line, lines: list[Line], reach: float = 14.0) -> list[Line]:
    """Lines of a value column off the label's row: right of it and at most two heights up or down, nearest row first."""
    near = [o for o in lines if o is not line and o.x >= line.x + 0.5 * line.w and o.x - line.x - line.w <= reach * line.h and abs(o.y - line.y) <= 2 * line.h]
    return sorted(near, key=lambda o: (abs(o.y - line.y), o.x))


class Page:
    """The declarations of one page, found pass by pass."""

    def __init__(self, lines: list[Line], as_of: tuple[int, int]) -> None:
        self.lines, self.as_of = lines, as_of
        self.found: dict[str, dict] = {}
        self.all = "\n".join(x.text for x in lines)

    def put(self, field: str, raw: str, conf: float, how: str, text: str | None = None, num: float | None = None, unit: str | None = None) -> None:
        if field not in self.found:
            self.found[field] = {"raw": raw, "confidence": round(conf, 4), "how": how, "text": text, "num": num, "unit": unit}

    def missing(self, field: str) -> bool:
        return field not in self.found

    # -- values ---------------------------------------------------------------------------

    def take(self, field: str, tail: str, line: Line, conf: float, how: str) -> bool:
        """Read a value of a field from the text after its label."""
        conf *= line.conf
        tail = past_labels(tail)
        if field == "retail_sale_price" and (v := amount(tail)) is not None:
            self.put(field, line.text, conf, how, num=v)
        elif field == "net_quantity" and (q := quantity(tail)) is not None:
            self.put(field, line.text, conf, how, num=q[0], unit=q[1])
        elif field == "unit_sale_price" and (m := RATE.search(tail) or BARE_RATE.match(tail)) and not (m.re is BARE_RATE and self.found.get("retail_sale_price", {}).get("num") == _float(m[1])):
            self.put(field, line.text, conf, how, num=_float(m[1]), unit=unit_of(m[2]) if m.re is RATE else None)
        elif field == "manufacture_date" and (d := dates_in(tail)):
            y, month = d[0][:2]
            if (y, month) <= (self.as_of[0] + (self.as_of[1] == 12), self.as_of[1] % 12 + 1):  # one month of grace
                self.put(field, line.text, conf, how, text=f"{month:02d}/{y}")
        elif field == "common_name" and (m := re.match(r"^[\s:–-]*([^\W\d_][^\d:;]{2,})", tail)):
            self.put(field, line.text, conf, how, text=m[1].strip(" .,"))
        elif field == "country_of_origin":
            m = re.match(rf"^[\s:–-]*(?:the\s+)?({COUNTRIES})\b", tail, re.I) or (re.match(r"^[\s:–-]*([^\W\d_][^\d:;,(]{2,40})", tail) if re.search(r"country|मूल", line.text, re.I) else None)
            if m:
                self.put(field, line.text, conf, how, text=m[1].strip(" .,"))
        return not self.missing(field)

    def block(self, field: str, tail: str, line: Line, conf: float, how: str) -> None:
        """A label's text with the lines below it, up to the next label of another field."""
        parts = [tail.strip(" :-.")] if re.search(r"\w{2}", tail) else []
        used = [line]
        for o in below(line, self.lines, 6):
            if o.labels and o.labels[0][1] <= 3 and o.labels[0][0] != field:
                break
            parts.append(o.text)
            used.append(o)
        text = re.sub(r"\s+", " ", joined(parts))
        contact = TOLL.search(text) or MAIL.search(text) or PHONE.search(text)
        if len(text) < 6 or (field == "consumer_care" and not contact and not re.search(r"\b(?:write|contact|call|mail|visit|executive|address)\b|www\.", text, re.I)):
            return
        self.put(field, joined([x.text for x in used]), conf * sum(x.conf for x in used) / len(used), how, text=text)

    # -- passes ---------------------------------------------------------------------------

    def labelled(self) -> None:
        for line in self.lines:
            for k, (field, _, end) in enumerate(line.labels):
                if field == "expiry_date" or not self.missing(field):
                    continue
                stop = line.labels[k + 1][1] if k + 1 < len(line.labels) else len(line.text)
                tail = line.text[end:stop]
                if field in BLOCKS:
                    self.block(field, line.text[end:], line, 0.92, "labelled")
                elif not self.take(field, tail, line, 0.92, "labelled"):
                    self.take(field, line.text[end:], line, 0.92, "labelled")

    def damaged(self) -> None:
        """Labels with misread letters: the words at the head of a line near a wording of some length."""
        from labelloom.functions.fuzzy import similarity

        for line in self.lines:
            if line.labels:
                continue
            words = [m.end() for m in islice(re.finditer(r"\S+", line.text), 6)]
            heads = [re.sub(r"[^a-z ]", "", line.text[:e].lower()) for e in words]
            letters = [Counter(h) for h in heads]
            for phrase, field, n, bag in _LONG_PHRASES:
                if len(words) < n or not self.missing(field):
                    continue
                head, size = heads[n - 1], max(len(phrase), len(heads[n - 1]))
                # shared letters bound the similarity from above
                if sum((bag & letters[n - 1]).values()) >= 0.78 * size and similarity(phrase, head) >= 0.78:
                    tail = line.text[words[n - 1] :]
                    if field in BLOCKS:
                        self.block(field, tail, line, 0.75, "damaged label")
                    elif not self.take(field, tail, line, 0.75, "damaged label"):
                        self.column(field, line, 0.72, "damaged label")

    def column(self, field: str, line: Line, conf: float, how: str) -> bool:
        """A value off its label's row: in the column beside, or right below; of several dates the earliest."""
        cells = [*beside(line, self.lines), *below(line, self.lines, 2)]
        if field == "manufacture_date":
            cells = sorted((o for o in cells if dates_in(o.text)), key=lambda o: dates_in(o.text)[0][:2])
        if field == "retail_sale_price":  # a price of one unit is never the greater one
            cells = sorted(cells, key=lambda o: -(amount(o.text) or 0.0))
        for o in cells:
            if o.labels or (field == "net_quantity" and not re.fullmatch(rf"\W*(?:{_NUMBER})\s*(?:{_UNIT})\.?\W*", o.text, re.I)):
                continue
            if field == "retail_sale_price" and not PRICE_CELL.fullmatch(o.text):
                continue
            if self.take(field, o.text, o, conf, how):
                return True
        return False

    def off_the_row(self) -> None:
        for line in self.lines:
            if line.bare:
                for field, _, _ in line.labels:
                    if field in ("net_quantity", "retail_sale_price", "manufacture_date", "unit_sale_price") and self.missing(field):
                        self.column(field, line, 0.8, "beside label")

    def table(self) -> None:
        """A row of three or more labels over a row of as many values."""
        for line in self.lines:
            row = sorted((o for o in self.lines if abs(o.y - line.y) <= 0.5 * line.h and o.labels), key=lambda o: o.x)
            heads = [f for o in row for f, _, _ in o.labels]
            if line is not (row[0] if row else None) or len(heads) < 3:
                continue
            under = below(row[0], self.lines, 1)
            if not under:
                continue
            cells = sorted((o for o in self.lines if abs(o.y - under[0].y) <= 0.5 * under[0].h and not o.labels), key=lambda o: o.x)
            values = [(c, o) for o in cells for c in (re.findall(r"\S+", o.text) if len(cells) != len(heads) else [o.text])]
            if len(values) == len(heads):
                for f, (c, o) in zip(heads, values):
                    if self.missing(f):
                        self.take(f, c, o, 0.8, "table")

    def imperial(self) -> None:
        if self.missing("net_quantity"):
            units = "|".join(re.escape(u) for u in NOT_METRIC)
            for line in self.lines:
                for field, _, end in line.labels:
                    if field == "net_quantity" and (m := re.match(rf"^\W*({_NUMBER})\s*({units}){_END}", line.text[end:], re.I)):
                        self.put("net_quantity", line.text, 0.8 * line.conf, "not metric", num=_float(m[1]), unit=m[2].lower())

    def unlabelled(self) -> None:
        elsewhere = bool(ELSEWHERE.search(self.all))
        for line in self.lines:
            low = line.text.lower()
            other = {f for f, _, _ in line.labels}
            if self.missing("retail_sale_price") and not elsewhere and line.conf >= 0.85 and not any(w in low for w in NOT_A_PRICE) and not other - {"retail_sale_price"}:
                m = re.search(rf"(?:₹|\brs\.?|\binr)\s*({_NUMBER})(?![\d,]|\s*(?:/(?!-)|per\b))", line.text, re.I) or re.search(rf"(?<![\d.,/])({_NUMBER})\s*/-(?!\s*per)", line.text) or re.search(rf"({_NUMBER})\W*\S{{0,6}}\s*of\s+all\s+tax", line.text, re.I)
                if m:
                    self.put("retail_sale_price", line.text, 0.68 * line.conf, "unlabelled", num=_float(m[1]))
            if self.missing("unit_sale_price") and "mrp" not in low.replace(".", "") and (m := RATE.search(line.text)) and ("." in m[1] or re.search(r"₹|\brs\b", line.text, re.I)):
                self.put("unit_sale_price", line.text, 0.68 * line.conf, "unlabelled", num=_float(m[1]), unit=unit_of(m[2]))
        if self.missing("net_quantity") and CODED.search(self.all):
            only = {q: line for line in self.lines if line.conf >= 0.9 and re.fullmatch(rf"\s*(?:{_NUMBER})\s*(?:{_UNIT})\s*", line.text, re.I) and (q := quantity(line.text)) and not any(w in line.text.lower() for w in NOT_A_QUANTITY)}
            if len(only) == 1:
                (q, line), = only.items()
                self.put("net_quantity", line.text, 0.65 * line.conf, "coding area", num=q[0], unit=q[1])

    def date_pair(self) -> None:
        """Two unlabelled dates near each other on a pack that speaks of such dates: the earlier one is the making."""
        if self.missing("manufacture_date") and re.search(r"\b(?:mfd|mfg|pkd|packed|manufactured|use by|use before|best before|exp|expiry|coding area)\b", self.all, re.I):
            for line in self.lines:
                near = [line, *below(line, self.lines, 1)]
                d = sorted({x[:2] for o in near for x in dates_in(o.text)})
                if len(d) >= 2 and d[0] <= self.as_of:
                    self.put("manufacture_date", " / ".join(o.text for o in near), 0.6 * line.conf, "date pair", text=f"{d[0][1]:02d}/{d[0][0]}")
                    return

    def contact(self) -> None:
        if self.missing("consumer_care"):
            for line in self.lines:
                if TOLL.search(line.text) or MAIL.search(line.text):
                    more = [o.text for o in below(line, self.lines, 2) if TOLL.search(o.text) or MAIL.search(o.text)]
                    self.put("consumer_care", joined([line.text, *more]), 0.5 * line.conf, "contact only", text=" ".join([line.text, *more]))
                    return

    def expiry(self) -> None:
        """Labelled; else the later of a pair; else the stated months after the making."""
        made = self.found.get("manufacture_date", {}).get("text")
        for line in self.lines:
            for field, _, end in line.labels:
                if field == "expiry_date":
                    tail = line.text[end:]
                    dates = dates_in(tail) or [x for o in below(line, self.lines, 1) if not o.labels for x in dates_in(o.text)]
                    if dates:
                        y, m = max(d[:2] for d in dates)
                        self.put("expiry_date", line.text, 0.9 * line.conf, "labelled", text=f"{m:02d}/{y}")
                    elif made and (t := SPAN_OF_TIME.search(tail)):
                        n = int(t[1]) * {"month": 1, "year": 12, "day": 0}[t[2].lower()] + (int(t[1]) // 30 if t[2].lower() == "day" else 0)
                        k = int(made[3:]) * 12 + int(made[:2]) - 1 + n
                        self.put("expiry_date", line.text, 0.8 * line.conf, "months after making", text=f"{k % 12 + 1:02d}/{k // 12}")
        if self.missing("expiry_date") and made and self.found["manufacture_date"]["how"] == "date pair":
            d = max(x[:2] for x in dates_in(self.found["manufacture_date"]["raw"]))
            self.put("expiry_date", self.found["manufacture_date"]["raw"], self.found["manufacture_date"]["confidence"], "date pair", text=f"{d[1]:02d}/{d[0]}")

    def rupee_as_figure(self) -> None:
        """A price of one unit above that of the pack: its leading 2 or 7 was the rupee sign."""
        usp, mrp = self.found.get("unit_sale_price"), self.found.get("retail_sale_price")
        if usp and mrp and usp["num"] > mrp["num"] > 0 and (m := re.match(r"^[27](\d{1,3}\.\d{2,3})$", f"{usp['num']:.2f}")) and float(m[1]) <= mrp["num"]:
            usp["num"], usp["how"] = float(m[1]), usp["how"] + ", sign read as figure"

    def read(self) -> dict[str, dict]:
        for step in (self.labelled, self.damaged, self.off_the_row, self.table, self.imperial, self.unlabelled, self.date_pair, self.contact, self.expiry, self.rupee_as_figure):
            step()
        return self.found


def joined(parts: list[str]) -> str:
    """Lines of an address as one text: a comma between lines unless one ends in punctuation."""
    out = ""
    for p in (x.strip() for x in parts):
        if p:
            out = p if not out else f"{out} {p}" if out[-1] in ",:;.&/-" else f"{out}, {p}"
    return out


SCHEMA = "scan_id string, photo int, field_id string, present boolean, value_text string, value_num double, unit string, raw_text string, confidence double, how string"


def _read(as_of: tuple[int, int]):
    def run(g: pa.RecordBatch) -> Iterator[tuple]:
        cols = {c: g.column(c).to_pylist() for c in ("scan_id", "photo", "text", "x", "y", "w", "h", "confidence", "vertical")}
        lines = page_lines(*(cols[c] for c in ("text", "x", "y", "w", "h", "confidence", "vertical")))
        found = Page(lines, as_of).read()
        scan, photo = cols["scan_id"][0], cols["photo"][0]
        out = []
        for f in FIELDS:
            d = found.get(f)
            out.append((scan, photo, f, d is not None, *((d["text"], d["num"], d["unit"], d["raw"], d["confidence"], d["how"]) if d else (None,) * 6)))
        return out

    return run


def declarations(spans: DataFrame, as_of: str) -> DataFrame:
    """Every field of every page (``SCHEMA``); dates after ``as_of`` (YYYY-MM-DD) and a month are no dates of making."""
    s = boxes(spans).drop("angle").join(spans.select("span_id", F.coalesce("vertical", F.lit(False)).alias("vertical")), "span_id") if "vertical" in spans.columns else boxes(spans).drop("angle").withColumn("vertical", F.lit(False))
    s = s.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return by_group(s.select(*PAGE, "span_id", "text", "x", "y", "w", "h", "confidence", "vertical"), PAGE, ["y", "x", "span_id"], _read((int(as_of[:4]), int(as_of[5:7]))), SCHEMA)


def of_packs(pages: DataFrame) -> DataFrame:
    """One row per (scan_id, field_id): the surest reading over the photos, the first of equals, with the photo it came from."""
    order = F.struct((~F.col("present")).alias("a"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "photo")
    best = pages.groupBy("scan_id", "field_id").agg(F.min_by(F.struct("photo", "present", "value_text", "value_num", "unit", "raw_text", "confidence", "how"), order).alias("m"))
    return best.select("scan_id", "field_id", "m.*")
