"""Repair of text from scanned pages (problem 5).

Method: joint word segmentation, decoded over de-lined character streams. The lines of a page,
without running headers, footers and page numbers, are one stream with the last line of the page
before and the first of the page after; one Viterbi lattice over it
has arcs for a word as it stands, for a word read through character confusions (found in a
trie over the lexicon), for two pieces merged, for one piece split, and over a line's end for
a word that goes on in the next line (with a mark, which is dropped, or without one) or a compound
broken at its own hyphen. What a line's end means is decided by the cheapest path, with all else.
Costs are negative log frequencies of the corpus' own words, so a rare spelling is corrected only
to a word that is more frequent by the cost of the confusion. Paragraph boundaries minimise a
cost over the lines of a page (indent, short last line, closed sentence) by dynamic programming.

Scale: a line needs its page's neighbours and one neighbour beyond the page edge, so work is
split by page, and the largest booklet (a tenth of all rows) is spread like the others; page
edges meet by an equality join on the page number. The lexicon is a partial aggregate, of
which the most frequent LEXICON words travel to the workers; a word beyond the bound is rarer
than any correction could use.

Defined results: null and blank lines are no body lines; of rows with one span_id the last
ingested counts; a missing page number in the sequence only loses the link across that
edge; other categories than booklets give nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.lookalikes import canonical_text, last_rows
from labelloom.operators.paged import by_group
from labelloom.session import cut, table

LEXICON = 60_000
#: Lines at either edge of a page that can be headers, footers or page numbers.
EDGE = 3
#: A gap is wide from this multiple of the page's usual distance of lines.
WIDE = 1.4

# What a scanner prints for what was there.
CONFUSIONS = (
    "c>e o>0 0>o i>l l>i 1>l 1>i I>l I>i !>i !>l rn>m ri>n m>rn n>ri ii>u u>ii vv>w w>vv cl>d d>cl t>f f>t b>h h>b 6>b 8>b 5>s 4>a 9>g q>g g>q e>c o>c c>o n>u u>n li>h h>li |>l |>i 3>e 7>t 2>z l>t t>l j>i i>j y>v v>y s>5 nn>m in>m fi>h ni>m ]>l [>l"
)
_READ = [tuple(x.split(">")) for x in CONFUSIONS.split()]
#: Cost of a first listed confusion, of further ones and of any other substitution, as log
#: frequency ratios: a spelling is corrected to words more frequent by these factors only.
LISTED, MORE, OTHER = math.log(20), math.log(4), math.log(60)
#: Marks that end a line inside a word.
BREAKS = "-¬~=‐‑­"


def plain(text: str, lang: str | None) -> str:
    """Look-alikes removed, but a soft hyphen at the end of the line kept as a hyphen."""
    t = text.rstrip()
    tail = "-" if t.endswith("­") else ""
    return canonical_text(t, lang or "en").strip() + tail


class Lexicon:
    def __init__(self, counts: list[tuple[str, int]], total: int) -> None:
        self.log = {w: math.log(n) for w, n in counts}
        self.total = math.log(max(2, total))
        self.root: dict = {}
        for w, _ in counts:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.read: dict[str, list[str]] = {}
        for seen, true in _READ:
            self.read.setdefault(seen[0], []).append((seen, true))
        self.known: dict[str, tuple[float, str, bool]] = {}

    def cost(self, w: str) -> float:
        return self.total - self.log.get(w, 0.0) if w in self.log else self.total + 1.0

    def _corrections(self, w: str) -> Iterator[tuple[float, str]]:
        """Lexicon words from which ``w`` can have been misread, with the cost of the misreading."""
        limit = LISTED + MORE * (2 if len(w) > 4 else 1 if len(w) > 2 else 0) + 1e-9
        stack = [(0.0, 0, self.root, False)]
        while stack:
            cost, i, node, other = stack.pop()
            if i == len(w):
                if "" in node and cost:
                    yield cost, node[""]
                continue
            if w[i] in node:
                stack.append((cost, i + 1, node[w[i]], other))
            for seen, true in self.read.get(w[i], ()):
                step = MORE if cost else LISTED
                if cost + step <= limit and w.startswith(seen, i):
                    nxt = node
                    for c in true:
                        nxt = nxt.get(c)
                        if nxt is None:
                            break
                    if nxt is not None:
                        stack.append((cost + step, i + len(seen), nxt, other))
            if not cost and len(w) >= 4:
                for c, nxt in node.items():
                    if c and c != w[i]:
                        stack.append((OTHER, i + 1, nxt, True))

    def best(self, w: str) -> tuple[float, str, bool]:
        """(cost, spelling, corrected) of the cheapest reading of one piece."""
        if (kept := self.known.get(w)) is not None:
            return kept
        best = (self.cost(w), w, False)
        if self.log.get(w, 0.0) < self.total - LISTED - 1 and sum(_small(c) for c in w) >= max(1, (len(w) + 1) // 2):
            for extra, v in self._corrections(w):
                c = self.cost(v) + extra
                if c < best[0] - 1e-9 and self.log[v] >= math.log(3):
                    best = (c, v, True)
        if len(self.known) < 200_000:
            self.known[w] = best
        return best


_PIECE = re.compile(r"^([^\w!|\[\]]*)(.*?)([^\w]*)$", re.S)


def pieces(token: str) -> tuple[str, list[str], str]:
    """(marks before, parts between hyphens and apostrophes, marks after)."""
    before, core, after = _PIECE.match(token).groups()
    return before, re.split(r"([-'’/])", core), after


def _word(p: str) -> bool:
    """Can be an ordinary lower-case word: no capital first, letters prevail, no amount or code."""
    if not p or len(p) < 2 or p[0].isupper() or not any(_small(c) for c in p):
        return False
    return sum(_small(c) or c == "I" for c in p) * 2 >= len(p) and not re.fullmatch(r"\d+[a-z]{1,3}", p)


def _small(c: str) -> bool:
    """A letter that is no capital, or a mark on one (scripts without case have small letters only)."""
    return (c.isalpha() and not c.isupper()) or unicodedata.category(c)[0] == "M"


#: Cost of a mark at a line's end that is no break of a word.
KEPT_MARK = math.log(400)


def _broken(last: str, following: str) -> tuple[str, str] | None:
    """The two parts of the word that a marked line end may break, None if it cannot."""
    if len(last) < 2 or last[-1] not in BREAKS:
        return None
    head = re.split(r"[-'’/]", _PIECE.match(last.rstrip(BREAKS)).group(2))[-1]
    tail = re.split(r"[-'’/]", _PIECE.match(following).group(2))[0]
    if not head or not tail or not head[-1].isalnum() or sum(c.isdigit() for c in head) * 2 > len(head) or not any(_small(c) for c in tail) or tail[0].isupper():
        return None
    return head, tail


class Step:
    """One arc of the lattice: tokens i to j read as ``words``.

    kind is 'word' for a word that goes on in the next line, 'compound' for one broken at its own
    hyphen, '' else; bad tells for the first and the second token whether it was misread.
    """

    __slots__ = ("i", "j", "cost", "words", "kind", "bad")

    def __init__(self, i: int, j: int, cost: float, words: list[str], kind: str = "", bad: tuple[bool, bool] = (False, False)) -> None:
        self.i, self.j, self.cost, self.words, self.kind, self.bad = i, j, cost, words, kind, bad


def _over_the_end(i: int, last: str, following: str, lex: Lexicon) -> Iterator[Step]:
    """Arcs that read the last token of a line and the first of the next as one word."""
    parts = _broken(last, following)
    if parts is None:  # cut without a mark: only if it makes a word that its parts are not
        b1, p1, a1 = pieces(last)
        b2, p2, a2 = pieces(following)
        if not a1 and not b2 and len(p1) == len(p2) == 1 and _word(p1[0]) and _word(p2[0]) and p1[0] not in lex.log and p2[0] not in lex.log and (w := p1[0] + p2[0]) in lex.log:
            yield Step(i, i + 2, lex.cost(w) + LISTED, [b1 + w + a2], "word")
        return
    head, tail = parts
    before, first, _ = pieces(last.rstrip(BREAKS))
    _, rest, after = pieces(following)
    left, right = before + "".join(first[:-1]), "".join(rest[1:]) + after
    aside = sum(lex.best(p)[0] for p in [*first[:-1], *rest[1:]] if _word(p))
    joined, whole = head + tail, f"{head}-{tail}"
    if head[0].isupper():
        cost, spelt, fixed = lex.cost(joined.lower()), joined, False
        whole = whole.lower()
    else:
        cost, spelt, fixed = lex.best(joined)
    bad = (not spelt.startswith(head), spelt.startswith(head) or not spelt.endswith(tail)) if fixed else (False, False)
    yield Step(i, i + 2, cost + aside, [left + spelt + right], "word", bad)
    one, two = lex.best(head), lex.best(tail)
    apart = f"{one[1]}-{two[1]}".lower()
    yield Step(i, i + 2, min(lex.cost(whole), lex.cost(apart) + LISTED) + aside, [left + f"{one[1]}-{two[1]}" + right], "compound", (one[2], two[2]))


def decode(lines: list[list[str]], lex: Lexicon) -> list[Step]:
    """The cheapest path over the tokens of all lines as one stream."""
    tokens = [t for line in lines for t in line]
    ends, at = set(), 0
    for line in lines:
        at += len(line)
        ends.add(at - 1)
    n = len(tokens)
    cost = [0.0] + [math.inf] * n
    back: list[Step | None] = [None] * (n + 1)

    def arc(s: Step) -> None:
        c = cost[s.i] + s.cost
        if c < cost[s.j] - 1e-9:
            cost[s.j], back[s.j] = c, s

    for i, token in enumerate(tokens):
        if i + 1 < n and i in ends:
            for s in _over_the_end(i, token, tokens[i + 1], lex):
                arc(s)
        before, parts, after = pieces(token)
        total, out, fixed = 0.0, [], False
        for p in parts:
            if _word(p):
                c, v, f = lex.best(p)
                total, fixed = total + c, fixed or f
                out.append(v)
            else:
                out.append(p)
        kept = KEPT_MARK if i in ends and i + 1 < n and _broken(token, tokens[i + 1]) else 0.0
        arc(Step(i, i + 1, total + kept, [before + "".join(out) + after], bad=(fixed, False)))
        if len(parts) == 1 and _word(parts[0]) and parts[0] not in lex.log:
            w = parts[0]
            for k in range(2, len(w) - 1):  # a lost gap
                if w[:k] in lex.log and w[k:] in lex.log:
                    arc(Step(i, i + 1, lex.cost(w[:k]) + lex.cost(w[k:]) + LISTED + kept, [before + w[:k], w[k:] + after]))
            if i + 1 < n and not after and i not in ends:  # a gap too many
                b2, p2, a2 = pieces(tokens[i + 1])
                if not b2 and len(p2) == 1 and p2[0].isalpha() and (w + p2[0]) in lex.log and p2[0] not in lex.log:
                    arc(Step(i, i + 2, lex.cost(w + p2[0]) + LISTED, [before + w + p2[0] + a2], bad=(True, False)))
    path, j = [], n
    while j:
        s = back[j]
        path.append(s)
        j = s.i
    return path[::-1]


def read_page(texts: list[str], head: str | None, tail: str | None, lex: Lexicon) -> list[tuple[list[str], bool, bool]]:
    """(words, last word goes on, misread) of each line of a page, given its neighbours' next and last lines.

    A word that goes on belongs to the line where it begins.
    """
    lines = [t.split() for t in ([tail] if tail else []) + texts + ([head] if head else [])]
    of = [k for k, line in enumerate(lines) for _ in line]
    out: list[tuple[list[str], bool, bool]] = [([], False, False) for _ in lines]
    for s in decode(lines, lex):
        k = of[s.i]
        words, goes_on, bad = out[k]
        out[k] = (words + s.words, goes_on or s.kind == "word", bad or s.bad[0])
        if s.bad[1]:
            words, goes_on, _ = out[of[s.j - 1]]
            out[of[s.j - 1]] = (words, goes_on, True)
    return out[1 if tail else 0 :][: len(texts)]


_NUMBER = r"(?:[0-9OolI]{1,4}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})"
PAGE_NUMBER = re.compile(rf"^[\W_]*(?:(?:page|pg|p|pagina|seite)[\s.:]*)?{_NUMBER}(?:\s*(?:of|/)\s*{_NUMBER})?[\W_]*$", re.I)


def _plain_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [plain(t or "", lang) for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
        number = [bool(PAGE_NUMBER.match(t)) for t in texts]
        keep = [b.column(c) for c in ("span_id", "scan_id", "photo", "y", "x", "w")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array(number)], names=["span_id", "scan_id", "photo", "y", "x", "w", "text", "numbered"])


def booklet_lines(spans: DataFrame, scans: DataFrame) -> DataFrame:
    """Lines of booklets in plain form with their zone: body, page_number or page_header."""
    booklets = scans.where("category = 'booklet' and scan_id is not null").select("scan_id").distinct()
    s = spans.select(F.col("span_id").cast("long").alias("span_id"), "scan_id", "photo", "y", "x", "w", "text", "lang", "ingested_at").join(booklets, "scan_id", "left_semi")
    s = last_rows(s).select("span_id", "scan_id", F.coalesce("photo", F.lit(0)).alias("photo"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("y", "x", "w")), "text", "lang")
    s = s.mapInArrow(_plain_lines, "span_id long, scan_id string, photo int, y double, x double, w double, text string, numbered boolean")
    page = Window.partitionBy("scan_id", "photo")
    order = page.orderBy("y", "x", "span_id")
    near = order.rowsBetween(0, EDGE - 1)
    past = order.rowsBetween(-(EDGE - 1), 0)
    s = s.withColumn("after", F.lead("y").over(order) - F.col("y")).withColumn("before", F.col("y") - F.lag("y").over(order))
    s = s.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(page))
    # the usual distance of lines is a booklet's, so that short pages have one too
    pitch = s.where("after > 2").groupBy("scan_id").agg(F.percentile_approx("after", 0.5).alias("pitch"))
    s = s.join(pitch, "scan_id", "left")
    top = (F.col("rn") <= EDGE) & (F.col("after") > WIDE * F.col("pitch"))
    low = (F.col("n") - F.col("rn") < EDGE) & (F.col("before") > WIDE * F.col("pitch"))
    first, last = F.col("rn") <= EDGE, F.col("n") - F.col("rn") < EDGE
    s = s.withColumn("edge", F.coalesce(F.max(top).over(near) & first, F.lit(False))).withColumn("foot", F.coalesce(F.max(low).over(past) & last, F.lit(False)))
    # a height near the top where most lines of the booklet stand apart is a margin; elsewhere a
    # gap is a lost line. Feet move with the length of the page and go by the gap.
    s = cut(s.withColumn("band", F.floor(F.col("y") / 10)))
    bands = s.groupBy("scan_id", "band").agg(F.avg(F.col("edge").cast("int")).alias("share"), F.count("*").alias("k"))
    s = s.join(bands, ["scan_id", "band"])
    edge = F.col("foot") | (F.col("edge") & (F.col("share") >= 0.4)) | ((first | last) & (F.col("k") >= 3) & (F.col("share") >= 0.7))
    zone = F.when(edge & F.col("numbered"), "page_number").when(edge, "page_header").otherwise("body")
    # blank lines count for the distances, but are no lines of text
    return s.where("text <> ''").select("span_id", "scan_id", "photo", "y", "x", "w", "text", "rn", zone.alias("zone"))


def lexicon(lines: DataFrame, bound: int = LEXICON) -> tuple[list[tuple[str, int]], int]:
    """Whole lower-case words and hyphenated compounds of the body lines, with counts."""
    tokens = F.split("text", r"\s+")
    # the ends of a line may be parts of words
    inner = F.when(F.col("text").rlike(f"[{BREAKS}]$"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))).otherwise(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))))
    words = lines.select(F.explode(inner).alias("t")).select(F.regexp_replace("t", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("w"))
    words = words.where(F.col("w").rlike(r"^[\p{Ll}\p{Lo}\p{M}]{2,30}(-[\p{Ll}\p{Lo}\p{M}]+)*('s)?$")).select(F.regexp_replace("w", "'s$", "").alias("w"))
    parts = words.where(F.col("w").contains("-")).select(F.explode(F.split("w", "-")).alias("w")).where(F.length("w") > 1)
    counts = words.unionByName(parts).groupBy("w").count()
    rows = counts.orderBy(F.desc("count"), "w").limit(bound).collect()
    return [(r[0], r[1]) for r in rows], sum(r[1] for r in rows)


def _defects(counts: list[tuple[str, int]], total: int):
    made: list[Lexicon] = []

    def run(g: pa.RecordBatch) -> list[tuple]:
        if not made:
            made.append(Lexicon(counts, total))
        ids, texts, heads, tails = (g.column(c).to_pylist() for c in ("span_id", "text", "next_head", "prev_tail"))
        out = []
        for i, (_, goes_on, bad) in zip(ids, read_page(texts, heads[0], tails[0], made[0])):
            out += [(i, "split_word")] * goes_on + [(i, "misread")] * bad
        return out

    return run


def with_page_edges(body: DataFrame) -> DataFrame:
    """Body lines with the last line of the page before (prev_tail) and the first of the page after (next_head)."""
    key = F.struct("y", "x", "span_id")
    ends = body.groupBy("scan_id", "photo").agg(F.min_by("text", key).alias("head"), F.max_by("text", key).alias("tail"))
    heads = ends.select("scan_id", (F.col("photo") - 1).alias("photo"), F.col("head").alias("next_head"))
    tails = ends.select("scan_id", (F.col("photo") + 1).alias("photo"), F.col("tail").alias("prev_tail"))
    # one row a page: pages meet pages, then lines their page
    edges = ends.select("scan_id", "photo").join(heads, ["scan_id", "photo"], "left").join(tails, ["scan_id", "photo"], "left")
    return body.join(edges, ["scan_id", "photo"])


def line_defects(spans: DataFrame, scans: DataFrame) -> DataFrame:
    """(span_id, defect): headers, page numbers, split words and misread words of booklets."""
    lines = cut(booklet_lines(spans, scans))
    body = lines.where("zone = 'body'")
    found = by_group(with_page_edges(body), ["scan_id", "photo"], ["y", "x", "span_id"], _defects(*lexicon(body)), "span_id long, defect string")
    return found.unionByName(lines.where("zone <> 'body'").select("span_id", F.col("zone").alias("defect")))


def boundaries(lines: list[tuple[float, float, str]]) -> list[bool]:
    """Which lines (x, width, text) begin a paragraph: the cheapest labelling of the page."""
    left = sorted(x for x, _, _ in lines)[len(lines) // 2]
    full = sorted(x + w for x, w, _ in lines)[int(len(lines) * 0.75)]
    cost, back = (0.0, 0.0), []  # of the last line going on, of it beginning a paragraph
    for i, (x, _, _) in enumerate(lines):
        begins = -2.0 if x - left > 12 else 1.0
        if i:
            px, pw, pt = lines[i - 1]
            begins += (-1.0 if px + pw < full - 60 else 0.5) + (-0.5 if pt[-1:] in ".!?:" else 1.5)
        goes_on = 0.0
        choice = (0 if cost[0] <= cost[1] else 1, 0 if cost[0] <= cost[1] + 0.5 else 1)
        back.append(choice)
        # two paragraphs of one line each are less likely
        cost = (min(cost[0], cost[1]) + goes_on, min(cost[0], cost[1] + 0.5) + begins)
    state, out = (0 if cost[0] <= cost[1] else 1), []
    for choice in reversed(back):
        out.append(bool(state))
        state = choice[state]
    return out[::-1]


def _paragraphs(counts: list[tuple[str, int]], total: int):
    made: list[Lexicon] = []

    def run(g: pa.RecordBatch) -> list[tuple]:
        if not made:
            made.append(Lexicon(counts, total))
        lex = made[0]
        scan, photo, x, w, texts, heads, tails = (g.column(c).to_pylist() for c in ("scan_id", "photo", "x", "w", "text", "next_head", "prev_tail"))
        begins, out, text = boundaries(list(zip(x, w, texts))), [], ""
        for i, (words, _, _) in enumerate(read_page(texts, heads[0], tails[0], lex)):
            if begins[i] and text:
                out.append(text)
                text = ""
            text = f"{text} {' '.join(words)}".strip()
        out.append(text)
        return [(scan[0], photo[0], k, k == 0 and not begins[0] and tails[0] is not None, t) for k, t in enumerate(out)]

    return run


def _opened(pages: DataFrame) -> DataFrame:
    """(scan_id, photo, k): the paragraph that is open at the end of each page.

    pages: (scan_id, photo, k), k the last one that begins on the page or null. A page without
    one hands on what is open before it; such runs are followed by pointer jumping, so that no
    booklet is sorted as a whole.
    """
    t = cut(pages.withColumn("back", F.col("photo") - 1))
    while True:
        idle, done = t.where("k is null"), t.where("k is not null")
        other = t.select("scan_id", F.col("photo").alias("back"), F.col("k").alias("k2"), F.col("back").alias("back2"))
        moved = cut(idle.join(other, ["scan_id", "back"]).select("scan_id", "photo", F.col("k2").alias("k"), F.col("back2").alias("back")))
        if moved.isEmpty():
            return done.select("scan_id", "photo", "k")
        t = cut(done.unionByName(moved))  # a page without any before it stays without


def paragraphs(spans: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, photo, pos, text): readable paragraphs, each on the page where it begins.

    A page's first piece joins the last paragraph before it when it does not begin one itself.
    """
    lines = cut(booklet_lines(spans, scans))
    body = lines.where("zone = 'body'")
    counts = lexicon(body)
    rows = with_page_edges(body)
    pieces_ = by_group(rows, ["scan_id", "photo"], ["y", "x", "span_id"], _paragraphs(*counts), "scan_id string, photo int, pos int, continues boolean, text string")
    pieces_ = cut(pieces_)
    key = F.struct("photo", "pos")
    opened = _opened(pieces_.groupBy("scan_id", "photo").agg(F.max(F.when(~F.col("continues"), key)).alias("k")))
    before = opened.select("scan_id", (F.col("photo") + 1).alias("photo"), F.col("k").alias("k_before"))
    p = pieces_.join(before, ["scan_id", "photo"], "left").withColumn("k", F.coalesce(F.when(F.col("continues"), F.col("k_before")), key))
    parts = F.array_sort(F.collect_list(F.struct("photo", "pos", "text")))
    p = p.groupBy("scan_id", "k").agg(parts.alias("parts"))
    return p.select("scan_id", "k.photo", "k.pos", F.concat_ws(" ", F.filter(F.transform("parts", lambda x: x["text"]), lambda t: t != "")).alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_defects(table(spark, sf_dir, "text_spans"), table(spark, sf_dir, "scans"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "text_spans"), table(spark, sf_dir, "scans"))


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
