"""Operators against brute force, exact properties or small cases with known answers."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import leaks, listings, lookalikes, names, packing, scanned, spans


def text(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


# ---- shared spans -----------------------------------------------------------------------


def brute_pairs(rows, n):
    grams = {}
    for d, t in rows:
        for i in range(len(t) - n + 1):
            grams.setdefault(t[i : i + n], set()).add(d)
    return {p for g in grams.values() for p in itertools.combinations(sorted(g), 2)}


@pytest.mark.parametrize("limit", [1, 48])
def test_shared_pairs_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    parts = [text(rng, 60) for _ in range(6)]
    near = [p[:39] for p in parts]
    rows = [(i, text(rng, rng.randrange(0, 90)) + rng.choice(parts + near) + text(rng, rng.randrange(0, 50)) + rng.choice(near)) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]  # copies
    want = brute_pairs(rows, 40)
    got = spans.shared_pairs(spark.createDataFrame(rows, "doc_id long, text string"), span=40, q=20, pair_limit=limit)
    assert {tuple(r) for r in got.collect()} == want


def test_intervals_decide(spark):
    """Windows of one min-hash whose intervals do not overlap by a stretch are no candidates."""
    rng = random.Random(2)
    core = text(rng, 24)  # shorter than a stretch: shares the min-hash, not the stretch
    rows = [(i, text(rng, 40) + core + text(rng, 40)) for i in range(20)]
    assert spans.shared_pairs(spark.createDataFrame(rows, "doc_id long, text string"), span=40, q=20).count() == len(brute_pairs(rows, 40)) == 0


def test_one_passage_in_very_many_texts(spark):
    rng = random.Random(9)
    long_, short = text(rng, 90), text(rng, 35)
    rows = [(i, text(rng, 30) + (long_ if i % 4 == 0 else short) + text(rng, 30)) for i in range(240)]
    got = spans.shared_pairs(spark.createDataFrame(rows, "doc_id long, text string"), span=40, q=20, pair_limit=8)
    assert {tuple(r) for r in got.collect()} == brute_pairs(rows, 40)


@pytest.mark.parametrize("limit", [1, 48])
def test_shared_fraction_counts_covered_characters(spark, limit):
    rng = random.Random(5)
    s = text(rng, 100)
    rows = [(1, "x" * 30 + s + "y" * 70), (2, s), (3, "z" * 100), (4, "z" * 100), (5, text(rng, 200))]
    r = {x.doc_id: (x.n_chars, x.n_shared, x.n_copies) for x in spans.shared_fraction(spark.createDataFrame(rows, "doc_id long, text string"), span=40, q=20, pair_limit=limit).collect()}
    assert r == {1: (200, 100, 0), 2: (100, 100, 0), 3: (100, 100, 1), 4: (100, 100, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 12))
def test_compact_windows_are_the_wide_nodes_of_the_tree(values, t):
    h = np.array(values, dtype=np.uint64) << np.uint64(20)
    c, left, right = spans.compact_windows(h, t, np.ones(len(h), dtype=bool))

    def nodes(lo, hi):
        if hi - lo + 1 < t:
            return []
        m = min(range(lo, hi + 1), key=lambda i: (h[i], i))
        return [(m, max(lo, m - t + 1), min(hi, m + t - 1)), *nodes(lo, m - 1), *nodes(m + 1, hi)]

    assert sorted(zip(c.tolist(), left.tolist(), right.tolist())) == sorted(nodes(0, len(h) - 1))


# ---- leaks ------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "ee", "ilo", "un")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(12)]
    docs = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 120))]
        k, n = rng.randrange(12), rng.choice([15, 18, 19, 20, 21, 40])
        start = rng.randrange(0, 41 - n)
        part = items[k][1].split()[start : start + n]
        at = rng.randrange(len(w))
        sep = rng.choice([" ", "\n", ", ", " - "])
        docs.append((i, " ".join(w[:at]) + " " + sep.join(x.upper() if rng.random() < 0.3 else x for x in part) + "! " + " ".join(w[at:])))
    index = {}
    for i, t in items:
        w = t.split()
        for j in range(21):
            index.setdefault(tuple(w[j : j + 20]), set()).add(i)
    import re

    want = {(d, i) for d, t in docs for w in [re.findall("[a-z]+", t.lower())] for j in range(len(w) - 19) for i in index.get(tuple(w[j : j + 20]), ())}
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 30


def test_words_of_compounds_count_once():
    x = leaks.Items([(1, "an air-tight jar")])
    assert (x.ended[4] - x.begun[1], x.ended[3] - x.begun[1]) == (3, 2)


def test_cells_find_what_brute_force_finds():
    rng = np.random.default_rng(1)
    x = leaks._unit(rng.standard_normal((300, 8)).astype(np.float32))
    z = leaks._unit(x[rng.integers(0, 300, 200)] + rng.standard_normal((200, 8)).astype(np.float32) * 0.05)
    a, b, _ = leaks.Cells(x, 0.98).search(z)
    got, want = set(zip(a.tolist(), b.tolist())), set(zip(*(v.tolist() for v in np.nonzero(z @ x.T >= 0.98))))
    assert got <= want and len(got) >= 0.9 * len(want)
    a, b, _ = leaks.Cells(x, 0.999).search(x)
    assert set(zip(a.tolist(), b.tolist())) >= {(i, i) for i in range(300)}  # equal vectors are never missed


def reworded(rng, n=60):
    """Items, and documents with copies of which every k-th word is another one; (doc, item, share kept)."""
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgklmnprst" for b in ("a", "ee", "ilo", "un") for c in ("", "no", "rt")]
    items = [(i, " ".join([*(rng.choice(vocabulary) for _ in range(40)), f"{100 + i} mm", *(rng.choice(vocabulary) for _ in range(8))])) for i in range(12)]
    docs, true = [], []
    for d in range(n):
        i, k = rng.randrange(12), rng.choice([3, 6, 8, 12])
        words = [w if (j + d) % k or w.isdigit() else "altered" + rng.choice("xyz") for j, w in enumerate(items[i][1].split())]
        other = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        docs.append((d, " ".join([*other, *words, *other])))
        true.append((d, i, sum("altered" not in w for w in words) / 50))
    return items, docs, true


def test_reworded_copies_are_found(spark):
    items, docs, true = reworded(random.Random(6))
    got = {(r.doc_id, r.item_id): r for r in leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), report=True).collect()}
    want = {(d, i) for d, i, share in true if share >= leaks.IN_ORDER}
    found = {k for k, r in got.items() if r.lcs_share >= leaks.IN_ORDER and r.answers_found == 1}
    assert found <= want and len(found) >= 0.9 * len(want) and len(want) > 20


@pytest.mark.parametrize("off", ["space", "lcs"])
def test_reworded_copies_need_every_step(spark, monkeypatch, off):
    """Without the latent space nothing is a candidate; without the subsequence no reworded copy is told."""
    items, docs, _ = reworded(random.Random(6), 20)
    if off == "space":
        monkeypatch.setattr(leaks, "latent_space", lambda docs, items, overlap: np.zeros((len(items.terms), leaks.KEEP), dtype=np.float32))
    else:
        monkeypatch.setattr(leaks, "_compare", lambda items, item, region: None)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = leaks.leaked(d, i, report=True).collect()
    assert not [r for r in rows if r.lcs_share >= leaks.IN_ORDER and r.run_words < leaks.MIN_WORDS]


def test_a_long_item_copied_whole(spark):
    item = " ".join(f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "ee", "ilo", "un", "ort", "ame")) + " 17 kg"
    r = leaks.leaked(spark.createDataFrame([(1, "Start. " + item + " End.")], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"), report=True).collect()
    assert [(x.run_words, x.lcs_share, x.answers_found) for x in r] == [(80, 1.0, 1.0)]


# ---- packing ----------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_uses_every_item_once(sizes):
    count = np.bincount(np.array(sizes, dtype=int), minlength=25)
    used = np.zeros(25, dtype=int)
    for pattern, times in packing.plan(count, 24):
        assert sum(x * k for x, k in pattern.items()) <= 24
        for x, k in pattern.items():
            used[x] += k * times
    assert (used == count).all()


def test_plan_meets_the_least_number_of_containers():
    count = np.bincount([10, 10, 5, 5, 5, 4, 3, 3, 3, 2], minlength=11)
    assert sum(t for _, t in packing.plan(count, 10)) == 5


def test_exact_fill_prefers_fewer_items():
    count = np.bincount([7, 5, 2, 3, 3, 1], minlength=21)
    assert packing.exact_fill(count, 7) == [7] and packing.exact_fill(count, 8) == [7, 1] and sorted(packing.exact_fill(count, 13)) == [1, 5, 7] and packing.exact_fill(count, 20) is None


def test_containers_hold_whole_items(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 5, 17, 100, 100, 60, 250])) for i in range(500)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacity=100, salts=3).collect()
    fill: dict = {}
    for r in packed:
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(n for _, n in rows)
    parts: dict = {}
    for r in packed:
        parts.setdefault(r.doc_id, []).append(r.n_tokens)
    assert all(sorted(parts[i]) == sorted([100] * (n // 100) + [n % 100] * bool(n % 100 or not n)) for i, n in rows)


# ---- look-alikes ------------------------------------------------------------------------


@pytest.mark.parametrize("raw,lang,form", [
    ("Prоtein", "en", "Protein"), ("ＭＲＰ　１０", "en", "MRP 10"), ("Сделaно", "ru", "Сделано"), ("Eλαιόλαδo", "el", "Ελαιόλαδο"), ("Café", "fr", "Café"), ("Café", "fr", "Café"), ("in­clusive", None, "inclusive"), ("ﬁlm", "en", "film"), ("re‑use", "en", "re-use"),
    ("पक्‍का स्वाद", "hi", "पक्‍का स्वाद"), ("पक्का​ स्वाद", "hi", "पक्का स्वाद"), ("१２ ग्राम", "hi", "१2 ग्राम"), ("Καθαρό βάρος 9 g", "el", "Καθαρό βάρος 9 g"), ("½ cup – 4 °C ™ “x” ₹ 5²", "en", "½ cup – 4 °C ™ “x” ₹ 5²"), ("Масса 5 г", "ru", "Масса 5 г"), ("Масса 5 г", "en", "Масса 5 г"), ("", "en", ""),
])
def test_one_form(raw, lang, form):
    assert lookalikes.canonical_text(raw, lang) == form
    assert lookalikes.canonical_text(form, lang) == form


def test_trie_walks_look_alikes_for_nothing():
    t = lookalikes.Trie([("экспорта", 5), ("paper", 9), ("café", 3), ("film", 2)])
    assert t.canonical("экcпoртa", "CYRILLIC") == "экспорта" and t.canonical("pа\u200bper") == "paper" and t.canonical("papar") is None and t.canonical("papar", budget=1) == "paper"
    assert t.canonical("cafe\u0301") == "café" and t.canonical("ﬁlm") == "film" and t.canonical("ｐａｐｅｒ") == "paper"


@pytest.mark.parametrize("raw,form", [("ρaper", "paper"), ("pᴀper", "paper"), ("paper\U000e0101", "paper"), ("p\u2065aper", "paper")])
def test_the_vocabulary_confirms_letters_nearly_alike(raw, form):
    words = [("paper", 9)]
    assert lookalikes.canonical_text(raw, "en", lookalikes.Trie(words)) == form
    if raw[1] in "aᴀ" and raw[-1] == "r":  # the table alone leaves these
        assert lookalikes.canonical_text(raw, "en", None) == raw


def test_found_lines_need_the_trie(spark):
    rows = [(i, "paper on the label", "en", None) for i in range(5)] + [(9, "ρaper on the label", "en", None), (10, "σ = 5 ρ", "en", None), (11, "क़लम", "hi", None), (12, "क़लम", "hi", None)]
    s = spark.createDataFrame(rows, "span_id long, text string, lang string, ingested_at timestamp")
    assert [r.span_id for r in lookalikes.suspects(s).collect()] == [9]
    form = {r.span_id: r.text for r in lookalikes.canonical_spans(s).collect()}
    assert form[9] == form[0] and form[11] == form[12]


# ---- scanned pages ----------------------------------------------------------------------


def page(n, lines, first, scan="b", photo=0):
    return [(first + i, scan, photo, t, 40.0, y, 400.0, 20.0, "en", None) for i, (t, y) in enumerate(lines)]


def test_defects_of_a_booklet(spark):
    body = ["the outer carton holds the sample and the label was close to the lower edge of it", "the sample on the label was measured and the outer carton kept in the cold room for it"]
    rows, n = [], 0
    for p in range(40):
        lines = [("FIELD NOTES", 60.0), *((body[i % 2], 100.0 + 24 * i) for i in range(12)), (f"- {p + 1} -", 440.0)]
        if p == 3:
            lines[4] = ("the outer carfon holds the sam-", 172.0)
            lines[5] = ("ple and the lower-edge label of it", 196.0)
        if p == 5:
            lines[12] = ("kept in the cold room and mea-", 364.0)
        if p == 6:
            lines[1] = ("sured on the label of it", 100.0)
        rows += page(p, lines, n, photo=p)
        n += len(lines)
    spans_ = spark.createDataFrame(rows, "span_id long, scan_id string, photo int, text string, x double, y double, w double, h double, lang string, ingested_at timestamp")
    scans = spark.createDataFrame([("b", "booklet")], "scan_id string, category string")
    got = {(r.span_id, r.defect) for r in scanned.line_defects(spans_, scans).collect()}
    assert {s for s, d in got if d == "page_header"} == {14 * p for p in range(40)}
    assert {s for s, d in got if d == "page_number"} == {14 * p + 13 for p in range(40)}
    assert {s for s, d in got if d == "split_word"} == {14 * 3 + 4, 14 * 5 + 12}
    assert {s for s, d in got if d == "misread"} == {14 * 3 + 4}
    text_ = " ".join(r.text for r in scanned.paragraphs(spans_, scans).collect())
    assert "the outer carton holds the sample and the lower-edge" in text_ and "room and measured on the label" in text_ and "FIELD" not in text_


def test_lexicon_corrects_only_to_commoner_words():
    lex = scanned.Lexicon([("carton", 500), ("corner", 400), ("modern", 30), ("tile", 60), ("file", 70)], 10_000)
    assert lex.best("cartori")[1:] == ("carton", True) and lex.best("corncr")[1:] == ("corner", True) and lex.best("tile")[1:] == ("tile", False) and lex.best("modem")[1:] == ("modern", True)


@pytest.mark.parametrize("last,following,kind", [("tamper-", "evident,", "compound"), ("mea-", "surement", "word"), ("re¬", "count", "word"), ("plain", "text", ""), ("BH8760-", "2", ""), ("-", "x", ""), ("mea", "surement", "word"), ("carton", "file", "")])
def test_line_ends(last, following, kind):
    lex = scanned.Lexicon([("tamper-evident", 40), ("tamper", 40), ("evident", 40), ("measurement", 50), ("recount", 9), ("carton", 9), ("file", 9)], 1000)
    assert [s.kind for s in scanned.decode([["the", last], [following, "end"]], lex) if s.kind] == ([kind] if kind else [])


def test_the_stream_decides_jointly():
    """A cut word that was misread as well, a lost gap and a gap too many, over three lines and two page edges."""
    lex = scanned.Lexicon([(w, 500) for w in "the outer carton holds sample measured under cold light".split()], 5000)
    got = scanned.read_page(["outer carfon ho", "lds the sam ple mea-", "surcd undercold"], "light the", "the cold", lex)
    assert [" ".join(w) for w, _, _ in got] == ["outer carton holds", "the sample measured", "under cold"]
    assert [g for _, g, _ in got] == [True, True, False] and [b for _, _, b in got] == [True, True, True]


def test_defects_need_the_lattice(spark, monkeypatch):
    """With words read one by one no word goes on over a line's end."""
    lex = scanned.Lexicon([("measured", 50), ("the", 90)], 1000)
    assert scanned.read_page(["the mea-", "sured the"], None, None, lex)[0][1]
    monkeypatch.setattr(scanned, "_over_the_end", lambda *a: iter(()))
    assert not scanned.read_page(["the mea-", "sured the"], None, None, lex)[0][1]


def test_words_of_other_scripts_are_corrected():
    lex = scanned.Lexicon([("паровоз", 900), ("étiquette", 900)], 3000)
    assert lex.best("паравоз")[1] == "паровоз" and lex.best("etiquette")[1] == "étiquette"


@pytest.mark.parametrize("t,ok", [("Page 3 of 12", True), ("- 7 -", True), ("xiv", True), ("[12]", True), ("p. 4", True), ("FIELD NOTES", False), ("12 packs", False), ("Notes | 3", False)])
def test_page_numbers(t, ok):
    assert bool(scanned.PAGE_NUMBER.match(t)) is ok


# ---- names ------------------------------------------------------------------------------


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert names.edits(a, b, k) == min(osa(a, b), k + 1)


def test_segment_join_finds_what_brute_force_finds(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("bcd") + rng.choice("ae") for _ in range(rng.randrange(2, 5))) for _ in range(250)}
    df = spark.createDataFrame([("", w) for w in words], "scope string, w string")
    got = {(r.w, r.c) for r in names.segment_join(df, df).collect()}
    want = {(a, b) for a in words for b in words if a != b and names.edits(a, b, r := min(names.reach(len(a)), names.reach(len(b)))) <= r}
    plain = {(a, b) for a, b in want if sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)) <= 1}
    assert got <= want and plain <= got and len(got) >= 0.97 * len(want)


def test_names_of_one_maker(spark):
    rows = [(1, "Shri Zatebeke Home Care", "Mango Drink"), (2, "zatebeke HC Pvt Ltd", "Drink, Mango"), (3, "Zatebkee", "mangho drnk"), (4, "Mango Drink", "Sri Zate-beke Homecare"), (5, "Zatebeke Home Care", "Fresh Mango Drink"), (6, "Bob Fezagazil Mills", "Mango Drink"), (7, "Robert Fezagazil", "MangoDrink")]
    rows += [(100 + i, "Other Brands", g) for i, g in enumerate(["Mango Drink", "Mango Drink", "Fresh Mango Drink", "Fresh Soap", "Fresh Soap"])]
    ids = names.linked_names(spark.createDataFrame(rows, "key_id long, brand string, common_name string"))
    got = {tuple(r) for r in names.same_pairs(ids, "key_id", ["brand_id", "goods_id"]).collect() if r.key_id_b < 100}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)}


# ---- listings ---------------------------------------------------------------------------


def listings_of(spark, rows):
    return spark.createDataFrame([(i, a, b, None, None) for i, a, b in rows], "listing_id long, title string, text string, seller string, ingested_at timestamp")


def groups_of(spark, rows):
    return {r.listing_id: r.product_id for r in listings.product_groups(listings_of(spark, rows)).collect()}


def test_what_one_listing_says():
    got = listings.light("BODETAJU Face Wash Honey 6.8 fl oz (Hot Deal) EAN 4006381333931 Model: KX-20/7", "Net Qty: Set of 2, 200 ml each\nBrand: Bodetaju Industries\nFlavour/Fragrance: Sea Breeze", "Some Traders")
    assert (got["core"], got["dim"], round(got["size"]), got["converted"], got["units"], got["gtins"], got["part"]) == ("bodetaju", "ml", 201, True, 2, ["04006381333931"], "kx207")
    assert [w["w"] for w in got["words"]] == ["bodetaju", "face", "wash", "honey", "hot", "deal"] and [w["apart"] for w in got["words"]] == [False] * 4 + [True] * 2
    assert got["variant"] == ["sea", "breeze"]


def market(n=40):
    """Listings of a few products with sales talk in brackets and without, and slips."""
    rng = random.Random(4)
    talk, rows, true = ["Hot Deal", "Great Taste", "Top Rated"], [], {}
    for i in range(n * 6):
        p = (rng.choice(["Zubamav", "Kesolit"]), rng.choice(["Rose Soap", "Extra Hot Pickle", "Pine Glass Cleaner"]), rng.choice([100, 250]))
        t = rng.choice(talk)
        title = [p[0], p[1], f"{p[2]} g", rng.choice([t, f"({t})", f"[{t}]", ""])]
        rng.shuffle(title)
        rows.append((i, " ".join(title).replace("Cleaner", rng.choice(["Cleaner"] * 9 + ["Cleanerr"])), rng.choice([f"Brand: {p[0]}", f"Make - {p[0]} Foods", None])))
        true[i] = p
    return rows, true


def test_sales_talk_is_learned(spark):
    rows, true = market()
    got = groups_of(spark, rows)
    assert all((got[a] == got[b]) == (true[a] == true[b]) for a, b in itertools.combinations(true, 2))


@pytest.mark.parametrize("t,n", [("3 x 500 g", 3), ("500g*4", 4), ("pack of 6 75 g", 6), ("set of 2, 1 l each", 2), ("(12 pcs)", 12), ("2n 0.25 kg", 2), ("twin pack 2 litre each", 2), ("500 g", None)])
def test_numbers_of_units(t, n):
    assert listings.units_of(t) == n


def test_identifiers_join_only_what_agrees(spark):
    code = "4006381333931"
    rows = [(1, f"Zuba Rose Soap 100 g {code}", None), (2, f"Zuba Soap {code}", "Variant: Rose"), (3, "Pine Oil 1 l 4006381333930", "Brand: Other"), (4, "Zuba Rose Soap 100 g", None)]
    rows += [(10 + i, "Zuba x", "Variant: Rose\nBrand: Zuba") for i in range(3)]
    g = groups_of(spark, rows)
    assert g[1] == g[2] == g[4] and g[3] != g[1]
    assert listings.gtin_valid(code) and not listings.gtin_valid("4006381333930")


@pytest.mark.parametrize("ids", [(1, 2, 3), (3, 1, 2), (2, 3, 1)])
def test_a_code_alone_joins_no_contradictions(spark, ids):
    a, b, c = ids
    rows = [(a, "EAN 4006381333931", None), (b, "Zubamav Rose Soap 100 g EAN 4006381333931", "Brand: Zubamav"), (c, "Kesolit Rose Soap 100 g EAN 4006381333931", "Brand: Kesolit")]
    g = groups_of(spark, rows)
    assert len(set(g.values())) == 3


def test_a_code_joins_no_other_size_or_count(spark):
    code = "EAN 4006381333931"
    rows = [(1, f"Zubamav Rose Soap 100 g {code}", "Brand: Zubamav"), (2, f"Zubamav Rose Soap 4 x 750 g {code}", "Brand: Zubamav"), (3, f"Zubamav Fine Rose Soap 100 g {code}", "Brand: Zubamav")]
    g = groups_of(spark, rows)
    assert g[1] == g[3] != g[2]


def test_chains_over_codes_do_not_join_contradictions(spark):
    x, y = "EAN 4006381333931", "EAN 5901234123457"
    rows = [(1, f"Zubamav Rose Soap 100 g {x}", "Brand: Zubamav"), (2, f"{x} {y}", None), (3, f"Kesolit Rose Soap 100 g {y}", "Brand: Kesolit")]
    assert len(set(groups_of(spark, rows).values())) == 3


def test_part_numbers_join_inside_a_brand(spark):
    rows = [(1, "Zubamav Kettle Model: KX-20", "Brand: Zubamav"), (2, "Zubamav Steel Kettle model no. - kx 20", "Brand: Zubamav"), (3, "Kesolit Kettle Model: KX-20", "Brand: Kesolit")]
    g = groups_of(spark, rows)
    assert g[1] == g[2] != g[3]


def test_abbreviations_name_the_same_things(spark):
    words = spark.createDataFrame([("", w, n) for w, n in [("powder", 50), ("pwd", 9), ("pod", 9), ("noodles", 30), ("nood", 4), ("cream", 20), ("crm", 3)]], "scope string, w string, n long")
    things = spark.createDataFrame([("", w, t, 1) for w, t in [("powder", 1), ("powder", 2), ("pwd", 1), ("pwd", 2), ("pod", 7), ("noodles", 3), ("nood", 3), ("cream", 4), ("crm", 4)]], "scope string, w string, thing long, n long")
    assert {(r.w, r.c) for r in names.abbreviations(words, things).collect()} == {("pwd", "powder"), ("nood", "noodles"), ("crm", "cream")}


def test_shortened_words_are_learned(spark):
    goods = ["Rose Powder"] * 4 + ["Rose Powder", "Mint Powder", "Rose Pwdr", "Mint Pwd", "Rose Pwd", "Fresh Powder", "Fresh Pwd"] * 3 + ["Rose Pod", "Rose Soap", "Rose Soap", "Mint Soap"] * 3
    keys = spark.createDataFrame([(i, "Zatebeke", g) for i, g in enumerate(goods)], "key_id long, brand string, common_name string")
    ids = {r.key_id: r.goods_id for r in names.linked_names(keys).collect()}
    of = {g: {ids[i] for i, x in enumerate(goods) if x == g} for g in goods}
    assert of["Rose Powder"] == of["Rose Pwdr"] == of["Rose Pwd"] and of["Mint Powder"] == of["Mint Pwd"] and len(of["Rose Powder"]) == 1
    assert of["Rose Powder"] != of["Mint Powder"] and of["Rose Powder"] != of["Rose Soap"]


@pytest.mark.parametrize("w,kind", [("bev", "business"), ("trdg", "business"), ("co", "business"), ("ent", "business"), ("industr", "business"), ("pvt", "legal"), ("ltd", "legal"), ("bob", "given"), ("zatebeke", None), ("kukuvayo", None), ("zub", None)])
def test_words_of_firms(w, kind):
    k = names._firm_word(w, names._LISTS, names._LONG)
    assert (k and k[0]) == kind
