"""Goods whose words are in no vocabulary link inside their brand all the same."""

import random
from collections import Counter

from labelloom.llm import names


def test_rare_goods_typed_with_slips(spark):
    rows = [("Zatebeke", "Quinoapuffs"), ("Zatebeke", "Quinaopuffs"), ("Zatebeke", "Murukku Tandoori"), ("Zatebeke", "Tandoori Murruku"), ("Zatebeke", "Tandori Murukku")]
    rows += [("Zatebeke", "Keshavari Soap"), ("Zatebeke", "Keshavari Soup"), ("Vijusiki", "Quinoapufs")]
    rows += [("Other Brand", g) for g in ("Soap", "Soup") for _ in range(4)]
    keys = spark.createDataFrame([(i, b, g) for i, (b, g) in enumerate(rows)], "key_id long, brand string, common_name string")
    got = {tuple(r) for r in names.same_pairs(names.linked_names(keys), "key_id", ["brand_id", "goods_id"]).collect() if r.key_id_a < 8}
    assert got == {(0, 1), (2, 3), (2, 4), (3, 4)}


def test_shortened_words_of_long_names_and_long_short_forms(spark):
    rest = "rose mint lime palm fern iris lily moss sage reed dune cove".split()
    full = "anti" * 11 + "dandruff"  # 52 letters
    goods = [[*rest, "powder"]] * 4 + [[*rest, "pwd"]] * 2 + [["clove", full]] * 4 + [["clove", full[:45]]] * 2 + [["cedar", "refreshment"]] * 4 + [["cedar", "refreshmn"]] * 2
    rows = spark.createDataFrame(list(enumerate(goods)), "key_id long, n array<string>")
    words = rows.selectExpr("explode(n) w").groupBy("w").count().withColumnRenamed("count", "n_name")
    assert {tuple(r) for r in names.shortened(rows, words).collect()} >= {("pwd", "powder"), (full[:45], full), ("refreshmn", "refreshment")}


def _swapped(w, *at):
    for i in at:
        w = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    return w


def test_no_pair_in_reach_is_missed():
    rng = random.Random(5)
    for _ in range(4000):
        w = c = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 26)))
        for _ in range(rng.randrange(1, names.reach(len(w)) + 1)):
            i = rng.randrange(len(c) - 1)
            c = rng.choice([c[:i] + c[i + 1 :], c[:i] + "x" + c[i:], c[:i] + "y" + c[i + 1 :], _swapped(c, i)])
        if names.edits(w, c, r := min(names.reach(len(w)), names.reach(len(c)))) <= r and w != c:
            assert set(names._indexed(w)) & set(names._probes(c)) and set(names._indexed(c)) & set(names._probes(w))
    w = "abcdefghijkl"
    assert set(names._indexed(w)) & set(names._probes(_swapped(w, 2, 8)))


def test_no_key_grows_to_a_share_of_all_words():
    rng = random.Random(6)
    words = {"".join(rng.choice("bdfgjklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)}
    held = Counter(k for w in words for k in set(names._indexed(w)))
    assert max(held.values()) < 0.01 * len(words)


def test_firm_words_are_found_as_by_trying_all():
    rng = random.Random(7)
    for _ in range(1500):
        w = rng.choice([plain for _, plain, _ in names._LONG])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeknrst") + w[i:], _swapped(w, min(i, len(w) - 2))]) if len(w) > 3 else w
        f = names.fold(w)
        near = [i for i, (g, plain, _) in enumerate(names._LONG) if (len(plain) == len(w) == 4 and sorted(w) == sorted(plain)) or (len(plain) >= 5 and (names.edits(w, plain, k := 2 if len(plain) >= 8 else 1) <= k or (len(g) >= 6 and names.edits(f, g, 1) <= 1)))]
        assert set(near) <= set(names._long_near(w, f, names._LONG))


def test_long_words_run_together():
    known = names.spellings(["multigrained", "strawberrymousse", "soap"])
    split = names._Splitter(known)
    assert split.of("multigrainedstrawberrymousse") == "multigrained strawberrymousse"
    assert split.of("multigrainedstrawberymouse") == "multigrained strawberrymousse" and split.of("soapmultigrainedx") == "soap multigrained"
