"""Forms of texts that look alike, against the table and literal cases."""

import itertools
import random

import pytest

from blattwerk.llm import glyphs as G

SAME = [("Deﬁnition", "Definition"), ("Ｐｆｌｉｃｈｔ", "Pflicht"), ("Wеrtраріеr", "Wertpapier"), ("Café", "Café"), ("über", "über"), ("K", "K"), ("νοn", "von"), ("Sto­rung", "Storung"), ("AB‑42", "AB-42"),
        ("a b", "a b"), ("a　b", "a b"), ("﻿ab​", "ab"), ("Å", "Å"), ("ёлка", "ëлкa"), ("…", "..."), ("Ⅷ", "VIII"), ("a\tb", "a b")]
DIFFERENT = ["m2", "m²", "①", "1", "½", "1/2", "Maße", "Masse", "Cafe", "Café", "a", "α", "A", "ſ", "s", "10³", "103", "O", "0", "l", "I", "–", "-", "a b", "ab", "a  b"]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert G.by_table(a) == G.by_table(b)


def test_different():
    assert len({G.by_table(x) for x in DIFFERENT}) == len(DIFFERENT)


def test_trie_costs():
    trie = G.Trie()
    for w, n in (("Definition", 5), ("Раздел", 3), ("Cafe", 1), ("Café", 9)):
        trie.add(w, n)
    assert trie.nearest("Deﬁnition") == (0, "Definition") and trie.nearest("Def​inition") == (0, "Definition")
    assert trie.nearest("Paздeл") == (0, "Раздел") and trie.nearest("Café") == (0, "Café") and trie.nearest("Caf") is None
    assert trie.nearest("Defintion", 1.0) == (1.0, "Definition") and trie.nearest("Dxfintion", 1.0) is None and trie.nearest("Dxfintion", 2.0)[0] == 2.0
    assert trie.nearest("") is None


def test_the_automaton_compares_raw_characters():
    """The trie holds spellings as written; look-alikes and ignorables are matched on the way, from either side."""
    trie = G.Trie()
    for w in ("Раздел", "Café", "CCCP", "Ⅷ"):
        trie.add(w, 1)
    assert set(trie.root.edges) == {"Р", "C", "Ⅷ"} and set(trie.root.edges["C"].edges) == {"a", "C"}
    assert trie.nearest("Pa\u200bздeл") == (0, "Раздел") and trie.nearest("СССР") == (0, "CCCP") and trie.nearest("VIII") == (0, "Ⅷ") and trie.nearest("Cafe\u0301") == (0, "Café")
    assert trie.nearest("CCC") is None and trie.nearest("CCCPP") is None and trie.nearest("VIIII", 1.0) == (1.0, "Ⅷ")


def test_look_alikes_of_the_automaton_alone():
    """A confusable that no table knows is found by the automaton that is told of it, at no cost; the table leaves it as it is."""
    lisu = "ꓲ"  # drawn as I
    assert G.by_table(lisu + "nstitut") == lisu + "nstitut"
    plain, told = G.Trie(), G.Trie({lisu: "I", "ꝏ": "oo"})
    for trie in (plain, told):
        trie.add("Institut", 3)
        trie.add("Boot", 1)
    assert plain.nearest(lisu + "nstitut") is None and told.nearest(lisu + "nstitut") == (0, "Institut") and told.nearest("Bꝏt") == (0, "Boot")
    assert G.spell(lisu + "nstitut", told) == "Institut" and G.spell(lisu + "nstitut", plain) == lisu + "nstitut"


def test_only_unmatched_tokens_go_by_table(spark, monkeypatch):
    calls = []
    table = G.by_table
    monkeypatch.setattr(G, "by_table", lambda t: calls.append(t) or table(t))
    trie = G.Trie()
    trie.add("Раздел", 1)
    assert G.spell("Paздeл", trie) == "Раздел" and calls == [] and G.spell("ｘ", trie) == "x" and calls == ["ｘ"]


def test_crowded_beginnings_are_split(spark, monkeypatch):
    words = [(f"Unterlage{n:03d}", 1) for n in range(60)] + [(f"Unterl\u0430ge{n:03d}", 1) for n in range(60)] + [("Ende", 1)]
    df = spark.createDataFrame(words, "token string, anzahl long")
    want = {(f"Unterl\u0430ge{n:03d}", f"Unterlage{n:03d}") for n in range(60)}
    for limit in (20_000, 10):
        monkeypatch.setattr(G, "PER_GROUP", limit)
        assert {tuple(r) for r in G.spellings(df).collect()} == want


def test_spellings():
    assert all(map(G.is_spelling, ("Café", "Раздел", "m²", "AB-42"))) and not any(map(G.is_spelling, ("Café", "Wеrt", "ﬁn", "a​b", "AB‑42")))


def test_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["Pflicht der Stelle", "Definition m²", "Definition m2", "Café-Filialen (7)", "Раздел 5", "", "x" * 5000]
    tricks = [lambda s: s, lambda s: s.replace("e", "е"), lambda s: s.replace(" ", " "), lambda s: s.replace("i", "i​"), lambda s: " " + s, lambda s: s.replace("fi", "ﬁ").replace("é", "é"), lambda s: s.replace("-", "‐"), lambda s: s.upper()]
    rows = [(n, rng.choice("ab"), rng.choice(tricks)(rng.choice(base)), "clash") for n in range(150)] + [(500 + k, "a", "Pflicht der Stelle", None) for k in range(80)] + [(900, "a", None, None)]
    df = spark.createDataFrame(rows, "nr long, tabelle string, t string, form string")
    forms = G.consistent(df, ["tabelle", "nr"])
    got = {tuple(r) for r in G.look_alike_pairs(forms, ["tabelle"], "nr").collect()}
    want = set()
    for (n, g, s, _), (m, h, r, _) in itertools.combinations(sorted(rows, key=lambda x: x[0]), 2):
        if g == h and s is not None and r is not None and s != r and G.by_table(s).strip() == G.by_table(r).strip():
            want.add((g, n, m))
    assert got == want and len(want) > 500
    classes = {(r.tabelle, r.klasse, r.schreibungen, r.zeilen) for r in G.look_alike_classes(forms, ["tabelle"], "nr").collect()}
    parts: dict = {}
    for n, g, s, _ in rows:
        if s is not None:
            parts.setdefault((g, G.by_table(s).strip()), []).append((n, s))
    assert classes == {(g, min(n for n, _ in v), len({s for _, s in v}), len(v)) for (g, _), v in parts.items() if len({s for _, s in v}) > 1}
    assert all(r.form == r.t or not G.is_spelling(r.t) for r in forms.where("t = 'Café-Filialen (7)'").collect())
    assert G.look_alike_pairs(G.consistent(df.limit(0), ["tabelle", "nr"]), ["tabelle"], "nr").count() == 0
