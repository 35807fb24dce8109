"""One consistent form for texts that look the same but differ in their characters.

The clean spellings of the corpus's own vocabulary stand in tries as they are written. Every token that is not plain is sought in
them by a weighted edit automaton in which look-alikes and ignorable characters cost nothing: it compares what is drawn,
character by character, on both sides. What it reaches at cost 0 is spelled as the best spelling there (plain, else the most
frequent). Only tokens that reach nothing are normalised by table. The vocabulary is never gathered in one place: a trie holds
the spellings that begin alike, and the tokens that may match them; beginnings that too many share are split by what follows.
"""

from __future__ import annotations

import re
import unicodedata as u
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table, written

# Letters of other scripts that are drawn as Latin letters, each above its Latin twin.
CYRILLIC = ("АВСЕНІЈКМОРЅТУХҮԌԜаеіјорсуѕхһӏԁԛԝѵ",
            "ABCEHIJKMOPSTYXYGWaeijopcysxhldqwv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲν",
         "ABEZHIKMNOPTYXCjocv")
ARMENIAN = ("ՍՕօոսհցզ",
            "UOonuhgq")
#: Signs drawn as another sign.
SIGNS = {"‐": "-", "‑": "-", "﹣": "-", "－": "-", "⁃": "-", "µ": "μ", "Ω": "Ω", "ʼ": "’", "∶": ":"}
#: Characters that are drawn as nothing or as a blank though their category does not say so.
IGNORABLE, BLANK = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ", "⠀\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"

_TWINS = {a: b for left, right in (CYRILLIC, GREEK, ARMENIAN) for a, b in zip(left, right, strict=True)} | SIGNS
_SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<small>")


@lru_cache(1 << 16)
def glyph(c: str) -> str:
    """What one character is drawn as, decomposed: "" if invisible, " " for any blank, look-alikes as their Latin twin.

    Raised, lowered, circled and squared signs, fractions and letters of another shape stay what they are.
    """
    if c in BLANK or u.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if c in IGNORABLE or u.category(c) == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if c in _TWINS:
        return _TWINS[c]
    kind, _, points = u.decomposition(c).rpartition("> ")
    parts = "".join(chr(int(p, 16)) for p in points.split())
    if kind and (kind + ">" in _SAME_SHAPE or kind == "<compat" and len(parts) > 1 and (parts.isalpha() and "ſ" not in c + parts or set(parts) == {"."})):
        return "".join(map(glyph, u.normalize("NFD", parts)))
    if not kind and parts:  # canonical
        return "".join(map(glyph, u.normalize("NFD", c))) if u.normalize("NFD", c) != c else c
    return c


def units(text: str) -> str:
    """The glyphs of a text in canonical order: equal for texts that look the same."""
    return u.normalize("NFD", "".join(map(glyph, u.normalize("NFD", text))))


def by_table(text: str) -> str:
    """The normal form by table alone: glyphs, composed again."""
    return u.normalize("NFC", units(text))


def script(c: str) -> str:
    """The script a letter belongs to by its name; "" for signs and digits."""
    return u.name(c, "").split(" ")[0] if c.isalpha() else ""


def is_spelling(token: str) -> bool:
    """Whether a token may serve as a spelling: composed, nothing invisible, no compatibility forms, one script."""
    if u.normalize("NFC", token) != token:
        return False
    if any(glyph(c) != c and u.normalize("NFC", glyph(c)) != c and c not in _TWINS or c in SIGNS for c in token):
        return False
    return len({script(c) for c in token} - {""}) <= 1


@lru_cache(1 << 16)
def drawn(c: str) -> str:
    """What one character is drawn as, its marks in canonical order; nothing for an ignorable one."""
    return u.normalize("NFD", "".join(map(glyph, u.normalize("NFD", c))))


class _Node:
    """A place in a trie: edges by character, and by the first thing each is drawn as; spellings that end here."""

    __slots__ = ("edges", "by_glyph", "ends")

    def __init__(self) -> None:
        self.edges: dict[str, _Node] = {}
        self.by_glyph: dict[str, list[tuple[str, _Node]]] = {}
        self.ends: list[tuple[bool, int, str]] = []


class Trie:
    """Spellings as they are written. ``nearest`` runs a weighted edit automaton over them.

    ``alike``: further look-alikes of this automaton, each with what it is drawn as, beside those of ``drawn``.
    """

    def __init__(self, alike: dict[str, str] | None = None) -> None:
        self.root, self.alike = _Node(), alike or {}

    def _drawn(self, c: str) -> str:
        return self.alike[c] if c in self.alike else drawn(c)

    def add(self, spelling: str, count: int) -> None:
        node = self.root
        for c in spelling:
            if c not in node.edges:
                node.edges[c] = _Node()
                shape = self._drawn(c)
                node.by_glyph.setdefault(shape[:1], []).append((shape, node.edges[c]))
            node = node.edges[c]
        node.ends.append((bool(_PLAIN_WORD.fullmatch(spelling)), count, spelling))

    def nearest(self, token: str, limit: float = 0.0, price: float = 1.0) -> tuple[float, str] | None:
        """The cheapest spelling within ``limit`` and its cost: look-alikes and ignorables cost nothing, every other
        replacement, insertion or deletion of a glyph ``price``. Of equally cheap ones a plain one, then the most frequent, then by order.

        A state is a node of the trie, what the edge into it draws that the token has not drawn yet, a place in the token, and what its
        last character draws that the edges have not drawn yet.
        """
        states, best = [(0.0, self.root, "", 0, "")], None
        seen: dict[tuple[int, str, int, str], float] = {}
        while states:
            cost, node, of_edge, i, of_token = states.pop()
            while True:
                if of_edge and of_token and of_edge[0] == of_token[0]:
                    of_edge, of_token = of_edge[1:], of_token[1:]
                elif not of_token and i < len(token):
                    of_token, i = self._drawn(token[i]), i + 1
                else:
                    break
            if seen.get((id(node), of_edge, i, of_token), limit + 1) <= cost:
                continue
            seen[id(node), of_edge, i, of_token] = cost
            if not of_edge and not of_token and node.ends:  # the token is drawn to its end
                rank = (-cost, *max(node.ends))
                best = rank if best is None or rank > best else best
            if not of_edge:
                states += [(cost, child, shape, i, of_token) for shape, child in node.by_glyph.get(of_token[:1], ()) if of_token]
            if cost + price > limit:
                continue
            if of_token:
                states.append((cost + price, node, of_edge, i, of_token[1:]))
            if of_edge:
                states.append((cost + price, node, of_edge[1:], i, of_token))
                if of_token:
                    states.append((cost + price, node, of_edge[1:], i, of_token[1:]))
            else:
                for shapes in node.by_glyph.values():
                    states += [(cost, child, shape, i, of_token) for shape, child in shapes if not of_token or shape[:1] != of_token[:1]]
        return best and (-best[0], best[3])


def spell(token: str, trie: Trie) -> str:
    """The canonical spelling of a token: what the automaton reaches at no cost, also from the token's normal form; else the normal form by table."""
    hit = trie.nearest(token)
    if hit is None:
        plain = by_table(token)
        hit = trie.nearest(plain) if plain != token else None
        return hit[1] if hit else plain
    return hit[1]


# --- operators --------------------------------------------------------------------------------------------

#: Blanks of any kind, as Java's patterns see them.
_BLANKS = r"[\p{Z}\x{2800}\t\n\x0B\f\r\x{1C}-\x{1F}\x{85}]"
#: Texts of these characters only are in normal form already.
_PLAIN = r"^[!-~\x{C0}-\x{FF}]+(?: +[!-~\x{C0}-\x{FF}]+)*$"
_PLAIN_WORD = re.compile("[!-~\xc0-\xff]+")
#: Distinct tokens of one trie, at most: beginnings that more share are split by what follows.
PER_GROUP = 20_000
#: Glyphs of the beginning that a trie's spellings share, and of the longer one by which crowded beginnings are split.
BEGIN, LONGER = 4, 24


def is_plain(text: Column) -> Column:
    """Whether a text surely is in normal form, decided without leaving the JVM."""
    return text.rlike(_PLAIN)


@F.pandas_udf(T.StructType([T.StructField("beginn", T.StringType()), T.StructField("laenger", T.StringType())]))
def _begins(token: pd.Series) -> pd.DataFrame:
    """How a token begins to the eye: its first glyphs, few and more."""

    def first(t: str) -> str:
        out = ""
        for c in t:
            out += drawn(c)
            if len(out) >= LONGER:
                break
        return u.normalize("NFD", out)[:LONGER]

    longer = token.map(first)
    return pd.DataFrame({"beginn": longer.str[:BEGIN], "laenger": longer})


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """Distinct tokens of all texts with their counts: (token, anzahl)."""
    return texts.select(F.explode(F.split(text, _BLANKS)).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("anzahl"))


def spellings(words: DataFrame) -> DataFrame:
    """The canonical spelling of every token that is not plain and is spelled otherwise: (token, schreibung). Plain ones are their own."""
    begun = written(words.select("token", "anzahl", (~is_plain(F.col("token"))).alias("_odd"), _begins("token").alias("b")).select("token", "anzahl", "_odd", "b.*"), "anfaenge")
    sought = begun.groupBy("beginn").agg(F.max("_odd").alias("_odd"), F.count("*").alias("_n")).where("_odd")  # other beginnings have nothing to match
    crowded = F.when(F.col("_n") > PER_GROUP, F.col("laenger")).otherwise(F.col("beginn"))
    routed = begun.join(sought.select("beginn", "_n"), "beginn").select("token", "anzahl", "_odd", crowded.alias("gruppe"))

    def look_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        odd = pdf["token"][pdf["_odd"]].tolist()
        if not odd:
            return pd.DataFrame({"token": [], "schreibung": []}, dtype="object")
        trie = Trie()
        for token, count in zip(pdf["token"], pdf["anzahl"], strict=True):
            if is_spelling(token):
                trie.add(token, count)
        return pd.DataFrame({"token": odd, "schreibung": [spell(t, trie) for t in odd]}, dtype="object")

    return routed.groupBy("gruppe").applyInPandas(look_up, "token string, schreibung string").where("token <> schreibung")


def consistent(texts: DataFrame, keys: list[str], text: str = "t") -> DataFrame:
    """(*keys, text, form): every non-null text with its consistent form, blanks at the ends removed.

    Keys must be unique and not null. Texts that look the same get equal forms, texts that look different stay different. An
    empty or blank text has the empty form; null texts are left out; an empty table gives no rows. Only the tokens that are not
    plain are taken out of their texts, joined with their spellings, and put back.
    """
    rows = texts.where(F.col(text).isNotNull()).select(*keys, text)
    mapping = written(spellings(written(vocabulary(rows, text), "woerter")), "schreibungen")
    odd = rows.where(~is_plain(F.col(text)))
    placed = F.transform(F.split(text, _BLANKS, -1), lambda w, i: F.struct(i.alias("pos"), w.alias("token")))
    tokens = odd.select(*keys, F.explode(F.filter(placed, lambda x: ~is_plain(x["token"]) & (x["token"] != ""))).alias("x")).select(*keys, "x.pos", "x.token")
    spelled = tokens.join(mapping, "token").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "schreibung"))).alias("_s"))
    words = F.transform(F.split(text, _BLANKS, -1), lambda w, i: F.coalesce(F.try_element_at("_s", i), w))
    forms = odd.join(spelled, keys, "left").select(*keys, text, F.trim(F.array_join(words, " ")).alias("form"))
    return rows.where(is_plain(F.col(text))).select(*keys, text, F.col(text).alias("form")).unionByName(forms)


def _classes(forms: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """(*group, key, _t, _f): rows, as hashes of text and form, of the forms that some text is not written in. No other form has two spellings."""
    rows = forms.select(*group, key, F.unhex(F.md5(text)).alias("_t"), F.unhex(F.md5("form")).alias("_f"))
    return rows.join(rows.where("_t <> _f").select(*group, "_f").distinct(), [*group, "_f"], "left_semi")


def look_alike_pairs(forms: DataFrame, group: list[str], key: str, text: str = "t") -> DataFrame:
    """All pairs (key_a < key_b) of rows with equal form and different characters, within equal ``group``.

    Pairs are made between different spellings of a form, never between copies of one spelling, so the work is that of
    the result: a form with two spellings of n and m copies gives n x m rows, since every pair counts.
    """
    rows = _classes(forms, group, key, text)
    kinds = rows.select(*group, "_f", "_t").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("_t", "_t2"), [*group, "_f"]).where("_t < _t2")
    left = pairs.join(rows.select(*group, "_f", "_t", F.col(key).alias("_a")), [*group, "_f", "_t"])
    both = left.join(rows.select(*group, "_f", F.col("_t").alias("_t2"), F.col(key).alias("_b")), [*group, "_f", "_t2"])
    return both.select(*group, F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"))


def look_alike_classes(forms: DataFrame, group: list[str], key: str, text: str = "t") -> DataFrame:
    """(*group, klasse, schreibungen, zeilen): per form with several spellings its first row, how many spellings and rows it has."""
    found = _classes(forms, group, key, text).groupBy(*group, "_f", "_t").agg(F.min(key).alias("_k"), F.count("*").alias("_n"))
    classes = found.groupBy(*group, "_f").agg(F.min("_k").alias("klasse"), F.count("*").alias("schreibungen"), F.sum("_n").alias("zeilen"))
    return classes.where("schreibungen > 1").drop("_f")


def short_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of both tables as (tabelle, nr, t)."""
    sides = [table(spark, folder, name).select(F.lit(name).alias("tabelle"), F.col(nr).alias("nr"), "t") for name, nr in (("indexdokumente", "dok_nr"), ("punkte", "punkt_nr"))]
    return reduce(DataFrame.unionByName, sides).where("t <> ''")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of rows of a table whose texts look the same and differ in their characters."""
    forms = written(consistent(short_texts(spark, folder), ["tabelle", "nr"]), "formen")
    return look_alike_pairs(forms, ["tabelle"], "nr").select("tabelle", "nr_a", "nr_b")


def p5_formen(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its consistent form."""
    return consistent(short_texts(spark, folder), ["tabelle", "nr"]).select("tabelle", "nr", "form")


def p5_klassen(spark: SparkSession, folder: str) -> DataFrame:
    """Per form that is spelled in several ways: its first row, and how many spellings and rows it has."""
    return look_alike_classes(consistent(short_texts(spark, folder), ["tabelle", "nr"]), ["tabelle"], "nr")
