"""Screening of news: relevance by a lexicon, category, extract, similar titles, greedy selection, run counters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written
from . import likeness

EXCLUDED = -12


@dataclass(frozen=True)
class Term:
    """A lexicon entry. The first of word and synonyms that occurs counts; in the title it counts twice."""

    word: str
    weight: int
    synonyms: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    works: tuple[str, ...] = ()

    @property
    def variants(self) -> tuple[str, ...]:
        return (self.word, *self.synonyms)


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[Term, ...] = ()
    excluded: tuple[str, ...] = field(default=())


def score(title: Column, text: Column, lexicon: Lexicon) -> dict[str, Column]:
    """``punkte``, ``begruendung``, ``themen`` and ``regelwerke`` of an item, as one projection of literal patterns.

    Words are sought at the start of a word in lower case, acronyms as they are written. Null texts are empty.
    """
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat_ws(" ", title, text)

    def occurs(where: Column, word: str) -> Column:
        return X.starts_a_word(where, word) if X.is_acronym(word) else X.starts_a_word(F.lower(where), word.lower())

    points, reasons, topics, works = [], [], [], []
    of = lambda hit, names: F.when(hit, F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))
    union = lambda parts: F.array_sort(F.array_distinct(F.flatten(F.array(*parts)))) if parts else F.array().cast("array<string>")
    for word in lexicon.excluded:
        hit = occurs(whole, word) if not X.is_acronym(word) else X.starts_a_word(F.lower(whole), word.lower())
        points.append(F.when(hit, EXCLUDED).otherwise(0))
        reasons.append(F.when(hit, F.lit(f"Ausschluss: {word}")))
    for term in lexicon.terms:
        gain, reason = F.lit(0), F.lit(None).cast("string")
        for v in reversed(term.variants):
            hit, doubled = occurs(whole, v), occurs(title, v)
            gain = F.when(hit, F.when(doubled, 2 * term.weight).otherwise(term.weight)).otherwise(gain)
            label = [F.lit(f"{v} ({w:+d})") for w in (2 * term.weight, term.weight)]
            reason = F.when(hit, F.when(doubled, label[0]).otherwise(label[1])).otherwise(reason)
        points.append(gain)
        reasons.append(reason)
        topics.append(of(reason.isNotNull(), term.topics))
        works.append(of(reason.isNotNull(), term.works))
    return {
        "punkte": sum(points, F.lit(0)),
        "begruendung": F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"),
        "themen": union(topics),
        "regelwerke": union(works),
    }


# The words of each category, in the order in which the categories are tried.
CATEGORIES = {
    "Konsultation": "konsultation|consultation|anhörung|call for advice|call for papers",
    "Vorfall & Bedrohungslage": "schwachstelle|sicherheitswarnung|vulnerabilit|advisory|angriff|ransomware|zeroday|zero-day",
    "Sanktion": "bußgeld|bussgeld|sanktion|geldbuße|maßnahme gegen|abberufung|fine",
    "Neue Regulierung": "tritt in kraft|verkündet|neue verordnung|neue richtlinie|veröffentlicht im amtsblatt|delegierte verordnung|durchführungsverordnung",
    "Änderung": "ändert|änderung|geändert|neufassung|ersetzt|aktualisiert|amendment",
    "Aufsichtspraxis": "rundschreiben|aufsichtsmitteilung|merkblatt|auslegung|faq|guideline|leitlinie|hinweis der",
}
OTHERWISE = "Fachartikel"


def category(title: Column, text: Column) -> Column:
    """The first category one of whose words occurs anywhere."""
    whole = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    out = F.lit(OTHERWISE)
    for name, pattern in reversed(CATEGORIES.items()):
        out = F.when(whole.rlike(pattern), name).otherwise(out)
    return out


def extract(text: Column, words: list[str], most: int) -> Column:
    """The two sentences with most of the words, in their order; a text of at most ``most`` bytes as a whole.

    A sentence ends at . ! or ?, and counts if it has more than 25 bytes; ties go to the earlier one.
    """
    clean = X.clean_html(text)
    sentences = F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"([^.!?]*[.!?]|[^.!?]+$)"), F.lit(1)), lambda s: F.trim(s)), lambda s: F.octet_length(s) > 25)
    points = lambda s: sum((F.lower(s).contains(w.lower()).cast("int") for w in words), F.lit(0))
    ranked = F.array_sort(F.transform(sentences, lambda s, i: F.struct((-points(s)).alias("p"), i.alias("i"), s.alias("s"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, 2), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    joined = F.array_join(F.transform(chosen, lambda x: x["s"]), " ")
    cut = lambda c: F.concat(F.substring(c, 1, most), F.lit("…"))
    short = F.when(F.length(joined) > most, cut(joined)).otherwise(joined)
    return F.when(F.octet_length(clean) <= most, clean).when(F.size(sentences) == 0, cut(clean)).otherwise(short)


def title_words(title: Column) -> Column:
    """The distinct words of a title of more than three bytes, sorted."""
    return F.array_sort(F.array_distinct(F.filter(X.words(F.lower(title)), lambda w: F.octet_length(w) > 3)))


def _alike(reps: DataFrame, above: int = 0) -> DataFrame:
    """Pairs (a, b) of alike sets (klasse, w, k, g) of one group g; with ``above``, those of which one has more elements."""
    words = reps.select("g", F.explode("w").alias("t")).groupBy("g", "t").agg(F.count("*").alias("n"))
    ordered = reps.select("klasse", "g", "k", F.explode("w").alias("t")).join(words, ["g", "t"])
    # Jaccard > 7/10 needs more than 7k/10 common words; sets with o common words share three of their k - o + 3 rarest ones
    keep = F.col("k") - (F.floor(F.col("k") * 7 / 10) + 1) + 3
    rare = ordered.groupBy("klasse", "g", "k").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("_a")).withColumn("_a", F.transform("_a", lambda x: x["t"]))
    rare = rare.select("klasse", "g", "k", F.slice("_a", 1, keep.cast("int")).alias("p"))
    three = F.flatten(F.transform("p", lambda a, i: F.flatten(F.transform(F.slice("p", i + 2, F.size("p")), lambda b, j: F.transform(F.slice("p", i + j + 3, F.size("p")), lambda c: F.xxhash64(a, b, c))))))
    signed = written(rare.select("klasse", "g", "k", F.explode(F.array_distinct(three)).alias("t")), "seltene")
    x, y = signed.alias("x"), signed.alias("y")
    fits = (10 * F.least("x.k", "y.k") > 7 * F.greatest("x.k", "y.k")) & (F.col("x.klasse") < F.col("y.klasse"))
    if above:
        fits &= F.greatest("x.k", "y.k") > above
    near = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.t") == F.col("y.t")) & fits).select(F.col("x.klasse").alias("a"), F.col("y.klasse").alias("b")).distinct()
    sides = near.join(reps.select(F.col("klasse").alias("a"), F.col("g").alias("_ga"), F.col("w").alias("wa")), "a").join(reps.select(F.col("klasse").alias("b"), F.col("g").alias("_gb"), F.col("w").alias("wb")), "b")
    alike = (F.col("_ga") == F.col("_gb")) & (10 * F.size(F.array_intersect("wa", "wb")) > 7 * F.size(F.array_union("wa", "wb")))
    return sides.where(alike).select("a", "b")


def similar_titles(items: DataFrame, key: str, title: str, within: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Titles whose word sets are alike: Jaccard above 0.7, at least three words each.

    Returns (pairs, membership): pairs (a, b, a < b) between representatives, that is the first item of each distinct word
    set, and membership (key, klasse) of every item in the set's representative. With ``within`` only titles of the same group.
    Exact: two sets that are alike share three of their rarest words, as many as may be missing plus three, so titles are
    joined on their group and three such words, whose sizes must fit; copies are never paired.
    """
    within = within or []
    sets = items.select(*within, key, title_words(F.col(title)).alias("w"))
    reps = sets.groupBy(*within, "w").agg(F.min(key).alias("klasse"))
    same = lambda names: [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]
    membership = sets.alias("s").join(reps.alias("r"), same([*within, "w"])).select("s.*", "r.klasse")
    group = F.xxhash64(*within) if within else F.lit(0).cast("bigint")  # groups as numbers; null is a group like any other
    reps = written(reps.where(F.size("w") >= 3).select("klasse", "w", F.size("w").alias("k"), group.alias("g")), "titel")
    return _alike(reps), membership.select(*within, key, "klasse", (F.size("w") >= 3).alias("vergleichbar"))


def similar_counts(items: DataFrame, key: str, title: str, rare: int | None = None, most: int = 16) -> DataFrame:
    """(key, klasse, verbindungen) of every item: the first item with the same set of title words, and how many other sets are alike.

    As the pairs of ``similar_titles`` give it, but sets of up to ``most`` words are counted without listing pairs, which are
    quadratic where titles are made after a pattern. Pairs with a longer set are listed. Sets are told apart by 128 bits.
    """
    w = title_words(F.col(title))
    which = [F.xxhash64("w").alias("_lo"), F.xxhash64(F.lit(1), "w").alias("_hi")]
    sets = items.select(key, w.alias("w"))
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    reps = written(sets.select(key, *which, hashes.alias("w")).groupBy("_lo", "_hi", "w").agg(F.min(key).alias("klasse")), "titel")
    parts = likeness.alike_counts(reps.select("klasse", "w"), rare, most)
    if not reps.where(F.size("w") > most).isEmpty():
        near = reps.where(10 * F.size("w") > 7 * (most + 1)).select("klasse", "w", F.size("w").alias("k"), F.lit(0).cast("bigint").alias("g"))
        ends = _alike(near, most).select(F.explode(F.array("a", "b")).alias("klasse"), F.lit(1).cast("bigint").alias("n"))
        parts = parts.unionByName(ends)
    sums = parts.groupBy("klasse").agg(F.sum("n").alias("verbindungen"))
    classes = reps.select("_lo", "_hi", "klasse").join(sums, "klasse", "left").withColumn("verbindungen", F.coalesce("verbindungen", F.lit(0)))
    return sets.select(key, *which).join(classes, ["_lo", "_hi"]).select(key, "klasse", "verbindungen")


def greedy_selection(items: DataFrame, key: str, title: str, within: list[str], stored: str | None = None, id_: str | None = None) -> DataFrame:
    """Items in the order of ``key``, each taken unless its title is alike to one taken before in its group: (*within, key).

    ``stored``: a column that says which items are there already: they stay, whatever their titles, and must come first in the order.
    ``id_``: new items with the id of a stored one of their group are known and not taken; two new ones may have the same.

    The outcome of the sequential loop, found in parallel: an item with no earlier undecided rival is taken, its rivals
    are dropped, until all are decided. Rounds are as many as the longest chain of rivals is long. Of equal word sets only
    the first can be taken; titles of under three words have no rivals.
    """
    there = F.coalesce(F.col(stored), F.lit(False)) if stored else F.lit(False)
    items = items.select(*within, key, title, there.alias("_da"), *([F.col(id_).alias("_id")] if id_ else []))
    if id_:
        known = items.where("_da").select(*within, "_id").distinct()
        same = [F.col(f"i.{c}").eqNullSafe(F.col(f"k.{c}")) for c in within] + [F.col("i._id") == F.col("k._id"), ~F.col("i._da")]
        items = written(items.alias("i").join(known.alias("k"), same, "left_anti"), "unbekannte")
    pairs, membership = similar_titles(items, key, title, within)
    old = items.where("_da").select(*within, key)
    edges = written(pairs.join(old.select(F.col(key).alias("b")), "b", "left_anti").select("a", "b"), "rivalen")
    first = membership.where(~F.col("vergleichbar") | (F.col(key) == F.col("klasse"))).select(*within, key)
    dropped = None
    while not edges.isEmpty():
        waiting = edges.select(F.col("b").alias("v")).distinct()
        free = edges.select(F.col("a").alias("v")).distinct().join(waiting, "v", "left_anti")
        out = written(edges.join(free, edges["a"] == free["v"], "left_semi").select(F.col("b").alias("v")).distinct(), "verdraengt")
        dropped = out if dropped is None else dropped.unionByName(out)
        edges = edges.join(out, edges["a"] == out["v"], "left_anti").join(out, F.col("b") == out["v"], "left_anti")
        edges = written(edges.join(free, edges["a"] == free["v"], "left_anti"), "rivalen")
    taken = first if dropped is None else first.join(dropped.withColumnRenamed("v", key), key, "left_anti")
    return taken.unionByName(old.join(taken.select(key), key, "left_anti").select(*within, key)) if stored else taken


def newest(items: DataFrame, month: str, order: list[Column], n: int, months: int = 2) -> DataFrame:
    """The ``n`` newest items of the latest ``months`` months."""
    latest = [r[0] for r in items.select(month).where(F.col(month).isNotNull()).distinct().orderBy(F.desc(month)).limit(months).collect()]
    return items.where(F.col(month).isin(latest)).orderBy(*order).limit(n)
