"""Reading levels: counts, scales, held-out accuracy on texts of known difficulty."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blattwerk.llm import readability as R


def test_counts():
    assert R.syllables("bundesland", "de") == 3 and R.syllables("house", "en") == 1 and R.syllables("mm", "de") == 1
    for lang, words in {"de": "prü-fung aus-la-ge-rung wirt-schaft ge-eig-net be-ach-ten mit-tei-lung", "en": "com-pu-ter mat-ter re-act cashed", "fr": "dé-ci-sion ré-u-nion"}.items():
        for w in words.split():
            assert R.hyphenate(w.replace("-", ""), lang) == w.split("-"), w
    c = R.sentence_counts("Titel\n\nDas ist gut. Der Verein kauft Papier, und dann zahlt er! so. klein", "de")
    assert c[:, 0].tolist() == [4, 4, 4]
    assert len(R.sentence_counts("", "de")) == len(R.sentence_counts("... 12 !!", "de")) == 0
    assert R.language("Der Hund und die Katze", None) == "de" and R.language("the cat and the dog", "") == "en" and R.language("x", "fr") == "fr" and R.language("", None) == "de"


def test_formulas_are_the_published_ones():
    """Ten words, 50 letters, 15 syllables, two hard words, by hand."""
    c = np.array([[10, 50, 15, 2]], float)
    want = [0.39 * 10 + 11.8 * 1.5 - 15.59, 4.71 * 5 + 0.5 * 10 - 21.43, 0.4 * (10 + 20), 1.043 * 60**0.5 + 3.1291]
    assert R.grades(c, "en")[0, :4] == pytest.approx(want)
    ease = 206.835 - 1.015 * 10 - 84.6 * 1.5  # 69.8: between 70 (8.5) and 60 (11)
    assert R.grades(c, "en")[0, 4] == pytest.approx(8.5 + (70 - ease) * 0.25)
    assert R.grades(c, "de")[0, 4] == pytest.approx(7 + (82.25 - 80) * -0.1) and R.grades(c, "fr")[0, 4] == pytest.approx(7 - (86.45 - 80) * 0.1)


def test_single_sentences_do_not_decide():
    easy, hard = [[5, 20, 6, 0]] * 9, [[60, 500, 200, 40]]
    one, other = (R.text_grades(np.array(x, float), "de") for x in (easy, easy[:1]))
    assert R.text_grades(np.array(easy[:8] + [[30, 250, 100, 20]], float), "de") == other == one and R.text_grades(np.array(hard, float), "de")[0] > 30
    assert np.isnan(R.text_grades(np.zeros((0, 4)), "de")).all()


WORDS = {1: "Hund Kind Ball rot gut geht läuft".split(), 2: "Katze Schule Garten spielen wohnen Mutter".split(), 3: "Zeitung Verwaltung berichten Gemeinde Entwicklung".split(), 4: "Auslagerung Risikobericht Dokumentation Überwachung".split(), 5: "Verhältnismäßigkeitsgrundsatz Durchführungsbestimmungen Gleichwertigkeitsfeststellung".split()}


def text(level, rng):
    out = []
    while len(" ".join(out)) < 260:
        out.append(" ".join(rng.choice(WORDS[level]) for _ in range(3 + 3 * level)) + ".")
    return " ".join(out)


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    docs = [(n, "de", text(n % 5 + 1, rng)) for n in range(300)] + [(900, "de", None), (901, "de", ""), (902, None, "kurz"), (903, "de", "1 2 3 " * 60), (904, "xx", text(5, rng)), (905, "de", text(1, rng) * 200)]
    grades = [(n, p, n % 5 + 1) for n in range(120) for p in "ab"] + [(130, "a", 1), (130, "b", 5), (131, "a", None), (132, "a", 9)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    g = spark.createDataFrame(grades, "doc_id long, pruefer string, stufe int")
    got = {r.doc_id: r.stufe for r in R.reading_levels(d, g).collect()}
    assert set(got) == {*range(300), 903, 904, 905} and got[903] == 3 and set(got.values()) <= set(R.LEVELS)
    assert np.mean([got[n] == n % 5 + 1 for n in range(120, 300)]) > 0.95
    assert set(R.reading_levels(d, g.limit(0)).toPandas()["stufe"]) <= set(R.LEVELS)
    assert R.reading_levels(d.limit(0), g).count() == 0


@pytest.mark.parametrize("levels", [[1], [2, 5], [1, 2, 3, 4, 5]])
def test_cuts_with_missing_levels(levels):
    rng = np.random.RandomState(0)
    level = np.array(levels * 20)
    years = 4.0 * level + rng.rand(len(level))
    found = R.cuts(years, level)
    assert len(found) == 4 and list(found) == sorted(found)
    if levels == [1, 2, 3, 4, 5]:
        assert ((1 + (years[:, None] > np.array(found)).sum(axis=1)) == level).all()
    assert R.cuts(np.array([]), np.array([])) == R.SCHOOL_CUTS


FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_held_out_agreement_per_language_and_level(spark):
    """Cuts from four fifths of the graded texts, agreement on the rest with documents on which two graders agree."""
    d, g = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "lesestufen"))
    given = g.toPandas().dropna(subset=["stufe"])
    sure = given.groupby("doc_id").stufe.agg(["min", "max", "count"]).query("min == max and count == 2")["min"]
    right, by_level = [], {}
    for fold in range(5):
        held = {n for n in sure.index if n % 5 == fold}
        levels = R.reading_levels(d.join(g.select("doc_id").distinct(), "doc_id", "left_semi"), g.where(F.col("doc_id") % 5 != fold)).toPandas().set_index("doc_id").stufe
        for n in held & set(levels.index):
            right.append(levels[n] == sure[n])
            by_level.setdefault(sure[n], []).append(levels[n] == sure[n])
    assert np.mean(right) > 0.92 and min(np.mean(v) for v in by_level.values()) > 0.8
