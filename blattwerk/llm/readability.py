"""Reading level of texts from classic readability formulas, combined by the median of several grade estimates.

Per sentence the public formulas are computed as they were published, from its length and from syllables counted by
hyphenation-style rules; a formula's grade of a text is the grade at which half of its words lie in easier sentences, so single
easier or harder sentences do not decide. The text's estimate is the median of its formulas' grades. Only the four cuts
between levels are set per language, from a bounded sample of graded texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written

#: Graded texts that are used for setting the scale, at most; chosen by hash, so independent of order.
SAMPLE = 20_000
#: Characters a text must have to get a level.
SHORTEST = 200
LEVELS = (1, 2, 3, 4, 5)

# Frequent words by which a text of unknown language is recognised.
STOP = {
    "de": frozenset("der die das und nicht ist zu den von mit ein eine auf wird werden im dem des".split()),
    "en": frozenset("the of and to is in that be for with are shall on by must an it has".split()),
    "fr": frozenset("le la les des de et du un une est en que pour sont dans par sur au".split()),
}
# Vowels, and groups of them that are spoken as one, by language.
VOWELS = "aeiouyäöüàâéèêëîïôùûœæáíóú"
GROUPS = {
    "de": "aa ee oo ie ieh ei ai ey ay au eu äu ui oi ou",
    "en": "ea ee oo ou oa ai ay au aw ei ey ie oi oy ue ui eau iou",
    "fr": "ai ei au eau eu ou oi œu ui ie io ia oui aî oî où",
}
_NUCLEUS = {k: re.compile("|".join(sorted(v.split(), key=len, reverse=True)) + f"|[{VOWELS}]") for k, v in GROUPS.items()}
_SILENT = {"en": re.compile(r"(?:[^aeiouyl]e|[^aeiouytd]ed)$"), "fr": re.compile(r"[^aeiouy](?:e|es|ent)$")}
_WORD = re.compile(r"[^\W\d_]+")
# Prefixes that end in a vowel and keep it apart from one that follows, and consonants written together, by language.
PREFIXES = {"de": "be ge re de vor", "en": "re de pre co", "fr": "ré dé pré co"}
TOGETHER = {
    "de": "sch ch ck ph th qu bl br dr fl fr gl gr kl kn kr pf pl pr tr zw schw schl schm schn schr",
    "en": "ch sh th ph wh qu ck bl br cl cr dr fl fr gl gr pl pr tr str",
    "fr": "ch ph th qu gn bl br cl cr dr fl fr gl gr pl pr tr vr",
}
_PREFIX = {k: re.compile(f"(?:{'|'.join(v.split())})(?=[{VOWELS}])") for k, v in PREFIXES.items()}
_ONSET = {k: re.compile(f"(?:{'|'.join(sorted(v.split(), key=len, reverse=True))}|[^{VOWELS}])?$") for k, v in TOGETHER.items()}
# Words that join a further main clause, which counts as a sentence of its own. Nor does a sentence begin in lower case.
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?![a-zà-öø-ÿß])|,?\s+(?:und dann|and then|et puis|et ensuite)\s+")
#: Grades of texts are kept for each formula, in this order.
FORMULAS = ("flesch_kincaid", "ari", "fog", "smog", "lesbarkeit")


def hyphenate(word: str, lang: str) -> list[str]:
    """The syllables of a lower-case word as it would be hyphenated.

    Every vowel group that is spoken as one carries a syllable, but silent endings carry none; between two of them the last
    consonant, or the last ones if they are written together, opens the next syllable; prefixes stand alone.
    """
    lang = lang if lang in GROUPS else "de"
    prefix = _PREFIX[lang].match(word)
    start = prefix.end() if prefix and len(word) > prefix.end() + 2 else 0
    nuclei = [m.span() for m in _NUCLEUS[lang].finditer(word, start)]
    silent = _SILENT[lang].search(word) if lang in _SILENT else None
    if silent and len(nuclei) + bool(start) > 1:
        nuclei.pop()
    parts, begin = ([word[:start]] if start else []), start
    for (_, end), (following, _) in zip(nuclei, nuclei[1:], strict=False):
        cut = end + _ONSET[lang].search(word[end:following]).start()
        parts.append(word[begin:cut])
        begin = cut
    return [*parts, word[begin:]]


def syllables(word: str, lang: str) -> int:
    """How many syllables a word has; at least one."""
    return len(hyphenate(word, lang))


def language(text: str, named: str | None) -> str:
    """The language named, or the one whose frequent words are most frequent in the text."""
    if named in GROUPS:
        return named
    words = _WORD.findall(text.lower())
    return max(STOP, key=lambda k: (sum(w in STOP[k] for w in words), k == "de"))


def sentence_counts(text: str, lang: str, known: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
    """Per sentence: words, letters, syllables, words of three or more syllables. Headings of under three words are no sentences, unless all are."""
    known = {} if known is None else known
    parts = [w for s in _SENTENCE.split(text) if s and (w := _WORD.findall(s))]
    parts = [w for w in parts if len(w) >= 3] or parts
    rows = []
    for words in parts:
        letters = total = hard = 0
        for w in words:
            if w not in known:
                known[w] = (len(w), syllables(w.lower(), lang))
            length, n = known[w]
            letters += length
            total += n
            hard += n >= 3
        rows.append((len(words), letters, total, hard))
    return np.array(rows, float).reshape(-1, 4)


# Reading ease by language (Flesch; Amstad for German; Kandel and Moles for French): constant, per word of a
# sentence, per syllable of a word.
EASE = {"en": (206.835, 1.015, 84.6), "de": (180.0, 1.0, 58.5), "fr": (207.0, 1.015, 73.6)}
# Flesch's table from reading ease to school years, by its class borders; outside it goes on as at its ends.
EASE_TABLE = ((120.0, 3.0), (100.0, 5.0), (90.0, 6.0), (80.0, 7.0), (70.0, 8.5), (60.0, 11.0), (50.0, 13.0), (30.0, 16.0), (0.0, 20.0), (-150.0, 40.0))


def grades(c: np.ndarray, lang: str) -> np.ndarray:
    """School years by every formula of ``FORMULAS``, for rows of (words, letters, syllables, hard words) of one sentence each.

    Fixed values: the coefficients of Flesch and Kincaid, of the automated readability index, of Gunning's fog and of McLaughlin's SMOG.
    """
    words = np.maximum(c[:, 0], 1.0)
    letters, syl, hard = c[:, 1] / words, c[:, 2] / words, c[:, 3] / words
    a, b, d = EASE.get(lang, EASE["de"])
    ease, school = np.array(EASE_TABLE[::-1]).T
    return np.column_stack([
        0.39 * words + 11.8 * syl - 15.59,
        4.71 * letters + 0.5 * words - 21.43,
        0.4 * (words + 100 * hard),
        1.043 * np.sqrt(30 * c[:, 3]) + 3.1291,
        np.interp(a - b * words - d * syl, ease, school),
    ])


def text_grades(c: np.ndarray, lang: str) -> list[float]:
    """The grade of a text by each formula: the median over its sentences, each weighing as many words as it has. No sentences, no grades."""
    if not len(c):
        return [float("nan")] * len(FORMULAS)
    g, out = grades(c, lang), []
    for k in range(len(FORMULAS)):
        order = np.argsort(g[:, k], kind="stable")
        upto = np.cumsum(c[order, 0])
        out.append(float(g[order[np.searchsorted(upto, upto[-1] / 2)], k]))
    return out


#: School years at which the levels part where nothing was graded.
SCHOOL_CUTS = (5.0, 9.0, 13.0, 17.0)


def cuts(estimate: np.ndarray, level: np.ndarray) -> tuple[float, ...]:
    """The four cuts with the fewest errors on graded texts; a cut that no graded text supports is that of school years, in order."""
    found: list[float] = []
    for k, usual in zip(LEVELS[:-1], SCHOOL_CUTS, strict=True):
        above = level > k
        if above.all() or not above.any():
            found.append(usual)
            continue
        v = np.unique(estimate)
        tries = np.concatenate([(v[1:] + v[:-1]) / 2, [v[0] - 0.5, v[-1] + 0.5]])
        order = np.sort(estimate[above]), np.sort(estimate[~above])
        wrong = np.searchsorted(order[0], tries) + len(order[1]) - np.searchsorted(order[1], tries)
        best = tries[wrong == wrong.min()]
        found.append(float(best[np.argmin(np.abs(best - np.median(best)))]))
    return tuple(np.maximum.accumulate(found))


# --- operators --------------------------------------------------------------------------------------------


def text_estimates(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", shortest: int = SHORTEST) -> DataFrame:
    """(key, sprache, *FORMULAS, jahre) of texts of at least ``shortest`` characters: grades in school years and their median."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for pdf in batches:
            langs = [language(t, n) for t, n in zip(pdf["_t"], pdf["_l"], strict=True)]
            rows = np.array([text_grades(sentence_counts(t, n, known.setdefault(n, {})), n) for t, n in zip(pdf["_t"], langs, strict=True)]).reshape(-1, len(FORMULAS))
            if sum(map(len, known.values())) > 500_000:
                known.clear()
            head = pd.DataFrame({key: pdf[key].to_numpy(), "sprache": np.array(langs, dtype=object)})
            yield pd.concat([head, pd.DataFrame(rows, columns=list(FORMULAS)), pd.DataFrame({"jahre": np.median(rows, axis=1)})], axis=1)

    long = docs.where(F.length(text) >= shortest).select(key, F.col(text).alias("_t"), F.lower(F.trim(F.col(lang))).alias("_l"))
    return long.mapInPandas(run, f"`{key}` {kind}, sprache string, " + ", ".join(f"{c} double" for c in (*FORMULAS, "jahre")))


def graded_sample(estimates: DataFrame, given: DataFrame, key: str = "doc_id", level: str = "stufe", most: int = SAMPLE) -> pd.DataFrame:
    """At most ``most`` graded texts with their estimates. Graders who disagree are no help; blanks and levels off the scale count as not given."""
    agreed = (
        given.where(F.col(level).isin(*LEVELS)).groupBy(key)
        .agg(F.min(level).alias("_lo"), F.max(level).alias("_hi"))
        .where("_lo = _hi").select(key, F.col("_lo").alias("_stufe"))
    )
    rows = estimates.where("jahre is not null").select(key, "sprache", "jahre").join(agreed, key)
    return rows.orderBy(F.xxhash64(key), key).limit(most).toPandas()


def reading_levels(docs: DataFrame, given: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, stufe) of every text of at least ``SHORTEST`` characters; shorter, empty and null texts get no row.

    Repeated texts get equal levels. A text without words is taken as of the middle level. ``key`` must be unique.
    The cuts are those of the text's language; where it has no graded text, those of school years.
    """
    estimates = written(text_estimates(docs, key), "schuljahre")
    sample = graded_sample(estimates, given, key)
    parts = F.lit(None).cast("array<double>")
    for lang, own in sample.groupby("sprache"):
        parts = F.when(F.col("sprache") == lang, F.array(*map(F.lit, cuts(own["jahre"].to_numpy(), own["_stufe"].to_numpy())))).otherwise(parts)
    parts = F.coalesce(parts, F.array(*map(F.lit, SCHOOL_CUTS)))
    level = F.size(F.filter(parts, lambda c: c < F.col("jahre"))) + 1
    return estimates.select(key, F.when(F.col("jahre").isNull(), 3).otherwise(level).cast("int").alias("stufe"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level of every document of at least 200 characters."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return reading_levels(docs, table(spark, folder, "lesestufen"))


def p8_profil(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of each source demand which level."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return docs.join(p8_found(spark, folder), "doc_id").groupBy("source", "stufe").agg(F.count("*").alias("dokumente"))
