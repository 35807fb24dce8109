"""Deduplicating new batches of news against all history by multi-key sorted neighbourhoods.

Of each item only a short record is kept: what kind of announcement it is, about whom, about what, with which number,
amount and period. Records with equal content are one entry, so copies never crowd a window. Entries are sorted by three
keys (by institution, by matter and figures, and the latter with the institution's name read backwards, so that a
misspelt name has its twin near in at least one order). What a record lacks is sought in its wording: such an entry is
also sorted in under every name or matter its wording might mean.

The history is one table of sorted runs, bucketed by key range: a bucket per range, a sorted file per run in it. A new
batch is cut along the same ranges, so only the batch is shuffled; of the history only the ranges it touches and their
neighbours are read, as they lie. Only windows around new entries are compared. The batch then becomes a further run; when
there are too many runs they are compacted into one, cut into ranges anew. No text of the history is read again.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import new_place, remove, table, written

#: Waiting batches that are merged at once: less work per batch, the same result.
BACKLOG = 3
#: Entries compared to each side of a new one.
WINDOW = 12
#: Runs that are searched as they are; more are compacted before the next search.
MOST_RUNS = 2
#: Sort keys meant for one range when runs are cut: what one task holds. A border of at most 200 characters is kept per range.
PER_RANGE = 100_000
#: Keys a range has at least, so that a window reaches over one border only.
LEAST_PER_RANGE = 2_000
#: Keys per range that are looked at for placing the borders, chosen by hash. They decide the layout, not the result.
PER_BORDER = 16
#: Borders up to which a key's range is found in generated code; the outcome is the same beyond.
TREE = 256
#: Characters of a sort key; the number of the entry follows, so that no two keys are equal.
KEY_LENGTH = 180

FIELDS = ["art", "gegenstand", "sache", "nummer", "betrag", "zeitraum", "wortlaut", "kern", "sicher"]
_ENTRY = "art string, gegenstand string, sache string, nummer string, betrag string, zeitraum string, wortlaut string, kern string, sicher boolean"

# --- reading an item --------------------------------------------------------------------------------------

_CP1252 = {c: bytes([b]).decode("latin-1") for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "replace")) != "�"}
_TO_BYTES = str.maketrans(_CP1252)
_TWICE = re.compile("[\xc2-\xf4][\x80-\xbf" + re.escape("".join(_CP1252)) + "]{1,3}")
_FOLD = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "„": '"', "“": '"', "”": '"'}


def fold(text: str) -> str:
    """Umlauts in base letters; by replacement, which is many times as fast as a translation table."""
    for a, b in _FOLD.items():
        text = text.replace(a, b)
    return text


def clean(text: str | None) -> str:
    """Readable text: UTF-8 that was read as Latin-1 put right, tags and entities resolved, umlauts in base letters, single blanks."""
    if not text:
        return ""
    if not text.isascii() and _TWICE.search(text):
        text = _TWICE.sub(lambda m: m[0].translate(_TO_BYTES).encode("latin-1", "replace").decode("utf-8", "replace"), text)
    if "<" in text:
        text = re.sub(r"<[^>]*>", " ", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = fold(unicodedata.normalize("NFC", text))
        if not text.isascii():
            text = "".join([c for c in unicodedata.normalize("NFKD", text) if c < "\u0300" or not unicodedata.combining(c)])
    return " ".join(text.split())


def whole_part(text: str) -> str:
    """The text without a word that was cut off at its end."""
    return re.sub(r"\S*\.\.\.$", "", text) if text.endswith("...") else text


@lru_cache(1 << 14)
def _label(text: str | None) -> str:
    """A short value that many items share, cleaned, in lower case, without a score behind it."""
    return re.sub(r"\s*\([+-]?\d+\)$", "", clean(text)).lower()


#: Words with a capital in a row: what a name looks like. A name has two to five words.
_RUN = re.compile(r"(?<![\w-])[A-Z][A-Za-z&-]*(?: [A-Z][A-Za-z&-]*(?![\w-]))+")
_LONGEST_NAME = 5
# figures, in text in lower case: a pattern without case folding is several times as fast
_NOTICE = re.compile(r"\bn[or]\. ?(\d{4,})(?![\d./,-]*\d)")
_NUMBER = re.compile(r"\b(\d{1,3}/(?:19|20)\d{2})\b")
_AMOUNT = re.compile(r"\b(\d{1,3}(?:[.,']\d{3})+|\d+) ?(?:euro|eur)\b|(?:€|\beuro|\beur) ?(\d{1,3}(?:[.,']\d{3})+|\d+)")
_PERIOD = re.compile(r"\b(?:([1-4])\. ?q\w{3,9}|q([1-4])|(h[12])|([12])\. halbjahr)[ /-]*((?:19|20)\d{2})\b")


def _longest_run(text: str) -> list[str]:
    """The longest name a text may hold. A run that opens a sentence and is long enough loses its first word, which is no part of it.

    Where capitals tell nothing (most letters of the run are, or it is longer than names are) no name can be read.
    """
    best, words = "", []
    for m in _RUN.finditer(text):
        if m[0].count(" ") < len(words):
            continue
        run = m[0].split()
        if len(run) > 3 and (m.start() == 0 or text[: m.start()].rstrip(' "(')[-1:] in ("", ".", "!", "?", ":", ")")):
            run = run[1:]
        if len(run) > len(words):
            best, words = m[0], run
    if len(words) > _LONGEST_NAME or 2 * sum([w[1:2].isupper() for w in best.split()]) > len(words):
        return []
    return [w.lower() for w in words]


def _name(title: str, t_low: str, summary: str, s_low: str, matter: str) -> str:
    """Who an item is about: the longest name of its summary, or that of its title if longer and of other words.

    An opening word that the other half lacks is no part of it, nor is the matter behind it.
    """
    words, other = _longest_run(summary) if summary else [], t_low
    if not words or " ".join(words) not in t_low:
        if len(words) > 2 and " ".join(words[1:]) in t_low:
            return " ".join(words[1:])
        of_title = _longest_run(title)
        if len(of_title) > len(words):
            words, other = of_title, s_low
            if len(words) > 2 and " ".join(words) not in other and " ".join(words[1:]) in other:
                words = words[1:]
    name = " ".join(words)
    return name.removesuffix(" " + matter) if matter and len(words) > 2 else name


def _figures(lower: str, other: str) -> tuple[str, str, str, str]:
    """Notice, number, amount and period a text in lower case names, else the other text; a pattern runs only where what it needs occurs."""
    notice = number = amount = period = None
    for text in (lower, other):
        notice = notice or ("nr." in text or "no." in text) and _NOTICE.search(text)
        number = number or "/" in text and _NUMBER.search(text)
        amount = amount or ("eur" in text or "€" in text) and _AMOUNT.search(text)
        period = period or ("q" in text or "h1" in text or "h2" in text or "halbjahr" in text) and _PERIOD.search(text)
    return (
        notice[1] if notice else "",
        number[1].lstrip("0") if number else "",
        re.sub(r"\D", "", amount[1] or amount[2]) if amount else "",
        (period[1] or period[2] or period[3] or "h" + period[4]) + "/" + period[5] if period else "",
    )


def _plain_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text).split()


def read_item(title: str | None, summary: str | None, kind: str | None, reasons: Iterable[str] | None) -> tuple:
    """The record of one item, in the order of ``FIELDS``. The summary decides, the title fills what it lacks.

    Only an item that lacks a name or a matter keeps its wording, and as ``kern`` the words by which the matter may be known: those
    that title and summary share, without the name and figures; all of the title if there is no summary.
    """
    t, s = whole_part(clean(title)), whole_part(clean(summary))
    t_low, s_low = t.lower(), s.lower()
    notice, number, amount, period = _figures(s_low, t_low)
    matter = next((_label(r) for r in reasons if r), "") if reasons is not None else ""
    name = "" if notice else _name(t, t_low, s, s_low, matter)
    subject = f"nr {notice}" if notice else name
    if subject and matter:
        return (_label(kind), subject, matter, number, amount, period, "", "", bool(s))
    t_words, s_words = _plain_words(t_low), _plain_words(s_low)
    named = {*_plain_words(subject), *t_words} - set(s_words) if s_words else set()
    core = [w for w in dict.fromkeys(t_words) if w not in named and not w.isdigit() and w not in _plain_words(subject)]
    return (_label(kind), subject, matter, number, amount, period, " ".join([*t_words, *s_words]), " ".join(core), False)


# --- comparing --------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    """Whether two different strings are one insertion, deletion, replacement or swap of neighbours apart, digits untouched."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    near = a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return near and re.sub(r"\D", "", a) == re.sub(r"\D", "", b)


def _alike(a: str, b: str, sure: bool) -> bool:
    """Whether two names may be one: one opens or ends the other, or one slip of the pen apart if ``sure`` is not said of both."""
    if a == b or a.endswith(" " + b) or b.endswith(" " + a) or a.startswith(b + " ") or b.startswith(a + " "):
        return True
    return not sure and min(len(a), len(b)) >= 12 and one_edit(a, b)


def same_news(a: tuple, b: tuple) -> bool:
    """Whether two records tell the same: all they both say is equal, and what one lacks is found in its wording.

    A name may differ by one slip of the pen if one of the two is not confirmed by a summary. Where both lack the name, nine words
    in ten of their wording must be equal; where both lack the matter, the core of each must occur in the other.
    """
    kind_a, subject_a, matter_a, number_a, amount_a, period_a, words_a, core_a, sure_a = a
    kind_b, subject_b, matter_b, number_b, amount_b, period_b, words_b, core_b, sure_b = b
    if a == b:
        return bool(subject_a or words_a)
    if kind_a != kind_b and kind_a and kind_b:
        return False
    gap = words_a or words_b
    for x, y in ((number_a, number_b), (amount_a, amount_b), (period_a, period_b)):
        if x != y and (x and y or not gap):
            return False
    if subject_a and subject_b:
        if not _alike(subject_a, subject_b, sure_a and sure_b):
            return False
    elif subject_a or subject_b:
        if f" {subject_a or subject_b} " not in f" {words_b if not subject_b else words_a} ":
            return False
    else:
        left, right = set(words_a.split()), set(words_b.split())
        return bool(left) and 10 * len(left & right) >= 9 * len(left | right)
    if matter_a == matter_b:
        return bool(matter_a) or bool(core_a and core_b) and set(core_a.split()) <= set(words_b.split()) and set(core_b.split()) <= set(words_a.split())
    if matter_a and matter_b:
        return False
    return (matter_a or matter_b) in (words_b if not matter_b else words_a)


# --- runs -------------------------------------------------------------------------------------------------


def records(items: DataFrame) -> DataFrame:
    """(nr, _stapel, *FIELDS) of news items, read in Arrow batches."""
    types = [pa.string()] * (len(FIELDS) - 1) + [pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            title, summary, kind, reason = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            rows = [read_item(t, s, k, (r,)) for t, s, k, r in zip(title, summary, kind, reason, strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, columns, types)], names=["nr", "_stapel", *FIELDS])

    reason = F.expr("try_element_at(filter(begruendung, r -> r <> ''), 1)")  # the others are not read
    return items.select("nr", "_stapel", "titel", "zusammenfassung", "kategorie", reason).mapInArrow(read, f"nr bigint, _stapel int, {_ENTRY}")


#: A record that names nobody and has no wording: it tells nothing that another could repeat.
WORDLESS = "gegenstand = '' AND wortlaut = ''"
#: What stands for a record's content: 128 bits of hashes.
_CONTENT = ["_h1", "_h2"]


def entries(recs: DataFrame) -> DataFrame:
    """One row per distinct content, ``nr`` being the first item that has it; without wordless records."""
    return recs.where(f"NOT ({WORDLESS})").groupBy(*_CONTENT, *FIELDS).agg(F.min("nr").alias("nr"))


#: Between the parts of a sort key, and between those of a record.
_PART = "\x1f"


def sort_keys() -> str:
    """What an entry is sorted in by, each text opened by the number of its order, as an SQL expression of an array of distinct texts.

    An entry without a name also stands under every two or three neighbouring words of its wording, one without a matter
    under every word and every two neighbouring words of its core.
    """
    # the kind comes late: an item without one lies beside its twin that has one
    by_name = lambda who, what: f"concat_ws('{_PART}', '0', {who}, nummer, betrag, zeitraum, {what}, art, wortlaut)"
    by_matter = lambda order, who: f"concat_ws('{_PART}', '{order}', sache, nummer, betrag, zeitraum, {who}, art, wortlaut)"
    grams = lambda text, n: f"transform(sequence(0, greatest(0, size(split({text}, ' ')) - {n})), i -> array_join(slice(split({text}, ' '), i + 1, {n}), ' '))"
    usual = f"array({by_name('gegenstand', 'sache')}, {by_matter(1, 'gegenstand')}, {by_matter(2, 'reverse(gegenstand)')})"
    names = f"transform(array_distinct(concat({grams('wortlaut', 2)}, {grams('wortlaut', 3)})), g -> {by_name('g', 'sache')})"
    matters = f"transform(array_distinct(concat({grams('kern', 1)}, {grams('kern', 2)})), g -> {by_name('gegenstand', 'g')})"
    return f"CASE WHEN gegenstand = '' THEN array_distinct(concat({usual}, {names})) WHEN sache = '' THEN array_distinct(concat({usual}, {matters})) ELSE {usual} END"


#: Per row besides its key: hashes of what must be equal, so that windows are compared as numbers (0: a kind that is not given), and the
#: record where its key does not tell it.
_CODES = {
    "figuren": "xxhash64(nummer, betrag, zeitraum)", "wer": "xxhash64(gegenstand)", "was": "xxhash64(sache)", "wie": "CASE WHEN art = '' THEN 0L ELSE xxhash64(art) END",
    "sicher": "sicher", "satz": f"CASE WHEN wortlaut <> '' OR length(concat(gegenstand, sache, nummer, betrag, zeitraum, art)) > {KEY_LENGTH - 10} THEN array({', '.join(FIELDS[:-1])}) END",
}
#: One sort key of an entry, of a text of ``sort_keys``.
_KEY = f"concat_ws('{_PART}', substring(_text, 1, {KEY_LENGTH}), lpad(CAST(nr AS string), 20, '0')) AS schluessel"
_ROW = ["bereich", "schluessel", "nr", "erste", *_CODES]
_ROW_TYPES = "bereich int, schluessel string, nr bigint, erste bigint, figuren bigint, wer bigint, was bigint, wie bigint, sicher boolean, satz array<string>"
_PAIR = {"neu": pa.int64(), "alt": pa.int64(), "alt_neu": pa.bool_(), "alt_erste": pa.int64(), "rand": pa.int32(), "frisch": pa.bool_()}
_SEEN = f"neu bigint, alt bigint, alt_neu boolean, alt_erste bigint, rand int, frisch boolean, {_ROW_TYPES}"


def record_of(key: str, whole: list[str] | None, sure: bool) -> tuple:
    """The record of a row, in the order of ``FIELDS``: from its key, if that tells it."""
    if whole is not None:
        return (*whole, sure)
    order, a, number, amount, period, b, kind, *_ = key.split(_PART)
    who, what = (a, b) if order == "0" else (b if order == "1" else b[::-1], a)
    return (kind, who, what, number, amount, period, "", "", sure)


def _records(rows: pa.Table) -> list[tuple]:
    """The records of rows."""
    whole = rows.column("satz").combine_chunks()
    fields = iter(whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FIELDS) - 1).tolist())
    told = [next(fields) if there else None for there in pc.is_valid(whole).to_pylist()]
    return list(map(record_of, rows.column("schluessel").to_numpy(), told, rows.column("sicher").to_numpy().tolist()))


def _candidates(rows: pa.Table, fresh: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (new, other) of pairs within the window around new entries that may tell the same: nothing certain differs."""
    order = pc.utf8_slice_codeunits(rows.column("schluessel"), 0, 1).cast(pa.int32()).to_numpy()
    sure, figures, who, what, kind, nr = (rows.column(c).to_numpy() for c in ("sicher", "figuren", "wer", "was", "wie", "nr"))
    gap = pc.is_valid(rows.column("satz")).to_numpy()
    new = np.flatnonzero(fresh)
    left, right = [np.array([], int)], [np.array([], int)]
    for d in [*range(-window, 0), *range(1, window + 1)]:
        a = new[(new + d >= 0) & (new + d < len(fresh))]
        b = a + d
        if d > 0:
            a, b = a[~fresh[b]], b[~fresh[b]]  # two new ones meet once
        alike = (kind[a] == kind[b]) | (kind[a] == 0) | (kind[b] == 0)
        certain = (figures[a] == figures[b]) & (what[a] == what[b]) & ((who[a] == who[b]) | ~(sure[a] & sure[b]))
        hit = (order[a] == order[b]) & (nr[a] != nr[b]) & alike & (gap[a] | gap[b] | certain)
        left.append(a[hit])
        right.append(b[hit])
    return np.concatenate(left), np.concatenate(right)


def _compare(rows: pa.Table, window: int) -> list[tuple[int, int, bool, int]]:
    """Pairs (new, other, other is new too, first item of the other's news) of one sorted stretch that tell the same."""
    fresh = rows.column("frisch").to_numpy()
    one, other = _candidates(rows, fresh, window)
    if not len(one):
        return []
    used, at = np.unique(np.concatenate([one, other]), return_inverse=True)
    numbers: dict[tuple, int] = {}
    number = np.array([numbers.setdefault(r, len(numbers)) for r in _records(rows.select(["schluessel", "satz", "sicher"]).take(pa.array(used)))])[at]
    recs, n = list(numbers), len(numbers)
    # an entry stands under many keys: what meets again is not compared again
    met, place = np.unique(number[: len(one)] * n + number[len(one) :], return_inverse=True)
    same = np.array([same_news(recs[m // n], recs[m % n]) for m in met.tolist()], bool)[place]
    new, old = (rows.select(["nr", "frisch", "erste"]).take(pa.array(k[same])) for k in (one, other))
    return sorted(set(zip(new["nr"].to_pylist(), *(old[c].to_pylist() for c in ("nr", "frisch", "erste")), strict=True)))


def _shaped(rows: pa.Table, given: dict[str, pa.Array]) -> pa.Table:
    n = len(next(iter(given.values())))
    full = given | ({c: rows.column(c) for c in _ROW} if "rand" in given else {})
    types = _PAIR | {c: rows.schema.field(c).type for c in _ROW}
    return pa.table([full[c] if c in full else pa.nulls(n, t) for c, t in types.items()], names=list(types))


def _pairs_table(rows: pa.Table, window: int) -> pa.Table:
    pairs = _compare(rows, window)
    return _shaped(rows, {c: pa.array([p[k] for p in pairs], _PAIR[c]) for k, c in enumerate(("neu", "alt", "alt_neu", "alt_erste"))})


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[("schluessel", "ascending")])).combine_chunks()


def range_search(window: int):
    """The task of one range: sort the new entries into the old ones, compare windows around them, hand out both edges for the neighbours."""

    def search(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        parts = [t.select(_ROW).append_column("frisch", pa.array(np.full(len(t), f), pa.bool_())) for t, f in ((old, False), (new, True))]
        rows = _sorted(pa.concat_tables(parts))
        found = [_pairs_table(rows, window)] if len(new) else []
        for border, edge in ((key[0].as_py() - 1, rows.slice(0, window)), (key[0].as_py(), rows.slice(max(0, len(rows) - window)))):
            found.append(_shaped(edge, {"rand": pa.array([border] * len(edge), pa.int32()), "frisch": edge.column("frisch")}))
        return pa.concat_tables(found)

    return search


def border_search(window: int):
    """The task of one border: the last entries before it and the first ones after it, at most two windows."""

    def search(rows: pa.Table) -> pa.Table:
        return _pairs_table(_sorted(rows), window)

    return search


class Runs:
    """The persisted entries of all accepted news, as sorted runs in key ranges; more than ``most`` are compacted when they are next needed.

    One table, bucketed by range: ``rows`` of a set of ranges are read without touching the others and without a shuffle. ``erste``
    is the first item of the news an entry tells. The ranges are cut when the first run comes and at every compaction.
    """

    def __init__(self, spark: SparkSession, most: int = MOST_RUNS, per_range: int = PER_RANGE, least: int = LEAST_PER_RANGE) -> None:
        self.spark, self.most, self.per_range, self.least = spark, most, per_range, least
        self.name: str | None = None
        self.path = ""
        self.runs = self.compactions = 0
        self.borders: list[str] = []

    @property
    def ranges(self) -> int:
        return len(self.borders) + 1

    def cut(self, keyed: DataFrame) -> None:
        """Place the borders of the ranges so that each holds about as many of these keys."""
        keys = keyed.count()
        wanted = max(1, keys // self.per_range, min(self.spark.sparkContext.defaultParallelism, keys // self.least))
        if wanted == 1:
            self.borders = []
            return
        some = sorted(r[0] for r in keyed.select("schluessel").orderBy(F.xxhash64("schluessel")).limit(PER_BORDER * wanted).collect())
        self.borders = sorted({some[len(some) * k // wanted] for k in range(1, wanted)})

    def placed(self, keyed: DataFrame) -> DataFrame:
        """Rows with the number of the range their key lies in: by a tree of comparisons in generated code, or by bisection where it would be too large."""
        borders, key = self.borders, F.col("schluessel")

        def tree(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key < F.lit(borders[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

        @F.pandas_udf("int")
        def place(keys: pd.Series) -> pd.Series:
            return pd.Series([bisect_right(borders, k) for k in keys], dtype="int32")

        return keyed.withColumn("bereich", tree(0, len(borders)) if len(borders) <= TREE else place("schluessel"))

    def rows(self, touched: list[int] | None = None) -> DataFrame:
        """The entries of the given ranges, or of all."""
        if self.name is None:
            return self.spark.createDataFrame([], _ROW_TYPES)
        rows = self.spark.table(self.name).select(*_ROW)
        return rows if touched is None else rows.where(F.col("bereich").isin(touched))

    def _write(self, rows: DataFrame, mode: str) -> None:
        laid = rows.select(*_ROW).repartition(self.ranges, "bereich").sortWithinPartitions("bereich", "schluessel")
        laid.write.bucketBy(self.ranges, "bereich").sortBy("schluessel").format("parquet").option("path", self.path).mode(mode).saveAsTable(self.name)

    def _fresh_table(self) -> None:
        self.name, self.path = f"laeufe_{uuid.uuid4().hex}", new_place(self.spark, "laeufe")

    def append(self, rows: DataFrame) -> None:
        """Add ``rows`` (placed in the present ranges) as a sorted run."""
        if self.name is None:
            self._fresh_table()
            self._write(rows, "overwrite")
        else:
            self._write(rows, "append")
        self.runs += 1

    def compact(self) -> None:
        """Write all runs as one, cut into ranges anew; the old ones are removed only after that."""
        old_name, old_path, all_rows = self.name, self.path, self.rows().drop("bereich")
        self.cut(all_rows)
        self._fresh_table()
        self._write(self.placed(all_rows), "overwrite")
        self.spark.sql(f"DROP TABLE {old_name}")
        remove(self.spark, old_path)
        self.runs, self.compactions = 1, self.compactions + 1

    def drop(self) -> None:
        if self.name is not None:
            self.spark.sql(f"DROP TABLE {self.name}")
            remove(self.spark, self.path)
            self.name = None


def neighbours(runs: Runs, keyed: DataFrame, touched: set[int], window: int = WINDOW) -> tuple[DataFrame, int]:
    """(neu, alt, alt_neu, alt_erste): pairs of entries that tell the same, at least one of them among ``keyed``; alt_neu: both are.

    Also returned: how many of them are of two new entries. ``keyed`` must be placed in the ranges of ``runs``, ``touched`` are their
    numbers. Of the history only those ranges and the ones beside them are read.
    """
    near = sorted({b + d for b in touched for d in (-1, 0, 1)} & set(range(runs.ranges)))
    seen = runs.rows(near).groupBy("bereich").cogroup(keyed.select(*_ROW).groupBy("bereich")).applyInArrow(range_search(window), _SEEN)
    place = new_place(runs.spark, "fenster")
    seen = written(seen, "fenster", place)
    pair = ["neu", "alt", "alt_neu", "alt_erste"]
    found = seen.where("neu is not null").select(*pair)
    if runs.ranges > 1:
        across = seen.where(F.col("rand").between(0, runs.ranges - 2)).groupBy("rand").applyInArrow(border_search(window), _SEEN)
        found = found.unionByName(across.where("neu is not null").select(*pair))
    found, counted = _observed(found, "nachbarn", inner=F.count_if("alt_neu"))
    remove(runs.spark, place)
    return found, counted["inner"]


def _observed(df: DataFrame, name: str, path: str | None = None, **values: Column) -> tuple[DataFrame, dict]:
    """``df`` written, and what was counted on the way."""
    seen = Observation()
    out = written(df.observe(seen, *[v.alias(k) for k, v in values.items()]), name, path)
    return out, seen.get


_FIRST = """SELECT b.nr, least(b.nr, o.e) AS erste FROM {batch} b
    LEFT JOIN (SELECT neu AS nr, min(alt_erste) AS e FROM {pairs} WHERE NOT alt_neu GROUP BY neu) o ON o.nr = b.nr"""
_BETTER = """SELECT r.nr, least(r.erste, m.e) AS _n, r.erste FROM {roots} r
    LEFT JOIN (SELECT x.a AS nr, min(k.erste) AS e FROM {ends} x JOIN {roots} k ON k.nr = x.b GROUP BY x.a) m ON m.nr = r.nr"""


def _roots(batch: DataFrame, pairs: DataFrame, inner: int) -> DataFrame:
    """(nr, erste) of the batch's entries: the first item of the news each tells; ``inner``: how many pairs are of two new ones."""
    spark = batch.sparkSession
    roots = written(spark.sql(_FIRST, batch=batch, pairs=pairs), "erste")
    if not inner:
        return roots
    ends = spark.sql("SELECT DISTINCT a, b FROM (SELECT neu AS a, alt AS b FROM {pairs} WHERE alt_neu UNION ALL SELECT alt, neu FROM {pairs} WHERE alt_neu)", pairs=pairs)
    while True:  # rounds: half the length of the longest chain of unlike wordings, not of the data
        once = spark.sql(_BETTER, roots=roots, ends=ends).selectExpr("nr", "_n AS erste")
        better, seen = _observed(spark.sql(_BETTER, roots=once, ends=ends), "erste", changed=F.count_if(F.col("_n") < F.col("erste")))
        roots = better.selectExpr("nr", "_n AS erste")
        if not seen["changed"]:
            return roots


def merge_batch(runs: Runs, recs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Check the records of a batch against everything accepted so far and accept them: (_h1, _h2, erste) of every distinct content.

    Wordless records have none: they are news of their own. Nulls in any column are gaps, not differences; an empty batch
    changes nothing.
    """
    spark, place = runs.spark, new_place(runs.spark, "schluessel")
    texts = entries(recs).selectExpr(f"{sort_keys()} AS _texts", "nr", *[f"{e} AS {c}" for c, e in _CODES.items()], *_CONTENT)
    keyed = texts.selectExpr("explode(_texts) AS _text", "nr", *_CODES, *_CONTENT).selectExpr(_KEY, "nr", "nr AS erste", *_CODES, *_CONTENT)
    if runs.name is None:  # no history to read; the keys are written first, as the borders are placed by them
        keyed, touched = written(keyed, "schluessel", place), set()
        runs.cut(keyed)
        keyed = runs.placed(keyed)
    else:
        if runs.runs > runs.most:
            runs.compact()
        keyed, seen = _observed(runs.placed(keyed), "schluessel", place, touched=F.collect_set("bereich"))
        touched = set(seen["touched"])
    batch = keyed.where(F.col("schluessel").startswith("1")).select("nr", *_CONTENT)  # every entry has one key of that order
    roots = _roots(batch, *neighbours(runs, keyed, touched, window))
    runs.append(keyed.drop("erste").join(roots, "nr"))
    known = written(batch.join(roots, "nr").select(*_CONTENT, "erste"), "bekannt")
    remove(spark, place)
    return known


def deduplicate(spark: SparkSession, items: DataFrame, batch: str = "charge", backlog: int = BACKLOG, window: int = WINDOW, runs: Runs | None = None) -> DataFrame:
    """(nr, erste) of all items: the first batch is the accepted history, every other one is merged into it in order.

    ``backlog`` batches may be merged at once, which changes the work, not the result. Items without a batch number come first.
    With ``runs`` of an earlier call the items are checked against those too, and added to them.
    """
    own = runs is None
    runs = runs or Runs(spark)
    place = new_place(spark, "saetze")
    content = [F.expr(f"xxhash64({seed}, {', '.join(FIELDS)})").alias(c) for seed, c in enumerate(_CONTENT)]
    recs = records(items.withColumn("_stapel", F.coalesce(F.col(batch), F.lit(-1)).cast("int"))).select("*", *content)
    recs.write.partitionBy("_stapel").parquet(place)
    recs = spark.read.schema(f"nr bigint, {_ENTRY}, _h1 bigint, _h2 bigint, _stapel int").parquet(place)
    numbers = sorted(r[0] for r in recs.select("_stapel").distinct().collect())  # one per delivery
    steps = [s for s in [numbers[:1], *[numbers[i : i + backlog] for i in range(1, len(numbers), backlog)]] if s]
    known = [merge_batch(runs, recs.where(F.col("_stapel").isin(step)), window).withColumn("_schritt", F.lit(n)) for n, step in enumerate(steps)]
    if own:
        runs.drop()
    out = recs.where(WORDLESS).select("nr", F.col("nr").alias("erste"))
    if not known:
        return out
    numbered = F.create_map(*[F.lit(x) for n, step in enumerate(steps) for stapel in step for x in (stapel, n)])
    told = recs.where(f"NOT ({WORDLESS})").select("nr", *_CONTENT, numbered[F.col("_stapel")].alias("_schritt"))
    return out.unionByName(told.join(reduce(DataFrame.unionByName, known), [*_CONTENT, "_schritt"]).select("nr", "erste"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item that repeats earlier news, with the first item of that news."""
    items = table(spark, folder, "meldungen").select("nr", "charge", "titel", "zusammenfassung", "kategorie", "begruendung")
    return deduplicate(spark, items).where("erste < nr").select(F.col("erste").alias("nr_a"), F.col("nr").alias("nr_b"))
