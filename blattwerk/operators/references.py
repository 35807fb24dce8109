"""References to records that do not exist, that are gone, or that come later.

Composite keys may be null in part. References are grouped by their null mask (which key columns are null), each
mask is matched on its non-null columns only, and the declared match semantics say what a mask means:

- ``partial``: the non-null columns must be found together in the target,
- ``simple``: a reference with any null column is satisfied,
- ``full``: all columns null is satisfied, some null is an orphan.

Columns may be declared ``required``: a reference that lacks one is an orphan under any semantics but that all columns are null.

With periods of validity, a reference at moment t is satisfied if a period of the target holds t. Periods are merged once per
whole key; those of a mask are merged from these, so the target is read and shuffled once.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written


def null_masks(width: int) -> list[tuple[bool, ...]]:
    """All null masks of a key of ``width`` columns; True: the column is null."""
    return list(product((False, True), repeat=width))


_FAR = "9999-12-31 00:00:00"


def merged_periods(target: DataFrame, on: list[str], start: str, end: str, also: str | None = None) -> DataFrame:
    """Per key the disjoint periods (``start``, ``end`` exclusive, null = open) that its rows cover together.

    Overlapping and touching periods are merged in two steps, first within the month in which they start, then
    across months, so that even a key with a third of all rows is spread over tasks. Rows without a start, or that
    end before they start, cover nothing. ``also``: a column of which the smallest value is kept per period.
    """
    far = F.lit(_FAR).cast(dict(target.dtypes)[start])
    kept = [F.col(also).alias("_also")] if also else []
    rows = target.select(*on, F.col(start).alias("_s"), F.coalesce(F.col(end), far).alias("_e"), *kept).where("_s < _e")
    rows = rows.groupBy(*on, "_s", "_e").agg(F.min("_also").alias("_also")) if also else rows.distinct()
    least = [F.min("_also").alias("_also")] if also else []

    def merge(df: DataFrame, keys: list[Column]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("_s", "_e")
        reached = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        opened = df.withColumn("_new", F.when(reached >= F.col("_s"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
        extra = [c for c in ("_month",) if c in df.columns]
        return opened.groupBy(*on, *extra, "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), *least)

    monthly = merge(rows.withColumn("_month", F.trunc("_s", "month")), [*map(F.col, on), F.col("_month")]).drop("_month", "_island")
    whole = merge(monthly, [F.col(c) for c in on])
    kept = [F.col("_also").alias(also)] if also else []
    return whole.select(*on, F.col("_s").alias(start), F.when(F.col("_e") < far, F.col("_e")).alias(end), *kept)


def _key_periods(there: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(*keys, start, end, _ended): per whole key its merged periods, each with the first end among its rows; rows that cover nothing as one without period."""
    covers = F.coalesce(F.col(start) < F.coalesce(F.col(end), F.lit(_FAR).cast(dict(there.dtypes)[start])), F.lit(False))
    merged = merged_periods(there.withColumn("_ended", F.col(end)).where(covers), keys, start, end, "_ended")
    nothing = there.where(~covers).groupBy(*keys).agg(F.min(end).alias("_ended"))
    none = F.lit(None).cast(dict(there.dtypes)[start])
    return merged.unionByName(nothing.select(*keys, none.alias(start), none.alias(end), "_ended"))


def _unmatched(rows: DataFrame, there: DataFrame, names: dict[str, str], at: str | None, valid: tuple[str, str] | None, fewer: bool) -> DataFrame:
    """References of one null mask that find nothing by their non-null columns; ``fewer``: some columns of the key are null."""
    same = [F.col(f"r.{a}") == F.col(f"t.{k}") for a, k in names.items()]
    keys = list(names.values())
    if not valid:
        return rows.alias("r").join(there.select(*keys).distinct().alias("t"), same, "left_anti").withColumn("grund", F.lit("fehlt"))
    start, end = valid
    covered = there.where(F.col(start).isNotNull())
    periods = merged_periods(covered, keys, start, end) if fewer else covered
    moment = F.col(f"r.{at}")
    holds = (F.col(f"t.{start}") <= moment) & (F.col(f"t.{end}").isNull() | (moment < F.col(f"t.{end}")))
    missing = rows.alias("r").join(periods.alias("t"), [*same, holds], "left_anti")
    known = missing.alias("r").join(there.groupBy(*keys).agg(F.min("_ended").alias("_ended")).alias("t"), same, "left")
    grund = F.when(F.col(f"t.{keys[0]}").isNull(), "fehlt").when(F.col("t._ended") <= moment, "geloescht").otherwise("spaeter")
    return known.select("r.*", grund.alias("grund"))


def orphans(
    refs: DataFrame, target: DataFrame, on: list[tuple[str, str]], match: str = "partial", at: str | None = None, valid: tuple[str, str] | None = None, required: tuple[str, ...] = (),
) -> DataFrame:
    """The references that find nothing in ``target``, with ``grund``.

    ``on``: pairs (column of the reference, column of the target); ``required``: columns of the reference that may not be null. Without
    ``at`` and ``valid`` grund is ``fehlt``. With them it is ``fehlt`` if the key never exists, else ``geloescht`` if a period of
    it had ended by then, else ``spaeter``. References at no moment (null) are not judged. Repeated references are kept as they
    come; a column grund is replaced. A mask in which all columns are null refers to nothing and is satisfied. The references may be
    skewed to a few keys: the periods of a key are a few rows once merged, and adaptive execution splits the hot side.
    """
    if match not in ("partial", "simple", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    refs = refs.drop("grund")
    names = {a: f"_k{i}" for i, (a, _) in enumerate(on)}
    there = target.select(*[F.col(b).alias(names[a]) for a, b in on], *(valid or ()))
    if valid:
        there = written(_key_periods(there, list(names.values()), *valid), "zeiten")
    found = []
    for mask in null_masks(len(on)):
        if all(mask):
            continue
        missing_one = any(null and a in required for (a, _), null in zip(on, mask, strict=True))
        if any(mask) and match == "simple" and not missing_one:
            continue
        rows = refs.where(reduce(lambda x, y: x & y, [F.col(a).isNull() if null else F.col(a).isNotNull() for (a, _), null in zip(on, mask, strict=True)]))
        if at:
            rows = rows.where(F.col(at).isNotNull())
        if missing_one or any(mask) and match == "full":
            found.append(rows.withColumn("grund", F.lit("fehlt")))
            continue
        keys = [a for (a, _), null in zip(on, mask, strict=True) if not null]
        found.append(_unmatched(rows, there, {a: names[a] for a in keys}, at, valid, any(mask)))
    return reduce(DataFrame.unionByName, found)


# --- places of regulations --------------------------------------------------------------------------------


def canonical_path(c: Column) -> Column:
    """A path in lower case, without blanks and slashes at the ends; null stays null."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}/]+|[\s\p{Z}/]+$", ""))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Every place referred to: (tabelle, schluessel, seite, t, rw, pfad), as often as it is delivered."""
    cites = table(spark, folder, "verweise")
    sides = [
        cites.select(F.lit("verweise").alias("tabelle"), F.col("verweis_nr").cast("string").alias("schluessel"), F.lit(side).alias("seite"), F.col("erfasst").alias("t"), F.col(f"{side}.rw").alias("rw"), canonical_path(F.col(f"{side}.pfad")).alias("pfad"))
        for side in ("von", "nach")
    ]
    lessons = (
        table(spark, folder, "lektionen")
        .select("id", F.col("stand").cast("timestamp_ntz").alias("t"), F.posexplode("abschnitte").alias("a", "abschnitt"))
        .select("id", "t", "a", F.posexplode("abschnitt.fundstellen").alias("s", "stelle"))
        .select(
            F.lit("lektionen").alias("tabelle"),
            F.concat_ws("/", "id", (F.col("a") + 1).cast("string"), (F.col("s") + 1).cast("string")).alias("schluessel"),
            F.lit("fundstelle").alias("seite"), "t", F.col("stelle.rw").alias("rw"), canonical_path(F.col("stelle.pfad")).alias("pfad"),
        )
    )
    return reduce(DataFrame.unionByName, [*sides, lessons])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Places referred to that are not in force at that moment, each once, with the reason.

    A null path stands for the whole work; a path without a work is found nowhere, since works must be equal; a reference without
    work and path names no place; a blank path is a path that no locus has. Rows without a moment are not judged.
    """
    loci = table(spark, folder, "knoten").select("regelwerk", canonical_path(F.col("pfad")).alias("pfad"), "erfasst", "geloescht")
    on = [("rw", "regelwerk"), ("pfad", "pfad")]
    found = orphans(places(spark, folder), loci, on, "partial", "t", ("erfasst", "geloescht"), required=("rw",))
    return found.select("tabelle", "schluessel", "seite", F.date_format("t", "yyyy-MM").alias("periode"), "grund").distinct()


def p4_je_monat(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return p4_found(spark, folder).groupBy("tabelle", "periode", "grund").agg(F.count("*").alias("anzahl"))
