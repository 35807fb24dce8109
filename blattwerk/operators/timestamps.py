"""Timestamps of mixed notation and zone, normalised through a dictionary of distinct values.

Sources repeat themselves: the same raw string with the same zone is parsed once, whatever the number of
rows that hold it. The dictionary is a table ``(roh, zone, sekunden)`` keyed by raw string and zone; new
values are appended to it (``extend``), so a value that was parsed in an earlier run is never parsed again,
and the instants are joined back to the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import moments
from ..session import new_place, stored, table

DEFAULT_ZONE = "Europe/Berlin"


def distinct_values(rows: DataFrame, raw: str = "roh", zone: str = "zone") -> DataFrame:
    """The distinct pairs of raw string and zone; a hot value is reduced before the shuffle."""
    return rows.where(F.col(raw).isNotNull()).select(F.col(raw).alias("roh"), F.col(zone).alias("zone")).distinct()


def parse(values: DataFrame) -> DataFrame:
    """Add ``sekunden`` (since 1970 UTC, null if the string names no moment) to distinct values."""
    return values.withColumn("sekunden", moments.seconds_of(F.col("roh"), F.col("zone")))


def extend(spark: SparkSession, path: str, values: DataFrame) -> DataFrame:
    """Append what is new among ``values`` to the dictionary stored at ``path`` and return the whole dictionary.

    The table is append-only: a part per call, each written at once, so a lost executor or a broken run leaves
    the earlier parts as they were.
    """
    shape = "roh STRING, zone STRING, sekunden BIGINT"
    fresh = values.join(spark.read.schema(shape).parquet(path), ["roh", "zone"], "left_anti") if stored(spark, path) else values
    parse(fresh).write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def normalise(rows: DataFrame, dictionary: DataFrame, raw: str = "roh", zone: str = "zone", to: str = "utc") -> DataFrame:
    """Join the instants back: every row gets ``to`` as ``YYYY-MM-DDTHH:MM:SSZ``, or null where no moment is named."""
    words = dictionary.select(F.col("roh").alias("_roh"), F.col("zone").alias("_zone"), moments.utc_text(F.col("sekunden")).alias(to))
    joined = rows.join(words, (rows[raw] == F.col("_roh")) & (rows[zone] == F.col("_zone")), "left")
    return joined.drop("_roh", "_zone")


def in_form(raw: Column, utc: Column) -> Column:
    """Whether the raw string already is the normal form of the moment."""
    return F.coalesce(raw == utc, F.lit(False))


def with_zone(news: DataFrame, feeds: DataFrame, default: str = DEFAULT_ZONE) -> DataFrame:
    """Add ``zone``: that of the row's source, or the default if the source is unknown, or has none or no real one.

    Sources registered twice under one id would repeat rows, so one zone is taken per id (the first by name).
    """
    zones = feeds.groupBy(F.col("id").alias("_feed")).agg(F.min("zeitzone").alias("_zone"))
    zones = zones.select("_feed", moments.known_zone(F.col("_zone"), F.lit(default)).alias("zone"))
    joined = news.join(zones, news["quelle"] == F.col("_feed"), "left")
    return joined.withColumn("zone", F.coalesce("zone", F.lit(default))).drop("_feed")


def raw_moments(spark: SparkSession, folder: str) -> DataFrame:
    """All raw values of the three tables as ``(tabelle, nr, roh, zone)``."""
    news = with_zone(table(spark, folder, "meldungen"), table(spark, folder, "feedquellen"))
    sides = [
        news.select(F.lit("meldungen").alias("tabelle"), F.col("nr").cast("bigint").alias("nr"), F.col("datum").alias("roh"), "zone"),
        *[
            table(spark, folder, name).select(F.lit(name).alias("tabelle"), F.col(nr).cast("bigint").alias("nr"), F.col("stand").alias("roh"), F.lit(DEFAULT_ZONE).alias("zone"))
            for name, nr in (("fassungen", "zeile"), ("geparst", "nr"))
        ],
    ]
    return reduce(DataFrame.unionByName, sides)


def dictionary_of(spark: SparkSession, rows: DataFrame, dictionary: str | None = None) -> DataFrame:
    """The dictionary that covers ``rows``: the one stored at a path, extended by what is new, or one for this run only."""
    return extend(spark, dictionary or new_place(spark, "momente"), distinct_values(rows))


def p3_found(spark: SparkSession, folder: str, dictionary: str | None = None) -> DataFrame:
    """Every value that names a moment in another form, with the moment in the one form.

    Null, blank and meaningless values name no moment and give no row; repeated rows each give their own row
    (they differ in ``nr``); an empty table gives no row. ``dictionary``: where the dictionary of earlier runs lies; a value in it
    is not parsed again.
    """
    rows = raw_moments(spark, folder).where(F.col("roh").isNotNull())
    found = normalise(rows, dictionary_of(spark, rows, dictionary))
    return found.where(F.col("utc").isNotNull() & ~in_form(F.col("roh"), F.col("utc"))).select("tabelle", "nr", "utc")


def p3_formen(spark: SparkSession, folder: str, dictionary: str | None = None) -> DataFrame:
    """Per table: how many values name a moment, how many are already in form, and how many name none."""
    rows = raw_moments(spark, folder)
    found = normalise(rows, dictionary_of(spark, rows, dictionary))
    return found.groupBy("tabelle").agg(
        F.count("*").alias("zeilen"),
        F.count("utc").alias("momente"),
        F.count_if(in_form(F.col("roh"), F.col("utc"))).alias("in_form"),
        F.count_if(F.col("utc").isNull()).alias("ohne_moment"),
    )
