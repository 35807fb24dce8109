"""Landed files as DataFrames, parsed in parallel; sinks. Fetching over the network stays outside the engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import SourceError
from .parsers import PARSERS, feed

NODES = (
    "quelle string, id string, eltern string, ord int, tiefe int, art string, nummer string, bez string, titel string, pfad string, "
    "bloecke array<struct<art: string, m: string, t: string, tiefe: int>>, fehler string"
)
ENTRIES = "quelle string, titel string, url string, datum string, text string, fehler string"


def landed(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(quelle, inhalt, stand) of every file below ``path``, whole; with ``since`` only files modified after that time."""
    reader = spark.read
    reader = reader.option("modifiedAfter", since) if since else reader
    rows = reader.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("quelle"), F.col("value").alias("inhalt"), F.col("_metadata.file_modification_time").alias("stand"))


def outlines(files: DataFrame, kind: str) -> DataFrame:
    """The nodes of every file, parsed by the parser of that kind; a broken file is one row with ``fehler`` and no node.

    Null contents are broken; an empty table gives no rows.
    """
    parse = PARSERS[kind]
    names = ["quelle", "id", "eltern", "ord", "tiefe", "art", "nummer", "bez", "titel", "pfad", "bloecke", "fehler"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["quelle"], pdf["inhalt"], strict=True):
                try:
                    rows += [{"quelle": name, **r, "fehler": None} for r in parse(text or "").rows()]
                except SourceError as e:
                    rows.append(dict.fromkeys(names) | {"quelle": name, "fehler": str(e)})
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype="object") for c in names})

    return files.select("quelle", "inhalt").mapInPandas(run, NODES)


def feed_entries(files: DataFrame) -> DataFrame:
    """The entries of every feed file; a broken file is one row with ``fehler``."""
    names = ["quelle", "titel", "url", "datum", "text", "fehler"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["quelle"], pdf["inhalt"], strict=True):
                try:
                    rows += [{"quelle": name, **r, "fehler": None} for r in feed(text or "")]
                except SourceError as e:
                    rows.append(dict.fromkeys(names) | {"quelle": name, "fehler": str(e)})
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype="object") for c in names})

    return files.select("quelle", "inhalt").mapInPandas(run, ENTRIES)


def unchanged_dropped(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content differs from what is remembered of them; ``known``: (quelle, hash). Adds ``hash``."""
    hashed = files.withColumn("hash", F.sha2("inhalt", 256))
    return hashed.join(known.select("quelle", "hash"), ["quelle", "hash"], "left_anti")


def csv_field(c: Column) -> Column:
    """A value as a field: line breaks as blanks, quoted only if it holds a quote or a semicolon; null is empty."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    return F.when(text.rlike('[";]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated files with CRLF; each begins with a byte order mark and the header, as spreadsheets expect."""
    names = ";".join(df.columns)
    lines = df.select(F.concat_ws(";", *[csv_field(F.col(c)) for c in df.columns]).alias("value"))

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in batches:
            if first:
                yield pd.DataFrame({"value": ["﻿" + names]})
                first = False
            yield pdf

    lines.mapInPandas(headed, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
