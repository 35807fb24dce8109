"""Integrity checks whose findings are rows of (pruefung, tabelle, schluessel, befund); no findings, no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finding(rows: DataFrame, check: str, name: str, key: Column, text: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("pruefung"), F.lit(name).alias("tabelle"), key.cast("string").alias("schluessel"), text.alias("befund"))


def duplicates(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Keys that occur more than once."""
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return _finding(many, "doppelt", name, F.col(key), F.concat(F.col("_n").cast("string"), F.lit(" mal")))


def required(rows: DataFrame, name: str, key: str, fields: list[str]) -> DataFrame:
    """Fields that are null or blank: one pass, one row per missing field."""
    flags = F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", f) for f in fields])
    missing = rows.select(key, F.explode(F.array_compact(flags)).alias("_f"))
    return _finding(missing, "pflichtfeld", name, F.col(key), F.col("_f"))


def orphans(rows: DataFrame, name: str, key: str, ref: Column, target: DataFrame, on: str) -> DataFrame:
    """References to keys that the target lacks; null references are none."""
    refs = rows.select(F.col(key).alias("_key"), ref.alias("_ref")).where("_ref is not null")
    lost = refs.join(target.select(F.col(on).alias("_ref")).distinct(), "_ref", "left_anti")
    return _finding(lost, "verwaist", name, F.col("_key"), F.col("_ref"))


def too_short(rows: DataFrame, name: str, key: str, text: str, least: int) -> DataFrame:
    """Texts of fewer bytes than ``least``; null counts as none given and is found too."""
    short = rows.where(F.coalesce(F.octet_length(text), F.lit(0)) < least)
    return _finding(short, "zu kurz", name, F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("string"))


def missing_parts(expected: DataFrame, present: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Expected keys that are not present, each once."""
    lost = expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")
    return _finding(lost, "fehlt", name, F.concat_ws("/", *keys), F.lit("nicht vorhanden"))


def all_findings(*found: DataFrame) -> DataFrame:
    """All findings together."""
    return reduce(DataFrame.unionByName, found)
