"""The registry of the training-data queries. Their results depend on tokenizers, tries, windows and formulas that SQL
cannot express at this size, so the operators are tested against brute-force versions instead (tests/llm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encoding, glyphs, mixing, neighbourhood, readability

_QUERIES = {
    "p2_found": neighbourhood.p2_found,
    "p5_found": glyphs.p5_found,
    "p5_formen": glyphs.p5_formen,
    "p5_klassen": glyphs.p5_klassen,
    "p6_ids": encoding.p6_ids,
    "p6_rueckweg": encoding.p6_rueckweg,
    "p7_mischung": mixing.p7_mischung,
    "p7_anteile": mixing.p7_anteile,
    "p8_found": readability.p8_found,
    "p8_profil": readability.p8_profil,
}

_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
