"""References of learning content to places, out of its five nested shapes: (ort, rw, pfad), the place where each stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(rows: DataFrame, at: Column, place: Column) -> DataFrame:
    """References that name both work and path; the others refer to nothing."""
    return rows.select(at.alias("ort"), place["rw"].alias("rw"), place["pfad"].alias("pfad")).where("rw is not null and pfad is not null")


def _id() -> Column:
    return F.coalesce("id", F.lit("?"))


def of_lessons(lessons: DataFrame) -> DataFrame:
    """Sections with places: id/abschnitt-k, counted from 1."""
    parts = lessons.select("id", F.posexplode("abschnitte").alias("k", "a")).select("id", "k", F.explode("a.fundstellen").alias("f"))
    return _found(parts, F.concat(_id(), F.lit("/abschnitt-"), (F.col("k") + 1).cast("string")), F.col("f"))


def of_quizzes(quizzes: DataFrame) -> DataFrame:
    """Questions with one place each: id/frage-k, counted from 1."""
    parts = quizzes.select("id", F.posexplode("fragen").alias("k", "q"))
    return _found(parts, F.concat(_id(), F.lit("/frage-"), (F.col("k") + 1).cast("string")), F.col("q.fundstelle"))


def of_cards(cards: DataFrame) -> DataFrame:
    """Cards with one place each: id."""
    return _found(cards, _id(), F.col("fundstelle"))


def of_cases(cases: DataFrame) -> DataFrame:
    """Steps of cases, with places of their own and of their options: id/step."""
    steps = cases.select("id", F.explode("schritte").alias("s"))
    at = F.concat(_id(), F.lit("/"), F.coalesce(F.col("s.id"), F.lit("?")))
    options = steps.select("id", "s", F.explode("s.optionen").alias("o"))
    own = steps.select("id", "s", F.explode("s.fundstellen").alias("f"))
    return _found(options, at, F.col("o.fundstelle")).unionByName(_found(own, at, F.col("f")))


def of_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets, whose points are places: id."""
    points = sheets.select("id", F.explode("bloecke").alias("b")).select("id", F.explode("b.punkte").alias("p"))
    return _found(points, _id(), F.col("p"))


SHAPES = {"lektionen": of_lessons, "quizzes": of_quizzes, "karten": of_cards, "fallstudien": of_cases, "cheatsheets": of_sheets}


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """(datei, ort, rw, pfad) of the given kinds of content, as often as they stand there. Null or empty lists hold none."""
    return reduce(DataFrame.unionByName, [SHAPES[name](df).select(F.lit(name).alias("datei"), "*") for name, df in tables.items()])
