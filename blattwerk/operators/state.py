"""User state folded out of event logs: repetition stages, toggles, quiz results, notes. Folds are aggregations, so no
user's history is ever gathered in one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until a card of each stage is due again.
INTERVALS = (1, 3, 7, 16, 35)


def repetition(answers: DataFrame, keys: list[str], order: list[str], known: Column) -> DataFrame:
    """(*keys, stufe, zuletzt): a known answer raises a card by one stage up to the last, an unknown one sets it to 0.

    A card begins below stage 0. Since only answers after the last unknown one count, the fold is a count. Null answers are
    no answers. Ties in the order are settled by its later columns.
    """
    at = F.struct(*order)
    rows = answers.where(known.isNotNull()).select(*keys, at.alias("_at"), known.alias("_known"))
    lapse = rows.where("not _known").groupBy(*keys).agg(F.max("_at").alias("_fehl"))
    joined = rows.alias("r").join(lapse.alias("l"), [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys], "left").select("r.*", "l._fehl")
    since = F.count_if(F.col("_known") & (F.col("_fehl").isNull() | (F.col("_at") > F.col("_fehl"))))
    stage = F.least(F.lit(len(INTERVALS) - 1), F.when(F.max("_fehl").isNull(), -1).otherwise(0) + since)
    return joined.groupBy(*keys).agg(stage.cast("int").alias("stufe"), F.max("_at")[order[0]].alias("zuletzt"))


def due(states: DataFrame) -> DataFrame:
    """Add ``faellig``: the last answer plus the stage's interval."""
    days = F.element_at(F.array(*map(F.lit, INTERVALS)), F.col("stufe") + 1)
    return states.withColumn("faellig", F.col("zuletzt") + F.make_interval(days=days))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that are on: toggled an odd number of times."""
    return events.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def last_write(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(*keys, value): the last value written; a blank one deletes."""
    last = F.max(F.struct(*order, F.col(value).alias("_v")))
    return events.groupBy(*keys).agg(last["_v"].alias(value)).where(F.trim(value) != "")


def quiz_results(tries: DataFrame, keys: list[str], order: list[str], ratio: str, kept: int = 20, enough: float = 0.7) -> DataFrame:
    """(*keys, versuche, bester, bestanden) over the last ``kept`` tries."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = tries.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= kept)
    return last.groupBy(*keys).agg(F.count("*").alias("versuche"), F.max(ratio).alias("bester"), (F.max(ratio) >= enough).alias("bestanden"))


def same_choice(given: Column, right: Column) -> Column:
    """Multiple choice: the same set of answers, whatever the order."""
    return F.array_sort(F.array_distinct(given)) == F.array_sort(F.array_distinct(right))


def gap_filled(given: Column, right: Column) -> Column:
    """A gap: equal without regard to case, or a beginning of more than three characters."""
    a, b = F.lower(F.trim(given)), F.lower(F.trim(right))
    return (a == b) | ((F.length(a) > 3) & F.startswith(b, a))


def one_choice(given: Column, right: Column) -> Column:
    """Single choice, and true or false: the right answer, nothing else; no answer is not right."""
    return F.coalesce(given == right, F.lit(False))


def paired(given: Column, right: Column) -> Column:
    """Pairing: every left side with its right side, in any order; ``given`` and ``right`` are maps."""
    return F.coalesce(F.array_sort(F.map_entries(given)) == F.array_sort(F.map_entries(right)), F.lit(False))


def in_order(given: Column, right: Column) -> Column:
    """Ordering: all parts in the right order."""
    return F.coalesce(given == right, F.lit(False))
