"""Citations mined from wording, resolved to existing places, and views of the graph they form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a citation of an article, of a section and of a legal act is written.
_NUMBER = r"(\d{1,3}[a-z]?)"
ARTICLE = rf"Artikel\s+{_NUMBER}(?:\s+Absatz\s+{_NUMBER})?"
SECTION = rf"§\s*{_NUMBER}(?:\s+Absatz\s+{_NUMBER})?"
ACT = r"(?:Verordnung|Richtlinie)\s+\(E[UG]\)\s+(?:Nr\.\s*)?(\d{1,4}/\d{2,4})"
#: Bytes after a citation in which the act it belongs to must lie, and in which it must begin.
REACH, BEGIN = 90, 40
_PATTERNS = (("art", re.compile(ARTICLE)), ("par", re.compile(SECTION)))
_ACT = re.compile(ACT)


def act_after(text: str, at: int) -> str | None:
    """The number of the act that a citation ending at ``at`` belongs to, if one follows at once."""
    window = text[at : at + REACH].encode()[:REACH].decode(errors="ignore")
    m = _ACT.search(window)
    return m[1] if m and len(window[: m.start()].encode()) <= BEGIN else None


def evidence(text: str, start: int, end: int) -> str:
    """A snippet around a citation: 45 characters before, up to 54 after, ellipses where more was cut off."""
    left = max(0, start - 45)
    right = end + max(0, min(55, len(text) - end) - 1)
    return ("…" if left else "") + text[left:right].strip() + ("…" if right < len(text) else "")


def mine(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, art, nummer, absatz, akt, beleg): every citation of every text. Null and empty texts have none."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, t in pdf[[*keys, "_t"]].itertuples(index=False, name=None):
                for kind, pattern in _PATTERNS:
                    for m in pattern.finditer(t):
                        rows.append((*key, kind, m[1], m[2], act_after(t, m.end()) if kind == "art" else None, evidence(t, m.start(), m.end())))
            yield pd.DataFrame(rows, columns=[*keys, "art", "nummer", "absatz", "akt", "beleg"], dtype="object")

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", art string, nummer string, absatz string, akt string, beleg string"
    return docs.where(F.length(text) > 0).select(*keys, F.col(text).alias("_t")).mapInPandas(run, schema)


def resolve(found: DataFrame, paths: DataFrame, acts: DataFrame, work: str = "regelwerk", own_path: Column | None = None) -> DataFrame:
    """Resolve mined citations to the finest place that exists: the paragraph, else the article, else nothing.

    ``paths``: distinct (regelwerk, pfad). ``acts``: (nummer, regelwerk), one work per number. A citation followed by an act
    that is not known counts as one of the own work. Sections are sought in works that have sections only, which the
    paths decide by themselves. With ``own_path`` citations of the own place or one above it are dropped.
    """
    to = acts.select(F.col("nummer").alias("akt"), F.col("regelwerk").alias("_fremd"))
    rows = found.join(to, "akt", "left").withColumn("nach_rw", F.when(F.col("art") == "art", F.coalesce("_fremd", work)).otherwise(F.col(work))).drop("_fremd")
    coarse = F.concat_ws("/", "art", "nummer")
    rows = rows.withColumns({"_grob": coarse, "_fein": F.when(F.col("absatz").isNotNull(), F.concat(coarse, F.lit("/abs/"), "absatz"))})
    known = paths.select(F.col("regelwerk").alias("_rw"), F.col("pfad").alias("_pfad"))
    # one equi-join on the article's path: its paragraphs lie below it
    tops = known.select("_rw", F.regexp_extract("_pfad", "^[^/]+/[^/]+", 0).alias("_oben"), "_pfad").where("_oben <> ''")
    joined = rows.join(tops, (rows["nach_rw"] == tops["_rw"]) & (rows["_grob"] == tops["_oben"]) & ((tops["_pfad"] == rows["_grob"]) | (tops["_pfad"] == rows["_fein"])))
    keys = [c for c in rows.columns if c not in ("_grob", "_fein")]
    finest = joined.groupBy(*keys).agg(F.max_by("_pfad", F.length("_pfad")).alias("nach_pfad"))
    if own_path is None:
        return finest
    own = (F.col(work) == F.col("nach_rw")) & ((own_path == F.col("nach_pfad")) | F.startswith(own_path, F.concat(F.col("nach_pfad"), F.lit("/"))))
    return finest.where(~F.coalesce(own, F.lit(False)))


def directed(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, anzahl), pairs of a work with itself included."""
    return edges.groupBy(a, b).agg(F.count("*").alias("anzahl"))


def undirected(edges: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """(x, y, anzahl, typen) with x < y."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), kind)
    return pairs.groupBy("x", "y").agg(F.count("*").alias("anzahl"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("typen"))


def degree(pairs: DataFrame) -> DataFrame:
    """(knoten, grad): the sum of the counts of a node's pairs."""
    ends = pairs.select(F.col("x").alias("knoten"), "anzahl").unionByName(pairs.select(F.col("y").alias("knoten"), "anzahl"))
    return ends.groupBy("knoten").agg(F.sum("anzahl").alias("grad"))


def path_prefixes(path: Column) -> Column:
    """A path and all paths above it: for art/28/abs/4 also art/28."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(parts) / 2))), lambda k: F.array_join(F.slice(parts, 1, F.when(F.size(parts) == 1, 1).otherwise(2 * k).cast("int")), "/"))


def touch_counts(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(regelwerk, pfad, beziehungen): how many relations touch a place or one above it with either end, each once.

    ``edges``: (id, rw, pfad) of both ends, null path: the whole work. ``places``: (regelwerk, pfad), each once. Places are exploded
    into their prefixes and joined on equality; ends at a whole work are counted per work and added, not joined with its places.
    """
    above = places.select("regelwerk", "pfad", F.explode(path_prefixes(F.col("pfad"))).alias("_vor"))
    ends = edges.select("id", F.col("rw").alias("regelwerk"), F.col("pfad").alias("_vor"))
    whole = ends.where("_vor is null").select("regelwerk", "id").distinct()
    exact = above.join(ends.where("_vor is not null").join(whole, ["regelwerk", "id"], "left_anti").distinct(), ["regelwerk", "_vor"])
    narrow = exact.groupBy("regelwerk", "pfad").agg(F.countDistinct("id").alias("_eng"))
    wide = whole.groupBy("regelwerk").agg(F.count("*").alias("_weit"))
    counted = places.join(narrow, ["regelwerk", "pfad"], "left").join(wide, "regelwerk", "left")
    return counted.select("regelwerk", "pfad", (F.coalesce("_eng", F.lit(0)) + F.coalesce("_weit", F.lit(0))).alias("beziehungen")).where("beziehungen > 0")
