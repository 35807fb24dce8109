"""Hashes of passages and versions, validity, registries, outline trees, staleness of what refers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def item_text(mark: Column, text: Column) -> Column:
    """A list item as text: mark and wording with a blank between, either may be missing."""
    edges = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    return F.regexp_replace(F.concat_ws(" ", F.nullif(F.regexp_replace(mark, edges, ""), F.lit("")), text), edges, "")


def ordered_text(rows: DataFrame, keys: list[str], order: list[str], text: Column, between: str) -> DataFrame:
    """(*keys, text): the texts of each passage in order, joined. Null texts are left out. A passage is as long as its text is."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return rows.where(text.isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_t"]), between).alias("text"))


def passage_hash(text: Column) -> Column:
    """Hash of a passage: the first 32 hex digits of the SHA-256 of its blocks joined by line feeds."""
    return F.substring(F.sha2(text, 256), 1, 32)


def version_hash(passages: DataFrame, keys: list[str], id_: str = "id", hash_: str = "hash") -> DataFrame:
    """(*keys, gesamt): SHA-256 over all passages of a version in byte order of their ids. A version is as large as its work."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(id_).alias("i"), F.col(hash_).alias("h"))))
    lines = F.transform(listed, lambda x: F.concat(x["i"], F.lit("\x1f"), x["h"], F.lit("\n")))
    return passages.groupBy(*keys).agg(F.sha2(F.array_join(lines, ""), 256).alias("gesamt"), F.count("*").alias("stellen"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], hash_: str = "hash") -> DataFrame:
    """(*keys, art): neu, entfallen or geaendert, by hash."""
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    both = new.withColumn("_n", F.lit(1)).alias("n").join(old.withColumn("_o", F.lit(1)).alias("o"), same, "full")
    kind = F.when(F.col("o._o").isNull(), "neu").when(F.col("n._n").isNull(), "entfallen").when(~F.col(f"n.{hash_}").eqNullSafe(F.col(f"o.{hash_}")), "geaendert")
    return both.select(*[F.when(F.col("n._n").isNotNull(), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys], kind.alias("art")).where("art is not null")


def successive(versions: DataFrame, work: str, version: str) -> DataFrame:
    """Each version with the one before it: (work, version, vorige)."""
    w = Window.partitionBy(work).orderBy(version)
    return versions.select(work, version).distinct().withColumn("vorige", F.lag(version).over(w))


def validity(versions: DataFrame, work: str, begin: str) -> DataFrame:
    """Versions with ``gueltig_bis``: where the next one of the work begins; the current one has none."""
    w = Window.partitionBy(work).orderBy(begin)
    return versions.withColumn("gueltig_bis", F.lead(begin).over(w))


def version_ids(rows: DataFrame, work: str, day: Column, order: list[str]) -> DataFrame:
    """Give versions ids: the day, with as many b appended as versions of the work had that day before."""
    w = Window.partitionBy(work, "_tag").orderBy(*order)
    return rows.withColumn("_tag", day).withColumn("fassung", F.concat("_tag", F.repeat(F.lit("b"), F.row_number().over(w) - 1))).drop("_tag")


def outline_paths(nodes: DataFrame, keys: list[str], id_: str = "id", parent: str = "eltern") -> DataFrame:
    """(*keys, id, weg): every node with the ids from the top of its outline down to itself. Sorted by it, nodes stand in outline order.

    One round per level, each over the nodes of that level only. A parent that is no node opens the way of its children. Nodes
    that no top leads to lie in a cycle, which is an error.
    """
    same = lambda a, b, x, y: [*[F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.col(f"{a}.{x}") == F.col(f"{b}.{y}")]
    rows = written(nodes.select(*keys, F.col(id_).alias("id"), F.col(parent).alias("_oben")).where("id is not null"), "knoten")
    tops = rows.alias("n").join(rows.alias("o"), same("n", "o", "_oben", "id"), "left_anti")
    level = written(tops.select(*keys, "id", F.array_compact(F.array("_oben", "id")).alias("weg")), "ebene")
    out, found = level, level.count()
    while True:
        level = rows.alias("n").join(level.alias("l"), same("n", "l", "_oben", "id")).select(*[f"n.{k}" for k in keys], "n.id", F.array_append("l.weg", F.col("n.id")).alias("weg"))
        level = written(level, "ebene")
        more = level.count()
        if not more:
            break
        out, found = out.unionByName(level), found + more
    if found < rows.count():
        raise ValueError("an outline has a cycle")
    return out


def descendants(nodes: DataFrame, keys: list[str], id_: str = "id", parent: str = "eltern") -> DataFrame:
    """(*keys, oben, id, tiefe, weg): every node with itself (depth 0) and all nodes above it; ``weg``: its way from the top."""
    ways = outline_paths(nodes, keys, id_, parent)
    return ways.select(*keys, "id", "weg", F.posexplode("weg").alias("_p", "oben")).select(*keys, "oben", "id", (F.size("weg") - 1 - F.col("_p")).alias("tiefe"), "weg")


def subtree_hash(nodes: DataFrame, passages: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, id, hash, stellen): per node the digest of its own and its descendants' hashes in outline order; nodes above no passage have none."""
    below = descendants(nodes, keys).alias("b")
    joined = below.join(passages.alias("p"), [*[F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], F.col("b.id") == F.col("p.id")])
    listed = F.array_sort(F.collect_list(F.struct(F.col("b.weg").alias("w"), F.col("p.hash").alias("h"))))
    chain = F.array_join(F.transform(listed, lambda x: x["h"]), "|")
    return joined.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b.oben").alias("id")).agg(passage_hash(chain).alias("hash"), F.count("*").alias("stellen"))


def staleness(refs: DataFrame, now: DataFrame, known: DataFrame, keys: list[str], confirm: bool = False) -> DataFrame:
    """The state of content by what it refers to: ``fehlt``, ``erfasst``, ``aktuell``, ``zu pruefen`` or ``bestaetigt``.

    ``now`` and ``known``: (*keys, hash) at present and when last looked at. The new hash is handed out in any case, so
    that the next look compares with it; what is missing has an empty one.
    """
    r = refs.alias("r").join(now.alias("n"), [F.col(f"r.{k}") == F.col(f"n.{k}") for k in keys], "left").join(known.alias("k"), [F.col(f"r.{k}") == F.col(f"k.{k}") for k in keys], "left")
    status = (
        F.when(F.col("n.hash").isNull(), "fehlt").when(F.col("k.hash").isNull(), "erfasst")
        .when(F.col("n.hash") == F.col("k.hash"), "aktuell").otherwise("bestaetigt" if confirm else "zu pruefen")
    )
    return r.select("r.*", status.alias("status"), F.coalesce(F.col("n.hash"), F.lit("")).alias("hash"))
