"""Queries of hashing, versions and outline trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import versions as V
from ..session import table, written

LOCUS = ["regelwerk", "fassung", "knoten_id"]


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "punkte")
    text = V.item_text(F.col("m"), F.col("t"))
    whole = V.ordered_text(items.where("t is not null"), LOCUS, ["ord", "punkt_nr"], text, "\n")
    return whole.select("regelwerk", "fassung", F.col("knoten_id").alias("id"), "text", V.passage_hash(F.col("text")).alias("hash"))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of every version; of several rows of a node the last taken counts."""
    fields = ["eltern", "art", "nummer", "bez", "titel", "pfad", F.col("text").alias("hat_text")]
    last = F.max_by(F.struct(*fields), F.struct("erfasst", "pfad", "eltern", "art", "nummer", "bez", "text"))
    return table(spark, folder, "knoten").groupBy("regelwerk", "fassung", "id").agg(last.alias("k")).select("regelwerk", "fassung", "id", "k.*")


def deliveries(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the deliveries of the register, the last one first."""
    return [r[0] for r in table(spark, folder, "fassungen").select("lieferung").where("lieferung is not null").distinct().orderBy(F.desc("lieferung")).collect()] or [0]


def _register(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of the register, a row per version."""
    rows = table(spark, folder, "fassungen").withColumn("id", F.trim(F.regexp_replace("id", r"\s", ""))).where(F.col("lieferung") == deliveries(spark, folder)[0])
    last = F.max(F.struct("eingang", "zeile", "fundstellen", F.col("quelle.name").alias("quelle")))
    return rows.groupBy("regelwerk", "id").agg(last.alias("v")).select("regelwerk", "id", "v.fundstellen", "v.quelle")


def locus_text(spark, folder):
    items = table(spark, folder, "punkte").where("t is not null")
    return V.ordered_text(items, LOCUS, ["ord", "punkt_nr"], V.item_text(F.col("m"), F.col("t")), " ")


def locus_hash(spark, folder):
    return _passages(spark, folder).select("regelwerk", "fassung", "id", "hash")


def version_total_hash(spark, folder):
    return V.version_hash(_passages(spark, folder), ["regelwerk", "fassung"])


def version_diff(spark, folder):
    rows = written(_passages(spark, folder).select("regelwerk", "fassung", "id", "hash").where("fassung is not null and regelwerk is not null"), "stellen")
    chain = V.successive(rows, "regelwerk", "fassung").where("vorige is not null")
    new = rows.join(chain, ["regelwerk", "fassung"]).select("regelwerk", "fassung", "id", "hash")
    old = rows.alias("r").join(chain.alias("c"), (F.col("r.regelwerk") == F.col("c.regelwerk")) & (F.col("r.fassung") == F.col("c.vorige"))).select("r.regelwerk", "c.fassung", "r.id", "r.hash")
    return V.diff(old, new, ["regelwerk", "fassung", "id"])


def version_validity(spark, folder):
    return V.validity(_register(spark, folder).select("regelwerk", "id"), "regelwerk", "id")


def version_current(spark, folder):
    return _register(spark, folder).groupBy("regelwerk").agg(F.max("id").alias("fassung"))


def version_registry(spark, folder):
    return _register(spark, folder).groupBy("regelwerk").agg(
        F.count("*").alias("fassungen"), F.max_by("fundstellen", "id").alias("fundstellen"), F.sum("fundstellen").alias("alle_fundstellen"),
        F.array_join(F.array_sort(F.collect_set("quelle")), ",").alias("quellen"),
    )


def version_ids(spark, folder):
    """Every version once, whichever delivery first had it; ``zeile`` is the row in which it appeared first."""
    rows = table(spark, folder, "fassungen").select("lieferung", "zeile", "regelwerk", F.regexp_replace("id", r"\s", "").alias("id"))
    first = F.min(F.struct(F.col("lieferung").isNull().alias("ohne"), "lieferung", "zeile"))
    rows = rows.groupBy("regelwerk", "id").agg(first.alias("v")).select("regelwerk", F.substring("id", 1, 10).alias("tag"), "v.ohne", "v.lieferung", "v.zeile")
    return V.version_ids(rows, "regelwerk", F.col("tag"), ["ohne", "lieferung", "zeile"]).select("zeile", "regelwerk", "fassung")


def change_log(spark, folder):
    diffs = version_diff(spark, folder)
    return diffs.groupBy("regelwerk", "fassung").agg(*[F.count_if(F.col("art") == k).alias(k) for k in ("neu", "geaendert", "entfallen")])


def title_merge(spark, folder):
    one = table(spark, folder, "knoten").select("regelwerk", "id", F.explode("titel").alias("sprache", "titel"))
    return one.groupBy("regelwerk", "id").agg(F.min(F.when(F.col("sprache") == "de", F.col("titel"))).alias("de"), F.min(F.when(F.col("sprache") == "en", F.col("titel"))).alias("en"))


def subtree_hash(spark, folder):
    passages = _passages(spark, folder).select("regelwerk", "fassung", "id", "hash")
    return V.subtree_hash(_nodes(spark, folder), passages, ["regelwerk", "fassung"])


def outline_hash(spark, folder):
    """As ``subtree_hash``, over what the outline itself says of each node."""
    nodes = _nodes(spark, folder)
    return V.subtree_hash(nodes, nodes.select("regelwerk", "fassung", "id", V.passage_hash(F.concat_ws("|", "pfad", "art", "nummer")).alias("hash")), ["regelwerk", "fassung"])


def content_refs(spark, folder):
    lessons = table(spark, folder, "lektionen").select("id", F.explode("abschnitte").alias("a")).select("id", F.explode("a.fundstellen").alias("s"))
    return lessons.select("id", F.col("s.rw").alias("rw"), F.col("s.pfad").alias("pfad")).distinct()


def staleness_status(spark, folder):
    refs = content_refs(spark, folder).select("id", F.col("rw").alias("regelwerk")).distinct()
    rows = table(spark, folder, "fassungen").select("lieferung", "regelwerk", F.regexp_replace("id", r"\s", "").alias("v"), "eingang", "zeile", F.regexp_replace(F.lower(F.trim(F.regexp_replace("hash", r"\s", ""))), "^sha256:", "").alias("hash"))

    def at(n: int) -> DataFrame:
        last = rows.where(F.col("lieferung") == n).groupBy("regelwerk", "v").agg(F.max(F.struct("eingang", "zeile", "hash"))["hash"].alias("hash"))
        return last.groupBy("regelwerk").agg(F.max_by("hash", "v").alias("hash"))

    numbers = deliveries(spark, folder)
    return V.staleness(refs, at(numbers[0]), at(numbers[min(1, len(numbers) - 1)]), ["regelwerk"])


def outline_labels(spark, folder):
    nodes = _nodes(spark, folder)
    head = F.coalesce("bez", F.when(F.col("nummer").isNotNull(), F.concat_ws(" ", X.kind_word(F.col("art")), "nummer")).otherwise(X.kind_word(F.col("art"))))
    own = nodes.withColumn("eigen", F.when(F.try_element_at("titel", F.lit("de")).isNotNull(), F.concat(head, F.lit(" – "), F.try_element_at("titel", F.lit("de")))).otherwise(head))
    above = own.select(F.col("regelwerk").alias("_r"), F.col("fassung").alias("_f"), F.col("id").alias("_i"), F.col("eigen").alias("_oben"))
    joined = own.join(above, (F.col("regelwerk") == F.col("_r")) & (F.col("fassung") == F.col("_f")) & (F.col("eltern") == F.col("_i")), "left")
    label = F.when(F.col("art") == "absatz", F.trim(F.concat_ws(" ", "_oben", "eigen"))).otherwise(F.col("eigen"))
    return joined.where("pfad is not null").select("regelwerk", "fassung", "id", "pfad", label.alias("bezeichnung"))


def outline_counts(spark, folder):
    return _nodes(spark, folder).groupBy("regelwerk", "fassung", "art").agg(F.count("*").alias("knoten"), F.count_if("hat_text").alias("mit_text"))


def prev_next(spark, folder):
    w = Window.partitionBy("regelwerk", "fassung", "art").orderBy("id")
    return _nodes(spark, folder).select("regelwerk", "fassung", "id", F.lag("id").over(w).alias("vorher"), F.lead("id").over(w).alias("nachher"))


def nearest_ancestor(spark, folder):
    nodes = _nodes(spark, folder)
    up = V.descendants(nodes, ["regelwerk", "fassung"]).where("tiefe > 0")
    kinds = nodes.select("regelwerk", "fassung", F.col("id").alias("oben"), "art").where("art <> 'absatz'")
    return up.join(kinds, ["regelwerk", "fassung", "oben"]).groupBy("regelwerk", "fassung", "id").agg(F.min_by("oben", "tiefe").alias("oben"))


QUERIES = {f.__name__: f for f in (
    locus_text, locus_hash, version_total_hash, version_diff, version_validity, version_current, version_registry, version_ids, change_log,
    title_merge, subtree_hash, outline_hash, content_refs, staleness_status, outline_labels, outline_counts, prev_next, nearest_ancestor,
)}

# --- SQL --------------------------------------------------------------------------------------------------

_EDGES = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_ITEM = f"regexp_replace(CASE WHEN trim(coalesce(m, '')) = '' THEN t ELSE regexp_replace(m, {_EDGES}) || ' ' || t END, {_EDGES})"
_PASS = f"p AS (SELECT regelwerk, fassung, knoten_id AS id, left(sha256(string_agg({_ITEM}, chr(10) ORDER BY ord, punkt_nr)), 32) AS hash FROM punkte WHERE t IS NOT NULL GROUP BY ALL)"
_LATEST = "SELECT * FROM knoten QUALIFY row_number() OVER (PARTITION BY regelwerk, fassung, id ORDER BY erfasst DESC NULLS LAST, pfad DESC NULLS LAST, eltern DESC NULLS LAST, art DESC NULLS LAST, nummer DESC NULLS LAST, bez DESC NULLS LAST, text DESC NULLS LAST) = 1"
_NODES = f"n AS (SELECT regelwerk, fassung, id, eltern, art, nummer, pfad FROM ({_LATEST}))"
_REG = r"r AS (SELECT regelwerk, regexp_replace(id, '\s', '', 'g') AS id, fundstellen, quelle.name AS quelle FROM fassungen WHERE lieferung = (SELECT max(lieferung) FROM fassungen) QUALIFY row_number() OVER (PARTITION BY regelwerk, regexp_replace(id, '\s', '', 'g') ORDER BY eingang DESC, zeile DESC) = 1)"
_DIFF = f"""{_PASS}, c AS (SELECT regelwerk, fassung, lag(fassung) OVER (PARTITION BY regelwerk ORDER BY fassung) AS vorige FROM (SELECT DISTINCT regelwerk, fassung FROM p WHERE fassung IS NOT NULL AND regelwerk IS NOT NULL)),
  x AS (SELECT p.* FROM p JOIN c USING (regelwerk, fassung) WHERE c.vorige IS NOT NULL),
  y AS (SELECT p.regelwerk, c.fassung, p.id, p.hash FROM p JOIN c ON p.regelwerk = c.regelwerk AND p.fassung = c.vorige),
  d AS (SELECT regelwerk, fassung, id, 'neu' AS art FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE (y.regelwerk, y.fassung, y.id) = (x.regelwerk, x.fassung, x.id))
    UNION ALL SELECT regelwerk, fassung, id, 'entfallen' FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE (y.regelwerk, y.fassung, y.id) = (x.regelwerk, x.fassung, x.id))
    UNION ALL SELECT x.regelwerk, x.fassung, x.id, 'geaendert' FROM x JOIN y USING (regelwerk, fassung, id) WHERE x.hash <> y.hash)"""
_TREE = f"""RECURSIVE {_NODES}, t AS (SELECT regelwerk, fassung, id AS oben, id, 0 AS tiefe FROM n UNION ALL
  SELECT t.regelwerk, t.fassung, n.eltern, t.id, t.tiefe + 1 FROM t JOIN n ON n.regelwerk = t.regelwerk AND n.fassung = t.fassung AND n.id = t.oben WHERE n.eltern IS NOT NULL)"""
_KIND = "CASE art " + " ".join(f"WHEN '{k}' THEN '{de}'" for k, (de, _) in X.KIND_WORDS.items()) + " ELSE art END"


#: The last delivery and the one before it.
LAST = "(SELECT max(lieferung) FROM fassungen)"
BEFORE = f"(SELECT max(lieferung) FROM fassungen WHERE lieferung < {LAST})"


def _state(n: str) -> str:
    return f"""(SELECT regelwerk, arg_max_null(h, v) AS h FROM (SELECT regelwerk, regexp_replace(id, '\\s', '', 'g') AS v, regexp_replace(regexp_replace(lower(hash), '\\s', '', 'g'), '^sha256:', '') AS h FROM fassungen
        WHERE lieferung = {n} QUALIFY row_number() OVER (PARTITION BY regelwerk, regexp_replace(id, '\\s', '', 'g') ORDER BY eingang DESC, zeile DESC) = 1) GROUP BY regelwerk)"""


SQL = {
    "locus_text": f"SELECT regelwerk, fassung, knoten_id, string_agg({_ITEM}, ' ' ORDER BY ord, punkt_nr) AS text FROM punkte WHERE t IS NOT NULL GROUP BY ALL",
    "locus_hash": f"WITH {_PASS} SELECT * FROM p",
    "version_total_hash": f"WITH {_PASS} SELECT regelwerk, fassung, sha256(coalesce(string_agg(id || chr(31) || hash || chr(10), '' ORDER BY id), '')) AS gesamt, count(*) AS stellen FROM p GROUP BY ALL",
    "version_diff": f"WITH {_DIFF} SELECT * FROM d",
    "version_validity": f"WITH {_REG} SELECT regelwerk, id, lead(id) OVER (PARTITION BY regelwerk ORDER BY id) AS gueltig_bis FROM r",
    "version_current": f"WITH {_REG} SELECT regelwerk, max(id) AS fassung FROM r GROUP BY regelwerk",
    "version_registry": f"""WITH {_REG} SELECT regelwerk, count(*) AS fassungen, arg_max_null(fundstellen, id) AS fundstellen, CAST(sum(fundstellen) AS BIGINT) AS alle_fundstellen,
        coalesce(string_agg(DISTINCT quelle, ',' ORDER BY quelle), '') AS quellen FROM r GROUP BY regelwerk""",
    "version_ids": r"""WITH v AS (SELECT regelwerk, regexp_replace(id, '\s', '', 'g') AS id, min((lieferung, zeile)) AS erst FROM fassungen GROUP BY ALL)
        SELECT erst[2] AS zeile, regelwerk, left(id, 10) || repeat('b', CAST(row_number() OVER (PARTITION BY regelwerk, left(id, 10) ORDER BY erst) - 1 AS INT)) AS fassung FROM v""",
    "change_log": f"WITH {_DIFF} SELECT regelwerk, fassung, count(*) FILTER (art = 'neu') AS neu, count(*) FILTER (art = 'geaendert') AS geaendert, count(*) FILTER (art = 'entfallen') AS entfallen FROM d GROUP BY ALL",
    "title_merge": "SELECT regelwerk, id, min(titel['de']) AS de, min(titel['en']) AS en FROM knoten WHERE titel IS NOT NULL AND cardinality(titel) > 0 GROUP BY ALL",
    "subtree_hash": f"""WITH {_TREE}, {_PASS}, w AS (SELECT regelwerk, fassung, id, list(oben ORDER BY tiefe DESC) AS weg FROM t GROUP BY ALL)
        SELECT t.regelwerk, t.fassung, t.oben AS id, left(sha256(string_agg(p.hash, '|' ORDER BY w.weg)), 32) AS hash, count(*) AS stellen FROM t JOIN w ON w.regelwerk = t.regelwerk AND w.fassung = t.fassung AND w.id = t.id
        JOIN p ON p.regelwerk = t.regelwerk AND p.fassung = t.fassung AND p.id = t.id GROUP BY ALL""",
    "outline_hash": f"""WITH {_TREE}, h AS (SELECT regelwerk, fassung, id, left(sha256(concat_ws('|', pfad, art, nummer)), 32) AS h FROM n), w AS (SELECT regelwerk, fassung, id, list(oben ORDER BY tiefe DESC) AS weg FROM t GROUP BY ALL)
        SELECT t.regelwerk, t.fassung, t.oben AS id, left(sha256(string_agg(h.h, '|' ORDER BY w.weg)), 32) AS hash, count(*) AS stellen FROM t JOIN w ON w.regelwerk = t.regelwerk AND w.fassung = t.fassung AND w.id = t.id
        JOIN h ON h.regelwerk = t.regelwerk AND h.fassung = t.fassung AND h.id = t.id GROUP BY ALL""",
    "content_refs": "SELECT DISTINCT id, f.rw AS rw, f.pfad AS pfad FROM (SELECT id, unnest(a.fundstellen) AS f FROM (SELECT id, unnest(abschnitte) AS a FROM lektionen))",
    "staleness_status": f"""WITH r AS (SELECT DISTINCT id, f.rw AS regelwerk FROM (SELECT id, unnest(a.fundstellen) AS f FROM (SELECT id, unnest(abschnitte) AS a FROM lektionen)))
        SELECT r.id, r.regelwerk, CASE WHEN n.h IS NULL THEN 'fehlt' WHEN k.h IS NULL THEN 'erfasst' WHEN n.h = k.h THEN 'aktuell' ELSE 'zu pruefen' END AS status, coalesce(n.h, '') AS hash
        FROM r LEFT JOIN {_state(LAST)} n ON n.regelwerk = r.regelwerk LEFT JOIN {_state(BEFORE)} k ON k.regelwerk = r.regelwerk""",
    "outline_labels": f"""WITH k AS (SELECT regelwerk, fassung, id, eltern, art, pfad, nummer, bez, titel['de'] AS de FROM ({_LATEST})),
        o AS (SELECT *, coalesce(bez, CASE WHEN nummer IS NOT NULL THEN {_KIND} || ' ' || nummer ELSE {_KIND} END) || coalesce(' – ' || de, '') AS eigen FROM k)
        SELECT o.regelwerk, o.fassung, o.id, o.pfad, CASE WHEN o.art = 'absatz' THEN trim(concat_ws(' ', p.eigen, o.eigen)) ELSE o.eigen END AS bezeichnung
        FROM o LEFT JOIN o p ON p.regelwerk = o.regelwerk AND p.fassung = o.fassung AND p.id = o.eltern WHERE o.pfad IS NOT NULL""",
    "outline_counts": f"SELECT regelwerk, fassung, art, count(*) AS knoten, count(*) FILTER (text) AS mit_text FROM ({_LATEST}) GROUP BY ALL",
    "prev_next": f"WITH {_NODES} SELECT regelwerk, fassung, id, lag(id) OVER w AS vorher, lead(id) OVER w AS nachher FROM n WINDOW w AS (PARTITION BY regelwerk, fassung, art ORDER BY id)",
    "nearest_ancestor": f"WITH {_TREE} SELECT t.regelwerk, t.fassung, t.id, arg_min(t.oben, t.tiefe) AS oben FROM t JOIN n ON n.regelwerk = t.regelwerk AND n.fassung = t.fassung AND n.id = t.oben WHERE t.tiefe > 0 AND n.art <> 'absatz' GROUP BY ALL",
}
