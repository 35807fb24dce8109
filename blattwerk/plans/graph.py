"""Queries of citations, matrices, user state and integrity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations as C
from ..operators import integrity as I
from ..operators import state as Z
from ..session import table


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "verweise").dropDuplicates(["verweis_nr"])  # repeated rows are alike
    return rows.select("verweis_nr", F.col("von.rw").alias("von_rw"), F.col("von.pfad").alias("von_pfad"), F.col("nach.rw").alias("nach_rw"), F.col("nach.pfad").alias("nach_pfad"), "typ", "quelle", "konfidenz", "erfasst", "beleg")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "knoten").select("regelwerk", "pfad").where("pfad is not null").distinct()


# --- citations --------------------------------------------------------------------------------------------


def citation_extract(spark, folder):
    return C.mine(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"], "text")


def citation_counts(spark, folder):
    return citation_extract(spark, folder).where("art = 'art'").groupBy("doc_id").agg(F.count("*").alias("artikel"), F.count("absatz").alias("mit_absatz"))


def citation_resolve(spark, folder):
    docs = table(spark, folder, "documents").where("regelwerk is not null").select("doc_id", "regelwerk", "text")
    acts = table(spark, folder, "fassungen").select("regelwerk", X.act_number(F.regexp_replace(F.col("quelle.celex"), "^9(\\d{4})X", "3$1R")).alias("nummer")).where("nummer is not null")
    acts = acts.groupBy("nummer").agg(F.min("regelwerk").alias("regelwerk"))
    return C.resolve(C.mine(docs, ["doc_id", "regelwerk"], "text"), _paths(spark, folder), acts).select("doc_id", "regelwerk", "nach_rw", "nach_pfad").distinct()


def pair_counts_directed(spark, folder):
    return C.directed(_edges(spark, folder), "von_rw", "nach_rw")


def pair_counts_undirected(spark, folder):
    return C.undirected(_edges(spark, folder), "von_rw", "nach_rw", "quelle")


def node_degree(spark, folder):
    return C.degree(pair_counts_undirected(spark, folder))


def prefix_relations(spark, folder):
    """Per place: the relations that touch it or a place above it with either end, each once."""
    edges = _edges(spark, folder)
    ends = [edges.select(F.col("verweis_nr").alias("id"), F.col(f"{side}_rw").alias("rw"), F.col(f"{side}_pfad").alias("pfad")) for side in ("von", "nach")]
    return C.touch_counts(ends[0].unionByName(ends[1]), _paths(spark, folder))


# --- matrices and lookups ---------------------------------------------------------------------------------

MATRIX_KINDS = ["rts", "its", "vo", "rl", "lz", "rs", "kat", "std", "gl", "dvo"]


def mapping_matrix(spark, folder):
    """Relations by the kinds of the works at their two ends; kinds without a column of their own are counted in ``andere``."""
    kinds = MATRIX_KINDS
    kind = lambda c: F.regexp_extract(c, r"-([a-z]+)-\d+$", 1)
    to = kind(F.col("nach_rw"))
    rows = _edges(spark, folder).select(kind(F.col("von_rw")).alias("von"), F.when(to.isin(kinds), to).otherwise("andere").alias("nach"))
    return rows.groupBy("von").pivot("nach", [*kinds, "andere"]).agg(F.count(F.lit(1))).na.fill(0)


def heatmap_stage(spark, folder):
    pairs = table(spark, folder, "meldungen").select(F.explode("themen").alias("thema"), "regelwerke").select("thema", F.explode("regelwerke").alias("regelwerk"))
    counts = pairs.groupBy("thema", "regelwerk").agg(F.count("*").alias("fein"))
    most = counts.agg(F.max("fein")).first()[0] or 1  # one number
    return counts.withColumn("stufe", F.least(F.lit(4), F.ceil(F.col("fein") * 4 / F.lit(most))).cast("int"))


def duty_matrix(spark, folder):
    cells = table(spark, folder, "knoten").select("art", F.explode("titel").alias("sprache", "wort"))
    return cells.groupBy("art").pivot("sprache", ["de", "en"]).agg(F.min("wort"))


def raci_matrix(spark, folder):
    rows = table(spark, folder, "meldungen").select(F.explode("themen").alias("thema"), "kategorie")
    letter = F.when(F.col("kategorie") == "Sanktion", "A").when(F.col("kategorie") == "Rundschreiben", "R").when(F.col("kategorie") == "Konsultation", "C").otherwise("I")
    return rows.select("thema", letter.alias("b")).groupBy("thema").pivot("b", ["R", "A", "C", "I"]).agg(F.count(F.lit(1))).na.fill(0)


def timeline_union(spark, folder):
    register = table(spark, folder, "fassungen").select("regelwerk", F.substring(F.regexp_replace("id", r"\s", ""), 1, 10).alias("tag"), F.lit("fassung").alias("art"))
    lessons = table(spark, folder, "lektionen").select(F.col("id").alias("regelwerk"), F.col("stand").cast("string").alias("tag"), F.lit("lektion").alias("art"))
    return register.unionByName(lessons).where("tag is not null").distinct().withColumn("jahr", F.substring("tag", 1, 4))


def footnote_match(spark, folder):
    """Per news item: the lessons that look up one of its works or share a topic with it, each once.

    Topics are counted per distinct set of topics, not per item; added are the lessons that match by work only.
    """
    topics = F.array_sort(F.filter(F.array_distinct("themen"), lambda t: t.isNotNull()))
    news = table(spark, folder, "meldungen").select("nr", topics.alias("themen"), "regelwerke")
    lessons = table(spark, folder, "lektionen").where("id is not null")
    of = lessons.select("id", F.explode("themen").alias("thema")).distinct()
    by_topic = news.select("themen").distinct().select("themen", F.explode("themen").alias("thema")).join(of, "thema").groupBy("themen").agg(F.countDistinct("id").alias("_thema"))
    works = lessons.select("id", F.explode("abschnitte").alias("a")).select("id", F.explode("a.fundstellen").alias("s")).select("id", F.col("s.rw").alias("k")).distinct()
    by_work = news.select("nr", "themen", F.explode("regelwerke").alias("k")).join(works, "k").select("nr", "themen", "id").distinct()
    own = of.groupBy("id").agg(F.collect_set("thema").alias("_eigene"))
    more = by_work.join(own, "id", "left").where(~F.coalesce(F.arrays_overlap("themen", "_eigene"), F.lit(False))).groupBy("nr").agg(F.count("*").alias("_werk"))
    both = news.select("nr", "themen").join(by_topic, "themen", "left").join(more, "nr", "left")
    return both.select("nr", (F.coalesce("_thema", F.lit(0)) + F.coalesce("_werk", F.lit(0))).alias("lektionen")).where("lektionen > 0")


def topic_lookup(spark, folder):
    lessons = table(spark, folder, "lektionen").select("id", F.explode("themen").alias("thema")).distinct()
    news = table(spark, folder, "meldungen").select("nr", F.explode("themen").alias("thema")).distinct()
    a = lessons.groupBy("thema").agg(F.count("*").alias("lektionen"))
    return news.groupBy("thema").agg(F.count("*").alias("meldungen")).join(a, "thema", "full").na.fill(0, ["lektionen", "meldungen"])


def catalog_filter(spark, folder):
    rows = table(spark, folder, "knoten")
    return rows.where((F.col("art") == "artikel") & F.col("text") & F.col("geloescht").isNull() & F.lower(F.try_element_at("titel", F.lit("de"))).contains("plan")).select("regelwerk", "pfad").distinct()


def group_counts(spark, folder):
    return table(spark, folder, "lektionen").groupBy(F.coalesce("stufe", F.lit("ohne")).alias("stufe")).agg(F.countDistinct("id").alias("lektionen"))


def effective_relevance(spark, folder):
    feeds = table(spark, folder, "feedquellen").select("id", "aktiv", "mindestpunkte")
    own = table(spark, folder, "meldungen").groupBy(F.col("quelle").alias("id")).agg(F.max("punkte").alias("eigene"))
    return feeds.join(own, "id", "left").select("id", F.when(F.coalesce("aktiv", F.lit(True)), F.coalesce("mindestpunkte", "eigene", F.lit(8))).otherwise(0).alias("wirksam"))


def kpi_totals(spark, folder):
    return table(spark, folder, "knoten").agg(F.countDistinct("regelwerk").alias("werke"), F.count("*").alias("knoten"), F.count_if("text").alias("mit_text"), F.countDistinct("regelwerk", "pfad").alias("stellen"), F.count_if(F.col("geloescht").isNotNull()).alias("entfallen"))


def glossary_terms(spark, folder):
    rows = table(spark, folder, "indexdokumente").select("regelwerk", F.regexp_extract("t", r"^(\S+(?: \S+){0,3}?) (?:zur|der|über|für|bei) ", 1).alias("begriff"))
    return rows.where("begriff <> ''").groupBy("begriff").agg(F.countDistinct("regelwerk").alias("werke"))


# --- user state -------------------------------------------------------------------------------------------


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    known = F.when(F.col("event_type") == "error", False).when(F.col("event_type").isin("click", "purchase"), True)
    return Z.repetition(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], known)


def card_stage(spark, folder):
    return _cards(spark, folder).select("user_id", "stufe")


def due_cards(spark, folder):
    return Z.due(_cards(spark, folder)).where("faellig <= timestamp_ntz'2024-01-31 00:00:00'").select("user_id", "stufe", F.date_format("faellig", "yyyy-MM-dd HH:mm:ss").alias("faellig"))


def quiz_best(spark, folder):
    tries = table(spark, folder, "events").where("event_type = 'view'").select("user_id", "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 100).alias("quote"))
    return Z.quiz_results(tries, ["user_id"], ["ts", "event_id"], "quote").withColumn("bester", F.round("bester", 6))


def toggle_state(spark, folder):
    return Z.toggled(table(spark, folder, "events").select("user_id", F.get_json_object("props", "$.k").alias("k")), ["user_id", "k"])


def last_note(spark, folder):
    return Z.last_write(table(spark, folder, "events").where("event_type = 'signup'"), ["user_id"], ["ts", "event_id"], "props")


def answer_checks(spark, folder):
    """The six kinds of answers, each with one that is right for some lessons only: what is asked is the lesson, what is answered is derived from it."""
    rows = table(spark, folder, "lektionen").select("id", "themen", "titel", "stufe", "dauer", F.transform("abschnitte", lambda a: a["titel"]).alias("teile")).distinct()
    numbered = lambda order: F.map_from_entries(F.transform(F.filter(F.array_distinct(F.coalesce(order, F.array())), lambda t: t.isNotNull()), lambda t, i: F.struct(t, i)))
    return rows.select(
        "id", Z.one_choice(F.col("stufe"), F.lit("Grundkurs")).alias("einfach"), Z.same_choice(F.slice("themen", 1, 2), F.col("themen")).alias("mehrfach"),
        Z.one_choice(F.col("dauer") >= 30, F.col("stufe") != "Grundkurs").alias("wahr_falsch"), Z.gap_filled(F.substring("titel", 1, 5), F.col("titel")).alias("luecke"),
        Z.paired(numbered(F.array_sort(F.col("teile"))), numbered(F.col("teile"))).alias("zuordnung"), Z.in_order(F.array_sort("themen"), F.col("themen")).alias("reihenfolge"),
    ).distinct()


def volume_counts(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("ereignisse"), F.countDistinct("user_id").alias("nutzer"))


# --- integrity --------------------------------------------------------------------------------------------


def integrity_duplicates(spark, folder):
    return I.all_findings(I.duplicates(table(spark, folder, "verweise"), "verweise", "verweis_nr"), I.duplicates(table(spark, folder, "lektionen"), "lektionen", "id"), I.duplicates(table(spark, folder, "meldungen"), "meldungen", "id"))


def integrity_required(spark, folder):
    return I.all_findings(I.required(table(spark, folder, "meldungen"), "meldungen", "nr", ["titel", "url", "datum", "zusammenfassung", "herausgeber"]), I.required(table(spark, folder, "geparst"), "geparst", "nr", ["titel", "stand", "version", "typ"]))


def integrity_orphans(spark, folder):
    works = table(spark, folder, "fassungen").select("regelwerk")
    feeds = table(spark, folder, "feedquellen")
    return I.all_findings(
        I.orphans(_edges(spark, folder), "verweise", "verweis_nr", F.col("nach_rw"), works, "regelwerk"),
        I.orphans(table(spark, folder, "meldungen"), "meldungen", "nr", F.col("quelle"), feeds, "id"),
    )


def integrity_short_evidence(spark, folder):
    return I.too_short(_edges(spark, folder), "verweise", "verweis_nr", "beleg", 40)


def integrity_paths(spark, folder):
    nodes = table(spark, folder, "knoten").where("text").select("regelwerk", "fassung", "id")
    texts = table(spark, folder, "indexdokumente").select("regelwerk", "fassung", "id")
    return I.missing_parts(nodes.na.drop(), texts.na.drop(), "knoten", ["regelwerk", "fassung", "id"])


QUERIES = {f.__name__: f for f in (
    citation_extract, citation_counts, citation_resolve, pair_counts_directed, pair_counts_undirected, node_degree, prefix_relations, mapping_matrix,
    heatmap_stage, duty_matrix, raci_matrix, timeline_union, footnote_match, topic_lookup, catalog_filter, group_counts, effective_relevance, kpi_totals,
    glossary_terms, card_stage, due_cards, quiz_best, toggle_state, last_note, answer_checks, volume_counts,
    integrity_duplicates, integrity_required, integrity_orphans, integrity_short_evidence, integrity_paths,
)}

# --- SQL --------------------------------------------------------------------------------------------------

_E = "e AS (SELECT DISTINCT verweis_nr, von.rw AS von_rw, von.pfad AS von_pfad, nach.rw AS nach_rw, nach.pfad AS nach_pfad, typ, quelle, konfidenz, erfasst, beleg FROM verweise)"
_U = f"{_E}, u AS (SELECT least(von_rw, nach_rw) AS x, greatest(von_rw, nach_rw) AS y, count(*) AS anzahl, string_agg(DISTINCT quelle, ',' ORDER BY quelle) AS typen FROM e WHERE von_rw <> nach_rw GROUP BY ALL)"
_STAGE = """k AS (SELECT user_id, ts, event_id, event_type <> 'error' AS known FROM events WHERE event_type IN ('error', 'click', 'purchase')),
l AS (SELECT user_id, max((ts, event_id)) AS f FROM k WHERE NOT known GROUP BY user_id),
s AS (SELECT k.user_id, CAST(least(4, CASE WHEN any_value(l.f) IS NULL THEN -1 ELSE 0 END + count(*) FILTER (known AND (l.f IS NULL OR (ts, event_id) > l.f))) AS INT) AS stufe, max(ts) AS zuletzt FROM k LEFT JOIN l USING (user_id) GROUP BY k.user_id)"""

_TOUCH = " OR ".join(f"(e.{s}.rw = p.regelwerk AND (e.{s}.pfad IS NULL OR p.pfad = e.{s}.pfad OR (starts_with(p.pfad, e.{s}.pfad || '/') AND len(string_split(e.{s}.pfad, '/')) % 2 = 0)))" for s in ("von", "nach"))


def _re2(pattern: str) -> str:
    """A pattern of the miner in the notation of the other engine, whose classes know ASCII only."""
    return pattern.replace(r"\s", r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]").replace(r"\d", r"\p{Nd}")


# every match with the wording before it gives its place; from there the snippet and the window in which an act may follow
_MINED = " UNION ALL ".join(
    f"""SELECT doc_id, regelwerk, text, '{kind}' AS art, ms[i] AS m, regexp_extract(ms[i], '{_re2(pattern)}', 1) AS nummer, nullif(regexp_extract(ms[i], '{_re2(pattern)}', 2), '') AS absatz,
      CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regelwerk, text, regexp_extract_all(text, '{_re2(pattern)}') AS ms, string_split_regex(text, '{_re2(pattern)}') AS parts FROM documents WHERE length(text) > 0) WHERE len(ms) > 0)"""
    for kind, pattern in (("art", C.ARTICLE), ("par", C.SECTION))
)
_CITED = rf"""x AS ({_MINED}), y AS (SELECT *, a + length(m) AS e, length(text) AS n FROM x),
  z AS (SELECT *, CASE WHEN art = 'art' THEN left(substr(text, e + 1, {C.REACH}), list_max(list_filter(range(0, {C.REACH} + 1), lambda k: strlen(left(substr(text, e + 1, {C.REACH}), CAST(k AS BIGINT))) <= {C.REACH}))) END AS f, greatest(0, a - 45) AS l, e + greatest(0, least(55, n - e) - 1) AS r FROM y),
  c AS (SELECT doc_id, regelwerk, art, nummer, absatz, CASE WHEN regexp_matches(f, '{_re2(C.ACT)}') AND strlen(split_part(f, regexp_extract(f, '{_re2(C.ACT)}'), 1)) <= {C.BEGIN} THEN regexp_extract(f, '{_re2(C.ACT)}', 1) END AS akt,
    CASE WHEN l > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, l + 1, r - l), '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g') || CASE WHEN r < n THEN '…' ELSE '' END AS beleg FROM z)"""


def _missing(name: str, key: str, fields: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT 'pflichtfeld' AS pruefung, '{name}' AS tabelle, CAST({key} AS VARCHAR) AS schluessel, '{f}' AS befund FROM {name} WHERE coalesce(trim({f}, ' '), '') = ''" for f in fields)


def _double(name: str, key: str) -> str:
    return f"SELECT 'doppelt' AS pruefung, '{name}' AS tabelle, CAST({key} AS VARCHAR) AS schluessel, count(*) || ' mal' AS befund FROM {name} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1"


SQL = {
    "citation_extract": f"WITH {_CITED} SELECT doc_id, art, nummer, absatz, akt, beleg FROM c",
    "citation_resolve": rf"""WITH {_CITED}, g AS (SELECT substr(k, 2, 4) || '/' || CAST(CAST(substr(k, 7, 4) AS INT) AS VARCHAR) AS nr, min(regelwerk) AS rw FROM (SELECT regelwerk, regexp_replace(quelle.celex, '^9(\\d{{4}})X', '3\1R') AS k FROM fassungen) WHERE regexp_matches(k, '^3\\d{{4}}[RLD]\\d{{4}}$') GROUP BY 1),
        p AS (SELECT DISTINCT regelwerk AS rw, pfad FROM knoten WHERE pfad IS NOT NULL), d AS (SELECT c.doc_id, c.regelwerk, CASE WHEN art = 'art' THEN coalesce(g.rw, c.regelwerk) ELSE c.regelwerk END AS nach_rw, art || '/' || nummer AS grob, art || '/' || nummer || '/abs/' || absatz AS fein FROM c LEFT JOIN g ON g.nr = c.akt WHERE c.regelwerk IS NOT NULL)
        SELECT DISTINCT d.doc_id, d.regelwerk, d.nach_rw, coalesce(f.pfad, o.pfad) AS nach_pfad FROM d LEFT JOIN p f ON f.rw = d.nach_rw AND f.pfad = d.fein LEFT JOIN p o ON o.rw = d.nach_rw AND o.pfad = d.grob WHERE coalesce(f.pfad, o.pfad) IS NOT NULL""",
    "citation_counts": f"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{C.ARTICLE}')) AS m FROM documents)
        SELECT doc_id, count(*) AS artikel, count(*) FILTER (contains(m, 'Absatz')) AS mit_absatz FROM a GROUP BY doc_id""",
    "pair_counts_directed": f"WITH {_E} SELECT von_rw, nach_rw, count(*) AS anzahl FROM e GROUP BY ALL",
    "pair_counts_undirected": f"WITH {_U} SELECT * FROM u",
    "node_degree": f"WITH {_U} SELECT knoten, CAST(sum(anzahl) AS BIGINT) AS grad FROM (SELECT x AS knoten, anzahl FROM u UNION ALL SELECT y, anzahl FROM u) GROUP BY knoten",
    "prefix_relations": f"""WITH p AS (SELECT DISTINCT regelwerk, pfad FROM knoten WHERE pfad IS NOT NULL)
        SELECT p.regelwerk, p.pfad, count(DISTINCT e.verweis_nr) AS beziehungen FROM p JOIN verweise e ON {_TOUCH} GROUP BY ALL""",
    "mapping_matrix": f"""WITH {_E}, k AS (SELECT regexp_extract(von_rw, '-([a-z]+)-\\d+$', 1) AS von, regexp_extract(nach_rw, '-([a-z]+)-\\d+$', 1) AS nach FROM e)
        SELECT von, {", ".join(f"count(*) FILTER (nach = '{k}') AS {k}" for k in MATRIX_KINDS)}, count(*) FILTER (nach IS NULL OR nach NOT IN {tuple(MATRIX_KINDS)}) AS andere FROM k GROUP BY von""",
    "heatmap_stage": """WITH c AS (SELECT thema, regelwerk, count(*) AS fein FROM (SELECT thema, unnest(regelwerke) AS regelwerk FROM (SELECT unnest(themen) AS thema, regelwerke FROM meldungen)) GROUP BY ALL)
        SELECT thema, regelwerk, fein, CAST(least(4, ceil(fein * 4.0 / (SELECT max(fein) FROM c))) AS INT) AS stufe FROM c""",
    "duty_matrix": "SELECT art, min(titel['de']) AS de, min(titel['en']) AS en FROM knoten WHERE titel IS NOT NULL AND cardinality(titel) > 0 GROUP BY art",
    "raci_matrix": """WITH b AS (SELECT unnest(themen) AS thema, CASE kategorie WHEN 'Sanktion' THEN 'A' WHEN 'Rundschreiben' THEN 'R' WHEN 'Konsultation' THEN 'C' ELSE 'I' END AS b FROM meldungen)
        SELECT thema, count(*) FILTER (b = 'R') AS R, count(*) FILTER (b = 'A') AS A, count(*) FILTER (b = 'C') AS C, count(*) FILTER (b = 'I') AS I FROM b GROUP BY thema""",
    "timeline_union": r"""SELECT *, left(tag, 4) AS jahr FROM (SELECT DISTINCT regelwerk, left(regexp_replace(id, '\s', '', 'g'), 10) AS tag, 'fassung' AS art FROM fassungen UNION SELECT id, CAST(stand AS VARCHAR), 'lektion' FROM lektionen) WHERE tag IS NOT NULL""",
    "footnote_match": """WITH w AS (SELECT DISTINCT id, f.rw AS k FROM (SELECT id, unnest(a.fundstellen) AS f FROM (SELECT id, unnest(abschnitte) AS a FROM lektionen))), n AS (SELECT nr, unnest(regelwerke) AS k FROM meldungen),
        l AS (SELECT DISTINCT id, unnest(themen) AS thema FROM lektionen), m AS (SELECT nr, unnest(themen) AS thema FROM meldungen)
        SELECT nr, count(DISTINCT id) AS lektionen FROM (SELECT nr, id FROM n JOIN w USING (k) UNION ALL SELECT nr, id FROM m JOIN l USING (thema)) GROUP BY nr""",
    "topic_lookup": """WITH l AS (SELECT thema, count(DISTINCT id) AS n FROM (SELECT id, unnest(themen) AS thema FROM lektionen) GROUP BY thema), m AS (SELECT thema, count(DISTINCT nr) AS n FROM (SELECT nr, unnest(themen) AS thema FROM meldungen) GROUP BY thema)
        SELECT coalesce(l.thema, m.thema) AS thema, coalesce(m.n, 0) AS meldungen, coalesce(l.n, 0) AS lektionen FROM m FULL JOIN l USING (thema)""",
    "catalog_filter": "SELECT DISTINCT regelwerk, pfad FROM knoten WHERE art = 'artikel' AND text AND geloescht IS NULL AND contains(lower(titel['de']), 'plan')",
    "group_counts": "SELECT coalesce(stufe, 'ohne') AS stufe, count(DISTINCT id) AS lektionen FROM lektionen GROUP BY ALL",
    "effective_relevance": "SELECT f.id, CASE WHEN coalesce(f.aktiv, true) THEN coalesce(f.mindestpunkte, m.p, 8) ELSE 0 END AS wirksam FROM feedquellen f LEFT JOIN (SELECT quelle, max(punkte) AS p FROM meldungen GROUP BY quelle) m ON m.quelle = f.id",
    "kpi_totals": "SELECT count(DISTINCT regelwerk) AS werke, count(*) AS knoten, count(*) FILTER (text) AS mit_text, count(DISTINCT (regelwerk, pfad)) FILTER (regelwerk IS NOT NULL AND pfad IS NOT NULL) AS stellen, count(geloescht) AS entfallen FROM knoten",
    "glossary_terms": r"SELECT begriff, count(DISTINCT regelwerk) AS werke FROM (SELECT regelwerk, regexp_extract(t, '^([^\s]+(?: [^\s]+){0,3}?) (?:zur|der|über|für|bei) ', 1) AS begriff FROM indexdokumente) WHERE begriff <> '' GROUP BY begriff",
    "card_stage": f"WITH {_STAGE} SELECT user_id, stufe FROM s",
    "due_cards": f"WITH {_STAGE}, f AS (SELECT user_id, stufe, zuletzt + to_days(CAST(([1, 3, 7, 16, 35])[stufe + 1] AS INT)) AS f FROM s) SELECT user_id, stufe, strftime(f, '%Y-%m-%d %H:%M:%S') AS faellig FROM f WHERE f <= TIMESTAMP '2024-01-31 00:00:00'",
    "quiz_best": """WITH t AS (SELECT user_id, least(1.0, value / 100) AS q FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20)
        SELECT user_id, count(*) AS versuche, round(max(q), 6) AS bester, max(q) >= 0.7 AS bestanden FROM t GROUP BY user_id""",
    "toggle_state": "SELECT user_id, k FROM (SELECT user_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL HAVING count(*) % 2 = 1",
    "last_note": "SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING trim(arg_max(props, (ts, event_id))) <> ''",
    "answer_checks": """WITH l AS (SELECT DISTINCT id, themen, titel, stufe, dauer, list_filter(list_transform(coalesce(abschnitte, []), lambda a: a.titel), lambda t: t IS NOT NULL) AS teile FROM lektionen),
        d AS (SELECT *, list_filter(teile, lambda t, i: list_position(teile, t) = i) AS eigene FROM l)
        SELECT DISTINCT id, coalesce(stufe = 'Grundkurs', false) AS einfach, list_sort(list_distinct(themen[1:2])) = list_sort(list_distinct(themen)) AS mehrfach, coalesce((dauer >= 30) = (stufe <> 'Grundkurs'), false) AS wahr_falsch,
        lower(trim(left(titel, 5))) = lower(trim(titel)) OR (length(trim(left(titel, 5))) > 3 AND starts_with(lower(trim(titel)), lower(trim(left(titel, 5))))) AS luecke,
        list_sort(eigene) = eigene AS zuordnung, coalesce(list_sort(themen) = themen, false) AS reihenfolge FROM d""",
    "volume_counts": "SELECT event_type, count(*) AS ereignisse, count(DISTINCT user_id) AS nutzer FROM events GROUP BY event_type",
    "integrity_duplicates": " UNION ALL ".join((_double("verweise", "verweis_nr"), _double("lektionen", "id"), _double("meldungen", "id"))),
    "integrity_required": _missing("meldungen", "nr", ["titel", "url", "datum", "zusammenfassung", "herausgeber"]) + " UNION ALL " + _missing("geparst", "nr", ["titel", "stand", "version", "typ"]),
    "integrity_orphans": f"""WITH {_E} SELECT 'verwaist' AS pruefung, 'verweise' AS tabelle, CAST(verweis_nr AS VARCHAR) AS schluessel, nach_rw AS befund FROM e WHERE nach_rw IS NOT NULL AND nach_rw NOT IN (SELECT regelwerk FROM fassungen WHERE regelwerk IS NOT NULL)
        UNION ALL SELECT 'verwaist', 'meldungen', CAST(nr AS VARCHAR), quelle FROM meldungen WHERE quelle IS NOT NULL AND quelle NOT IN (SELECT id FROM feedquellen WHERE id IS NOT NULL)""",
    "integrity_short_evidence": f"WITH {_E} SELECT 'zu kurz' AS pruefung, 'verweise' AS tabelle, CAST(verweis_nr AS VARCHAR) AS schluessel, CAST(coalesce(strlen(beleg), 0) AS VARCHAR) AS befund FROM e WHERE coalesce(strlen(beleg), 0) < 40",
    "integrity_paths": """SELECT DISTINCT 'fehlt' AS pruefung, 'knoten' AS tabelle, regelwerk || '/' || fassung || '/' || id AS schluessel, 'nicht vorhanden' AS befund FROM knoten k WHERE text AND regelwerk IS NOT NULL AND fassung IS NOT NULL AND id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM indexdokumente i WHERE i.regelwerk = k.regelwerk AND i.fassung = k.fassung AND i.id = k.id)""",
}
