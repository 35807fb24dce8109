"""Queries of screening, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import moments
from ..functions import text as X
from ..operators import screening as S
from ..session import table
from .searching import clean_sql

LEXICON = S.Lexicon(
    (
        S.Term("Auslagerung", 9, ("outsourcing",), ("auslagerung",), ("w-auslagerung", "w-dienste")),
        S.Term("Notfallplanung", 8, ("contingency planning", "Wiederanlauf"), ("notfall",), ("w-dienste",)),
        S.Term("Meldepflicht", 9, ("Störungsmeldung", "incident notices", "reporting duties"), ("meldewesen",)),
        S.Term("Bußgeld", 7, ("penalty", "fined"), ("sanktion",)),
        S.Term("Schlüsselverwaltung", 6, ("key management", "Zugriffskontrolle"), ("zugriff", "verschluesselung")),
        S.Term("Nr.", 1, ("No.",)),
        S.Term("IKT", 5, ("ITS", "RTS")),
    ),
    ("Gastbeitrag", "Fachtag"),
)
WORDS = ["Ausfall", "Bußgeld", "Quartal", "Frist"]


def _news(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "meldungen")


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn("monat", F.date_format("eingang", "yyyy-MM"))


def relevance_score(spark, folder):
    s = S.score(F.col("titel"), F.col("zusammenfassung"), LEXICON)
    return _news(spark, folder).select("nr", s["punkte"].alias("punkte"))


def relevance_reasons(spark, folder):
    s = S.score(F.col("titel"), F.col("zusammenfassung"), LEXICON)
    return _news(spark, folder).select("nr", F.array_join(s["begruendung"], "; ").alias("begruendung"), F.array_join(s["themen"], ",").alias("themen"), F.array_join(s["regelwerke"], ",").alias("regelwerke"))


def relevance_threshold(spark, folder):
    s = S.score(F.col("titel"), F.col("zusammenfassung"), LEXICON)
    feeds = table(spark, folder, "feedquellen").select(F.col("id").alias("quelle"), "mindestpunkte")
    scored = _news(spark, folder).select("nr", "quelle", s["punkte"].alias("punkte")).join(feeds, "quelle", "left")
    return scored.where(F.col("punkte") >= F.coalesce("mindestpunkte", F.lit(8))).select("nr", "punkte")


def category_rules(spark, folder):
    return _news(spark, folder).select("nr", S.category(F.col("titel"), F.col("zusammenfassung")).alias("kategorie"))


def extractive_summary(spark, folder):
    return _news(spark, folder).select("nr", S.extract(F.col("zusammenfassung"), WORDS, 150).alias("auszug"))


def title_similarity_links(spark, folder):
    return S.similar_counts(_news(spark, folder).select("nr", "titel"), "nr", "titel")


def greedy_dedup_month(spark, folder):
    """What the months hold after all deliveries: the stored history (charge 0), and of the rest what is neither known by id nor alike to what is there."""
    news = _month(_news(spark, folder)).select("monat", "nr", "titel", "id", (F.col("charge") == 0).alias("da"))
    return S.greedy_selection(news, "nr", "titel", ["monat"], "da", "id")


def feed_date_parse(spark, folder):
    """Every item's date as one UTC moment: RFC 2822, else RFC 3339, else null."""
    raw = _news(spark, folder).select("nr", F.col("datum").alias("roh"))
    words = raw.select("roh").where("roh is not null").distinct()  # every notation is read once
    read = words.select("roh", moments.utc_text(moments.feed_seconds_of(F.col("roh"))).alias("datum"))
    return raw.join(read, "roh", "left").select("nr", "datum")


def feed_month_bucket(spark, folder):
    """Items per month of their date; one that names no date goes into the current month."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM")
    month = F.coalesce(F.substring("datum", 1, 7), now)
    return feed_date_parse(spark, folder).groupBy(month.alias("monat")).agg(F.count("*").alias("meldungen"))


def month_directory(spark, folder):
    return _month(_news(spark, folder)).groupBy("monat").agg(F.count("*").alias("meldungen"))


def newest_n(spark, folder):
    return S.newest(_month(_news(spark, folder)), "monat", [F.desc("eingang"), F.desc("nr")], 40).select("nr", "monat")


def digest_7d(spark, folder):
    first = _news(spark, folder).select("nr", "eingang").orderBy(F.desc("eingang"), F.desc("nr")).limit(40)
    recent = first.withColumn("bis", F.max("eingang").over(Window.partitionBy())).where(F.col("eingang") >= F.col("bis") - F.expr("INTERVAL 7 DAYS"))  # of 40 rows
    return recent.orderBy(F.desc("eingang"), F.desc("nr")).limit(10).select("nr")


def news_filter(spark, folder):
    text = F.lower(F.concat_ws(" ", "titel", "zusammenfassung", "quelle_name"))
    return _news(spark, folder).where((F.col("kategorie") == "Sanktion") & text.contains("auslagerung") & (F.col("charge") > 0)).select("nr", "quelle")


def facet_values(spark, folder):
    news = _news(spark, folder)
    sides = [news.select(F.lit(c).alias("merkmal"), F.col(c).alias("wert")).where(F.trim("wert") != "") for c in ("kategorie", "quelle_name", "herausgeber")]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("merkmal", "wert").agg(F.count("*").alias("anzahl"))


def feedback_terms(spark, folder):
    rejected = _news(spark, folder).where("charge = 0").select(F.explode("begruendung").alias("b")).select(F.substring_index("b", " (", 1).alias("begriff"))
    return rejected.groupBy("begriff").agg(F.count("*").alias("anzahl")).orderBy(F.desc("anzahl"), "begriff").limit(12)


def run_source_counters(spark, folder):
    return _news(spark, folder).groupBy("charge", "quelle").agg(
        F.count("*").alias("gefunden"), F.count_if(F.col("punkte") >= 20).alias("uebernommen"), F.count_if(F.trim(F.coalesce("zusammenfassung", F.lit(""))) == "").alias("ohne_text"), F.max("eingang").cast("string").alias("zuletzt"),
    )


def source_state(spark, folder):
    """The last that is known of every source: an upsert by source, newest first."""
    last = F.max(F.struct("eingang", "nr", X.url_id(F.col("url")).alias("kennung")))
    return _news(spark, folder).groupBy("quelle").agg(last.alias("x")).select("quelle", F.col("x.nr").alias("nr"), "x.kennung")


QUERIES = {f.__name__: f for f in (
    relevance_score, relevance_reasons, relevance_threshold, category_rules, extractive_summary, title_similarity_links, greedy_dedup_month,
    feed_date_parse, feed_month_bucket, month_directory, newest_n, digest_7d, news_filter, facet_values, feedback_terms, run_source_counters, source_state,
)}

# --- SQL --------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(word: str) -> str:
    import re

    return "(^|[^\\p{L}\\p{N}])" + re.sub(r"([.\-/()+*?])", r"\\\1", word)


# one scan with a literal pattern per variant: RE2 compiles each once
_VARIANTS = " UNION ALL ".join(
    f"""SELECT nr, {i} AS term, {k} AS k, {_q(v)} AS wort, {_q(",".join(t.topics))} AS themen, {_q(",".join(t.works))} AS werke,
        {t.weight} * CASE WHEN regexp_matches({"t" if X.is_acronym(v) else "lower(t)"}, {_q(_re(v if X.is_acronym(v) else v.lower()))}) THEN 2 ELSE 1 END AS p
        FROM m WHERE regexp_matches({"v" if X.is_acronym(v) else "lower(v)"}, {_q(_re(v if X.is_acronym(v) else v.lower()))})"""
    for i, t in enumerate(LEXICON.terms)
    for k, v in enumerate(t.variants)
)
_EXCLUDED = " UNION ALL ".join(f"SELECT nr, {i} AS k, {_q(w)} AS wort FROM m WHERE regexp_matches(lower(v), {_q(_re(w.lower()))})" for i, w in enumerate(LEXICON.excluded))
_SCORED = f"""
m AS (SELECT nr, coalesce(titel, '') AS t, coalesce(titel, '') || ' ' || coalesce(zusammenfassung, '') AS v FROM meldungen),
h AS (SELECT * FROM ({_VARIANTS}) QUALIFY row_number() OVER (PARTITION BY nr, term ORDER BY k) = 1),
e AS ({_EXCLUDED}),
g AS (SELECT nr, sum(p) AS p FROM (SELECT nr, p FROM h UNION ALL SELECT nr, -12 FROM e) GROUP BY nr),
s AS (SELECT m.nr, coalesce(g.p, 0) AS punkte FROM m LEFT JOIN g USING (nr))"""
_CASES = " ".join(f"WHEN regexp_matches(v, {_q(p)}) THEN {_q(k)}" for k, p in S.CATEGORIES.items())
_SETS = r"""w AS (SELECT nr, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(titel, '')), '[^\p{L}\p{N}]+'), lambda x: strlen(x) > 3))) AS w FROM meldungen),
r AS (SELECT w, min(nr) AS klasse FROM w GROUP BY w), rr AS (SELECT * FROM r WHERE len(w) >= 3), x AS (SELECT klasse, unnest(w) AS t FROM rr),
p AS (SELECT a.klasse AS a, b.klasse AS b, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.klasse < b.klasse GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN rr c ON c.klasse = p.a JOIN rr d ON d.klasse = p.b WHERE 10 * p.n > 7 * (len(c.w) + len(d.w) - p.n)),
v AS (SELECT k, count(*) AS n FROM (SELECT a AS k FROM l UNION ALL SELECT b FROM l) GROUP BY k)"""
_ZONES = "CASE " + " ".join(f"WHEN z = '{name}' THEN {minutes}" for name, minutes in moments.ZONES.items()) + " END"
_MONTHS = "CASE mo " + " ".join(f"WHEN '{name}' THEN {n}" for n, name in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)) + " END"
_WEEKDAY = "^(?:(mon|tue|wed|thu|fri|sat|sun) ?, ?)?"
_MAIL = _WEEKDAY + r"(\d{1,2}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) (\d{2,4}) (\d{2}):(\d{2})(?::(\d{2}))? ([+-]\d{4}|[a-z]+)(?: ?\([^()]*\))?$"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})[t ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(z|[+-]\d{2}:\d{2})$"
_DATED = rf"""(WITH r AS (SELECT nr, lower(trim(regexp_replace(regexp_replace(datum, '[\x{{FEFF}}\x{{200B}}\x{{200E}}\x{{200F}}\x{{2060}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))) AS r FROM meldungen),
  m AS (SELECT nr, r, CASE WHEN regexp_matches(r, '{_MAIL}') THEN regexp_extract(r, '{_MAIL}', ['wd', 'd', 'mo', 'y', 'h', 'mi', 's', 'z']) END AS a, CASE WHEN regexp_matches(r, '{_ISO}') THEN regexp_extract(r, '{_ISO}', ['y', 'mo', 'd', 'h', 'mi', 's', 'z']) END AS b FROM r),
  p AS (SELECT nr, a.wd AS wd, CAST(coalesce(a.d, b.d) AS INT) AS d, CASE WHEN a IS NULL THEN CAST(b.mo AS INT) ELSE (SELECT {_MONTHS} FROM (SELECT a.mo AS mo)) END AS mo,
    CAST(coalesce(a.y, b.y) AS INT) + CASE WHEN a IS NULL OR length(a.y) = 4 THEN 0 WHEN length(a.y) = 2 AND CAST(a.y AS INT) < 50 THEN 2000 ELSE 1900 END AS y,
    CAST(coalesce(a.h, b.h) AS INT) AS h, CAST(coalesce(a.mi, b.mi) AS INT) AS mi, CAST(coalesce(nullif(a.s, ''), b.s, '0') AS INT) AS s, coalesce(a.z, b.z) AS z FROM m),
  t AS (SELECT nr, wd, s, h, mi, CASE WHEN d IS NOT NULL THEN TRY_CAST(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) END AS tag,
    CASE WHEN length(z) = 1 AND z <> 'j' THEN 0 WHEN regexp_matches(z, '^[+-]') THEN CAST(left(z, 1) || '1' AS INT) * nullif(CASE WHEN CAST(substr(z, 2, 2) AS INT) * 60 + CAST(right(z, 2) AS INT) > 1080 THEN -1 ELSE CAST(substr(z, 2, 2) AS INT) * 60 + CAST(right(z, 2) AS INT) END, -1) ELSE {_ZONES} END AS ost FROM p),
  u AS (SELECT nr, wd, s, ost, CASE WHEN h <= 23 AND mi <= 59 AND s <= 60 THEN CAST(tag AS TIMESTAMP) + to_seconds(h * 3600 + mi * 60 + s) END AS ts FROM t)
  SELECT nr, CASE WHEN coalesce(wd, '') = '' OR lower(strftime(ts, '%a')) = wd THEN strftime(ts - to_seconds(ost * 60), '%Y-%m-%dT%H:%M:%SZ') END AS datum FROM u)"""
_POINTS = "(" + " + ".join(f"CAST(contains(lower(s), {_q(w.lower())}) AS INT)" for w in WORDS) + ")"

SQL = {
    "relevance_score": f"WITH {_SCORED} SELECT nr, CAST(punkte AS INT) AS punkte FROM s",
    "relevance_reasons": f"""WITH {_SCORED}, b AS (SELECT nr, string_agg(t, '; ' ORDER BY a, k) AS begruendung FROM (SELECT nr, 0 AS a, k, 'Ausschluss: ' || wort AS t FROM e UNION ALL SELECT nr, 1, term, wort || ' (+' || p || ')' FROM h) GROUP BY nr),
        th AS (SELECT nr, string_agg(DISTINCT th, ',' ORDER BY th) AS themen FROM (SELECT nr, unnest(string_split(themen, ',')) AS th FROM h) WHERE th <> '' GROUP BY nr),
        rw AS (SELECT nr, string_agg(DISTINCT rw, ',' ORDER BY rw) AS regelwerke FROM (SELECT nr, unnest(string_split(werke, ',')) AS rw FROM h) WHERE rw <> '' GROUP BY nr)
        SELECT m.nr, coalesce(b.begruendung, '') AS begruendung, coalesce(th.themen, '') AS themen, coalesce(rw.regelwerke, '') AS regelwerke FROM m LEFT JOIN b USING (nr) LEFT JOIN th USING (nr) LEFT JOIN rw USING (nr)""",
    "relevance_threshold": f"WITH {_SCORED} SELECT s.nr, CAST(s.punkte AS INT) AS punkte FROM s JOIN meldungen USING (nr) LEFT JOIN feedquellen f ON f.id = meldungen.quelle WHERE s.punkte >= coalesce(f.mindestpunkte, 8)",
    "category_rules": f"SELECT nr, CASE {_CASES} ELSE '{S.OTHERWISE}' END AS kategorie FROM (SELECT nr, lower(coalesce(titel, '') || ' ' || coalesce(zusammenfassung, '')) AS v FROM meldungen)",
    "extractive_summary": f"""WITH c AS (SELECT nr, {clean_sql("zusammenfassung")} AS z FROM meldungen),
        a AS (SELECT nr, z, list_filter(list_transform(regexp_extract_all(z, '[^.!?]*[.!?]|[^.!?]+$'), lambda s: trim(s)), lambda s: strlen(s) > 25) AS ss FROM c),
        u AS (SELECT nr, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM a),
        k AS (SELECT nr, i, s FROM u QUALIFY row_number() OVER (PARTITION BY nr ORDER BY {_POINTS} DESC, i) <= 2),
        j AS (SELECT nr, string_agg(s, ' ' ORDER BY i) AS t FROM k GROUP BY nr)
        SELECT a.nr, CASE WHEN strlen(z) <= 150 THEN z WHEN j.t IS NULL AND z IS NOT NULL THEN left(z, 150) || '…' WHEN length(j.t) > 150 THEN left(j.t, 150) || '…' ELSE j.t END AS auszug FROM a LEFT JOIN j USING (nr)""",
    "title_similarity_links": f"WITH {_SETS} SELECT w.nr, r.klasse, coalesce(v.n, 0) AS verbindungen FROM w JOIN r ON r.w = w.w LEFT JOIN v ON v.k = r.klasse",
    # the loop itself: month by month, item by item, with the list of what was taken
    "greedy_dedup_month": r"""WITH RECURSIVE n0 AS (SELECT nr, strftime(eingang, '%Y-%m') AS monat, charge = 0 AS da, id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(titel, '')), '[^\p{L}\p{N}]+'), lambda x: strlen(x) > 3)) AS w FROM meldungen),
        n AS (SELECT *, row_number() OVER (PARTITION BY monat ORDER BY nr) AS i FROM n0 WHERE coalesce(da, false) OR NOT EXISTS (SELECT 1 FROM n0 k WHERE k.da AND k.monat IS NOT DISTINCT FROM n0.monat AND k.id = n0.id)),
        p AS (SELECT a.monat, b.nr, list(a.nr) AS rivalen FROM n a JOIN n b ON a.monat IS NOT DISTINCT FROM b.monat AND a.nr < b.nr AND len(a.w) >= 3 AND len(b.w) >= 3
          AND 10 * len(list_intersect(a.w, b.w)) > 7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) WHERE NOT coalesce(b.da, false) GROUP BY ALL),
        s AS (SELECT n.monat, n.i, n.nr, coalesce(p.rivalen, []) AS rivalen FROM n LEFT JOIN p ON p.nr = n.nr),
        l AS (SELECT monat, i, [nr] AS genommen, nr AS neu FROM s WHERE i = 1
          UNION ALL SELECT s.monat, s.i, CASE WHEN list_has_any(l.genommen, s.rivalen) THEN l.genommen ELSE list_append(l.genommen, s.nr) END, CASE WHEN list_has_any(l.genommen, s.rivalen) THEN NULL ELSE s.nr END
            FROM l JOIN s ON s.monat IS NOT DISTINCT FROM l.monat AND s.i = l.i + 1)
        SELECT monat, neu AS nr FROM l WHERE neu IS NOT NULL""",
    "feed_date_parse": f"SELECT * FROM {_DATED}",
    "feed_month_bucket": f"SELECT coalesce(left(datum, 7), strftime(now() AT TIME ZONE 'UTC', '%Y-%m')) AS monat, count(*) AS meldungen FROM {_DATED} GROUP BY ALL",
    "month_directory": "SELECT strftime(eingang, '%Y-%m') AS monat, count(*) AS meldungen FROM meldungen GROUP BY ALL",
    "newest_n": """SELECT nr, strftime(eingang, '%Y-%m') AS monat FROM meldungen WHERE strftime(eingang, '%Y-%m') IN (SELECT DISTINCT strftime(eingang, '%Y-%m') AS m FROM meldungen ORDER BY m DESC LIMIT 2) ORDER BY eingang DESC, nr DESC LIMIT 40""",
    "digest_7d": """WITH f AS (SELECT nr, eingang FROM meldungen ORDER BY eingang DESC, nr DESC LIMIT 40) SELECT nr FROM f WHERE eingang >= (SELECT max(eingang) FROM f) - INTERVAL 7 DAY ORDER BY eingang DESC, nr DESC LIMIT 10""",
    "news_filter": "SELECT nr, quelle FROM meldungen WHERE kategorie = 'Sanktion' AND charge > 0 AND contains(lower(concat_ws(' ', titel, zusammenfassung, quelle_name)), 'auslagerung')",
    "facet_values": " UNION ALL ".join(f"SELECT '{c}' AS merkmal, {c} AS wert, count(*) AS anzahl FROM meldungen WHERE trim({c}) <> '' GROUP BY {c}" for c in ("kategorie", "quelle_name", "herausgeber")),
    "feedback_terms": "SELECT split_part(b, ' (', 1) AS begriff, count(*) AS anzahl FROM (SELECT unnest(begruendung) AS b FROM meldungen WHERE charge = 0) GROUP BY ALL ORDER BY anzahl DESC, begriff LIMIT 12",
    "run_source_counters": """SELECT charge, quelle, count(*) AS gefunden, count(*) FILTER (punkte >= 20) AS uebernommen, count(*) FILTER (trim(coalesce(zusammenfassung, '')) = '') AS ohne_text,
        strftime(max(eingang), '%Y-%m-%d %H:%M:%S') AS zuletzt FROM meldungen GROUP BY ALL""",
    "source_state": r"""SELECT quelle, nr, left(sha256(lower(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END)), 16) AS kennung
        FROM (SELECT *, list_filter(string_split(CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_replace(split_part(url, '#', 1), '^[^?]*\?', '') ELSE '' END, '&'),
          lambda p: NOT regexp_full_match(lower(split_part(p, '=', 1)), 'utm_.*|nn|fbclid|gclid|')) AS kept FROM meldungen) QUALIFY row_number() OVER (PARTITION BY quelle ORDER BY eingang DESC, nr DESC) = 1""",
}
