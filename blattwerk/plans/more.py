"""Further queries: takeover decisions, page states, schedules, exports, listings, learning progress, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import versions as V
from ..session import table
from ..sources import files
from .searching import clean_sql
from .versioning import _LATEST, BEFORE, LAST, _nodes, _passages, _register, deliveries


def _delivered(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The current version of each work in a delivery: (regelwerk, id, hash, fundstellen)."""
    rows = table(spark, folder, "fassungen").where(F.col("lieferung") == n)
    rows = rows.select("regelwerk", F.regexp_replace("id", r"\s", "").alias("id"), F.regexp_replace(F.regexp_replace(F.lower("hash"), r"\s", ""), "^sha256:", "").alias("hash"), "fundstellen", "eingang", "zeile")
    last = F.max(F.struct("id", "eingang", "zeile", "hash", "fundstellen"))
    return rows.groupBy("regelwerk").agg(last.alias("v")).select("regelwerk", "v.id", "v.hash", "v.fundstellen")


def takeover_decision(spark, folder):
    """What to do with a fetched version: abort under 3 passages, touch if the hash is the same, else take over."""
    numbers = deliveries(spark, folder)
    new, old = _delivered(spark, folder, numbers[0]).alias("n"), _delivered(spark, folder, numbers[1] if len(numbers) > 1 else numbers[0] - 1).alias("o")
    kind = F.when(F.coalesce(F.col("n.fundstellen"), F.lit(0)) < 3, "abbruch").when(F.col("o.regelwerk").isNull(), "erstaufnahme").when(F.col("n.hash").eqNullSafe(F.col("o.hash")), "unveraendert").otherwise("neue fassung")
    return new.join(old, F.col("n.regelwerk") == F.col("o.regelwerk"), "left").select("n.regelwerk", kind.alias("entscheidung"))


def page_state(spark, folder):
    """Per watched address: seen first, unchanged or changed since the accepted history, by hash of its text."""
    rows = table(spark, folder, "meldungen").select(X.url_id(F.col("url")).alias("kennung"), F.sha2(F.coalesce("zusammenfassung", F.lit("")), 256).alias("h"), "charge", "nr")
    last = lambda w: rows.where(w).groupBy("kennung").agg(F.max_by("h", "nr").alias("h"))
    new, old = last("charge > 0").alias("n"), last("charge = 0").alias("o")
    state = F.when(F.col("o.h").isNull(), "neu").when(F.col("o.h") == F.col("n.h"), "unveraendert").otherwise("geaendert")
    return new.join(old, F.col("n.kennung") == F.col("o.kennung"), "left").groupBy(state.alias("zustand")).agg(F.count("*").alias("seiten"))


def schedule_window(spark, folder):
    """Arrivals within half an hour of 06:00 Berlin time; the window does not wrap at midnight."""
    berlin = F.from_utc_timestamp(F.col("eingang").cast("timestamp"), "Europe/Berlin")
    minutes = F.hour(berlin) * 60 + F.minute(berlin)
    return table(spark, folder, "meldungen").where(F.abs(minutes - 360) <= 30).select("nr", minutes.alias("minute"))


def german_format(spark, folder):
    return table(spark, folder, "lektionen").select("id", X.german_date(F.col("stand")).alias("stand"), F.translate(F.format_number(F.col("dauer") * 1000, 0), ",", ".").alias("zahl")).distinct()


def container_content(spark, folder):
    """Per node without text: the nearest nodes below that have text; nothing below those."""
    nodes = _nodes(spark, folder)
    keys = ["regelwerk", "fassung"]
    up = V.descendants(nodes, keys).where("tiefe > 0")
    texts = nodes.where("hat_text").select(*keys, "id")
    hits = up.join(texts, [*keys, "id"])
    between = hits.alias("a").join(hits.alias("b"), [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], F.col("a.id") == F.col("b.id"), F.col("b.tiefe") < F.col("a.tiefe")])
    hidden = between.join(texts.alias("t"), [*[F.col(f"b.{k}") == F.col(f"t.{k}") for k in keys], F.col("b.oben") == F.col("t.id")]).select(*[F.col(f"a.{k}") for k in keys], "a.oben", "a.id").distinct()
    empty = nodes.where("not coalesce(hat_text, false)").select(*keys, F.col("id").alias("oben"))
    return hits.join(empty, [*keys, "oben"], "left_semi").join(hidden, [*keys, "oben", "id"], "left_anti").select(*keys, "oben", "id")


def citation_export(spark, folder):
    """The whole text of a locus and of its children by id, with its origin, ready to be quoted.

    A locus without text of its own is quoted by its children's. Children lie one level below, in the same version.
    """
    key = ["regelwerk", "fassung", "id"]
    texts = _passages(spark, folder).where("fassung is not null and id is not null").select(*key, "text")
    under = table(spark, folder, "knoten").where("eltern <> id").select("regelwerk", "fassung", F.col("id").alias("kind"), "eltern").distinct()
    below = texts.withColumnRenamed("id", "kind").join(under, ["regelwerk", "fassung", "kind"]).select("regelwerk", "fassung", F.col("eltern").alias("id"), "kind", "text", F.lit(1).alias("stufe"))
    parts = texts.select(*key, F.col("id").alias("kind"), "text", F.lit(0).alias("stufe")).unionByName(below)
    whole = V.ordered_text(parts, key, ["stufe", "kind"], F.col("text"), "\n\n")
    origin = F.concat_ws(", ", "regelwerk", F.concat(F.lit("Fassung "), "fassung"))
    return whole.select(*key, F.concat("text", F.lit(" ("), origin, F.lit(")")).alias("zitat"))


def source_listing(spark, folder):
    counts = table(spark, folder, "meldungen").groupBy(F.col("quelle").alias("id")).agg(F.count("*").alias("meldungen"))
    return table(spark, folder, "feedquellen").select("id", "name", F.coalesce(F.nullif(F.trim("nutzung"), F.lit("")), F.lit("ungeklärt")).alias("nutzung")).join(counts, "id", "left").na.fill(0, ["meldungen"])


def new_act_suggestions(spark, folder):
    """Works that are cited but not registered, most cited first."""
    known = table(spark, folder, "fassungen").select("regelwerk").distinct()
    cited = table(spark, folder, "verweise").select("verweis_nr", F.col("nach.rw").alias("regelwerk")).distinct()
    return cited.join(known, "regelwerk", "left_anti").groupBy("regelwerk").agg(F.count("*").alias("verweise"), F.lit(60).alias("punkte"))


def run_log(spark, folder):
    """The last 60 runs by start: batches and sources."""
    runs = table(spark, folder, "meldungen").groupBy("charge", "quelle").agg(F.min("eingang").alias("start"), F.count("*").alias("geprueft"))
    return runs.orderBy(F.desc("start"), "charge", "quelle").limit(60).select("charge", "quelle", "geprueft")


def learning_progress(spark, folder):
    """Per topic: lessons, those with places to look up, and total duration."""
    lessons = table(spark, folder, "lektionen").dropDuplicates(["id"])
    places = F.aggregate(F.transform(F.coalesce("abschnitte", F.array()), lambda a: F.greatest(F.size(F.coalesce(a["fundstellen"], F.array())), F.lit(0))), F.lit(0), lambda x, y: x + y)
    rows = lessons.select(F.explode("themen").alias("thema"), "dauer", places.alias("n"))
    return rows.groupBy("thema").agg(F.count("*").alias("lektionen"), F.count_if(F.col("n") > 0).alias("belegt"), F.sum("dauer").alias("dauer"))


def certificates(spark, folder):
    """Users who passed: the best of their last 20 tries at 70 % or more, with the day of the last try."""
    tries = table(spark, folder, "events").where("event_type = 'view'")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = tries.withColumn("_k", F.row_number().over(w)).where("_k <= 20")
    return last.groupBy("user_id").agg(F.max("value").alias("_b"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("tag")).where("_b >= 70").select("user_id", "tag")


def case_walk(spark, folder):
    """Walks through a decision tree: from each top node always the first child by id, with the number of steps taken."""
    nodes = _nodes(spark, folder)
    first = nodes.where("eltern is not null").groupBy("regelwerk", "fassung", F.col("eltern").alias("von")).agg(F.min("id").alias("nach"))
    walks = V.descendants(first.select("regelwerk", "fassung", F.col("nach").alias("id"), F.col("von").alias("eltern")).unionByName(nodes.where("eltern is null").select("regelwerk", "fassung", "id", "eltern")), ["regelwerk", "fassung"])
    tops = nodes.where("eltern is null").select("regelwerk", "fassung", F.col("id").alias("oben"))
    return walks.join(tops, ["regelwerk", "fassung", "oben"], "left_semi").groupBy("regelwerk", "fassung", F.col("oben").alias("start")).agg(F.max("tiefe").alias("schritte"), F.max_by("id", "tiefe").alias("ende"))


def feed_scan(spark, folder):
    """News as feed documents and read again: title, address, date and text survive escaping."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), esc(F.col(c)), F.lit(f"</{name}>"))
    xml = F.concat(F.lit("<rss><channel><item>"), tag("title", "titel"), tag("link", "url"), tag("pubDate", "datum"), tag("description", "zusammenfassung"), F.lit("</item></channel></rss>"))
    docs = table(spark, folder, "meldungen").select(F.col("nr").cast("string").alias("quelle"), xml.alias("inhalt"))
    return files.feed_entries(docs).select(F.col("quelle").cast("bigint").alias("nr"), "titel", "url", "datum", "text")


def passages_per_version(spark, folder):
    """Registered versions with the passages stored of each; missing ones count 0."""
    have = _passages(spark, folder).groupBy("regelwerk", F.col("fassung").alias("id")).agg(F.count("*").alias("stellen"))
    return _register(spark, folder).select("regelwerk", "id").join(have, ["regelwerk", "id"], "left").na.fill(0, ["stellen"])


QUERIES = {f.__name__: f for f in (
    takeover_decision, page_state, schedule_window, german_format, container_content, citation_export, source_listing, new_act_suggestions, run_log,
    learning_progress, certificates, case_walk, feed_scan, passages_per_version,
)}

# --- SQL --------------------------------------------------------------------------------------------------

_ID = r"regexp_replace(id, '\s', '', 'g')"
_ITEM = r"regexp_replace(CASE WHEN trim(coalesce(m, '')) = '' THEN t ELSE regexp_replace(m, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') || ' ' || t END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_N = f"n AS (SELECT regelwerk, fassung, id, eltern, coalesce(text, false) AS hat FROM ({_LATEST}))"


def _at(n: str) -> str:
    return f"(SELECT regelwerk, {_ID} AS id, regexp_replace(regexp_replace(lower(hash), '\\s', '', 'g'), '^sha256:', '') AS h, fundstellen FROM fassungen WHERE lieferung = {n} QUALIFY row_number() OVER (PARTITION BY regelwerk ORDER BY {_ID} DESC, eingang DESC, zeile DESC) = 1)"


_KEY = r"""left(sha256(lower(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') || CASE WHEN len(list_filter(string_split(CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_replace(split_part(url, '#', 1), '^[^?]*\?', '') ELSE '' END, '&'),
  lambda p: NOT regexp_full_match(lower(split_part(p, '=', 1)), 'utm_.*|nn|fbclid|gclid|'))) > 0 THEN '?' || array_to_string(list_filter(string_split(regexp_replace(split_part(url, '#', 1), '^[^?]*\?', ''), '&'), lambda p: NOT regexp_full_match(lower(split_part(p, '=', 1)), 'utm_.*|nn|fbclid|gclid|')), '&') ELSE '' END)), 16)"""

SQL = {
    "takeover_decision": f"""SELECT n.regelwerk, CASE WHEN coalesce(n.fundstellen, 0) < 3 THEN 'abbruch' WHEN o.regelwerk IS NULL THEN 'erstaufnahme' WHEN n.h IS NOT DISTINCT FROM o.h THEN 'unveraendert' ELSE 'neue fassung' END AS entscheidung
        FROM {_at(LAST)} n LEFT JOIN {_at(BEFORE)} o ON n.regelwerk = o.regelwerk""",
    "page_state": f"""WITH r AS (SELECT {_KEY} AS k, coalesce(zusammenfassung, '') AS h, charge, nr FROM meldungen), n AS (SELECT k, arg_max(h, nr) AS h FROM r WHERE charge > 0 GROUP BY k), o AS (SELECT k, arg_max(h, nr) AS h FROM r WHERE charge = 0 GROUP BY k)
        SELECT CASE WHEN o.h IS NULL THEN 'neu' WHEN o.h = n.h THEN 'unveraendert' ELSE 'geaendert' END AS zustand, count(*) AS seiten FROM n LEFT JOIN o USING (k) GROUP BY ALL""",
    "schedule_window": """SELECT nr, CAST(hour(b) * 60 + minute(b) AS INT) AS minute FROM (SELECT nr, (eingang AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS b FROM meldungen) WHERE abs(hour(b) * 60 + minute(b) - 360) <= 30""",
    "german_format": "SELECT DISTINCT id, strftime(stand, '%d.%m.%Y') AS stand, replace(format('{:,}', dauer * 1000), ',', '.') AS zahl FROM lektionen",
    "container_content": f"""WITH RECURSIVE {_N}, d AS (SELECT regelwerk, fassung, id AS oben, id AS auf, hat AS fertig FROM n WHERE NOT hat
        UNION ALL SELECT d.regelwerk, d.fassung, d.oben, n.id, n.hat FROM d JOIN n ON n.regelwerk = d.regelwerk AND n.fassung = d.fassung AND n.eltern = d.auf WHERE NOT d.fertig)
        SELECT regelwerk, fassung, oben, auf AS id FROM d WHERE fertig""",
    "citation_export": f"""WITH p AS (SELECT regelwerk, fassung, knoten_id AS id, string_agg({_ITEM}, chr(10) ORDER BY ord, punkt_nr) AS t FROM punkte WHERE t IS NOT NULL AND fassung IS NOT NULL AND knoten_id IS NOT NULL GROUP BY ALL),
        k AS (SELECT DISTINCT regelwerk, fassung, id, eltern FROM knoten WHERE eltern <> id),
        a AS (SELECT regelwerk, fassung, id, 0 AS n, id AS kind, t FROM p UNION ALL SELECT regelwerk, fassung, k.eltern, 1, id, t FROM p JOIN k USING (regelwerk, fassung, id))
        SELECT regelwerk, fassung, id, string_agg(t, chr(10) || chr(10) ORDER BY n, kind) || ' (' || concat_ws(', ', regelwerk, 'Fassung ' || fassung) || ')' AS zitat FROM a GROUP BY regelwerk, fassung, id""",
    "source_listing": "SELECT f.id, f.name, coalesce(nullif(trim(nutzung), ''), 'ungeklärt') AS nutzung, coalesce(m.n, 0) AS meldungen FROM feedquellen f LEFT JOIN (SELECT quelle, count(*) AS n FROM meldungen GROUP BY quelle) m ON m.quelle = f.id",
    "new_act_suggestions": "SELECT rw AS regelwerk, count(*) AS verweise, 60 AS punkte FROM (SELECT DISTINCT verweis_nr, nach.rw AS rw FROM verweise) WHERE rw IS NULL OR rw NOT IN (SELECT regelwerk FROM fassungen WHERE regelwerk IS NOT NULL) GROUP BY rw",
    "run_log": "SELECT charge, quelle, geprueft FROM (SELECT charge, quelle, min(eingang) AS start, count(*) AS geprueft FROM meldungen GROUP BY ALL) ORDER BY start DESC, charge, quelle LIMIT 60",
    "learning_progress": """WITH l AS (SELECT id, any_value(themen) AS themen, any_value(dauer) AS dauer, any_value(abschnitte) AS abschnitte FROM lektionen GROUP BY id),
        r AS (SELECT unnest(themen) AS thema, dauer, coalesce(list_sum(list_transform(abschnitte, lambda a: coalesce(len(a.fundstellen), 0))), 0) AS n FROM l)
        SELECT thema, count(*) AS lektionen, count(*) FILTER (n > 0) AS belegt, CAST(sum(dauer) AS BIGINT) AS dauer FROM r GROUP BY thema""",
    "certificates": """WITH t AS (SELECT * FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20)
        SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS tag FROM t GROUP BY user_id HAVING max(value) >= 70""",
    "case_walk": f"""WITH RECURSIVE {_N}, f AS (SELECT regelwerk, fassung, eltern AS von, min(id) AS nach FROM n WHERE eltern IS NOT NULL GROUP BY ALL),
        w AS (SELECT regelwerk, fassung, id AS start, id AS ende, 0 AS schritte FROM n WHERE eltern IS NULL
          UNION ALL SELECT w.regelwerk, w.fassung, w.start, f.nach, w.schritte + 1 FROM w JOIN f ON f.regelwerk = w.regelwerk AND f.fassung = w.fassung AND f.von = w.ende)
        SELECT regelwerk, fassung, start, max(schritte) AS schritte, arg_max(ende, schritte) AS ende FROM w WHERE fassung IS NOT NULL GROUP BY ALL""",
    "feed_scan": rf"""SELECT nr, {clean_sql("titel")} AS titel, regexp_replace(url, '^\s+|\s+$', '', 'g') AS url, nullif(regexp_replace(datum, '^\s+|\s+$', '', 'g'), '') AS datum, coalesce({clean_sql("zusammenfassung")}, '') AS text
        FROM meldungen WHERE regexp_matches(titel, '\S') AND regexp_matches(lower(regexp_replace(url, '^\s+|\s+$', '', 'g')), '^https?://') AND strlen(regexp_replace(url, '^\s+|\s+$', '', 'g')) > 10""",
    "passages_per_version": f"""WITH r AS (SELECT DISTINCT regelwerk, {_ID} AS id FROM fassungen WHERE lieferung = (SELECT max(lieferung) FROM fassungen)), p AS (SELECT regelwerk, fassung AS id, count(DISTINCT coalesce(knoten_id, '')) AS n FROM punkte WHERE t IS NOT NULL GROUP BY ALL)
        SELECT r.regelwerk, r.id, coalesce(p.n, 0) AS stellen FROM r LEFT JOIN p USING (regelwerk, id)""",
}
