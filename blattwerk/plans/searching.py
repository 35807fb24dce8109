"""Queries of text functions and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..session import new_place, spread, table

SEARCH = "Meldung von Störungen und Prüfung der Auslagerung an Dienstleister"
TERMS_SQL = "('meld','storung','pruf','auslag','dienstleist')"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"))


def _stemmed(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    return S.stems(_docs(spark, folder), keys, (F.col("text"), 1))


def stem_vocabulary(spark, folder):
    words = _docs(spark, folder).select(F.explode(X.words(F.col("text"))).alias("wort")).groupBy("wort").agg(F.count("*").alias("anzahl"))
    return words.select("wort", X.stem(F.col("wort")).alias("stem"), "anzahl").where("stem is not null")


def term_postings(spark, folder):
    return S.postings(_stemmed(spark, folder, ["source", "doc_id"]), ["source", "doc_id"])


def label_postings(spark, folder):
    docs = table(spark, folder, "indexdokumente").select("regelwerk", "sprache", "dok_nr", "b", "t")
    keys = ["regelwerk", "sprache", "dok_nr"]
    return S.postings(S.stems(docs, keys, (F.col("b"), 2), (F.col("t"), 1)), keys)


def doc_lengths(spark, folder):
    return S.lengths(_stemmed(spark, folder, ["source", "doc_id"]), ["source", "doc_id"])


def index_stats(spark, folder):
    return S.index_stats(doc_lengths(spark, folder), ["source"])


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("punkte", F.round("punkte", 6))


_INDEXES: dict[tuple[str, str, str], S.StoredIndex] = {}


def _stored(spark: SparkSession, folder: str, name: str) -> S.StoredIndex:
    """The stored indexes of a table, built once per application and folder."""
    at = (spark.sparkContext.applicationId, folder, name)
    if at not in _INDEXES:
        if name == "documents":
            index, key, docs, texts = ["source"], "doc_id", _docs(spark, folder), ((F.col("text"), 1),)
        else:
            index, key, docs, texts = ["regelwerk", "sprache"], "dok_nr", table(spark, folder, name).select("regelwerk", "sprache", "dok_nr", "b", "t"), ((F.col("b"), 2), (F.col("t"), 1))
        stored = S.StoredIndex(spark, new_place(spark, "index"), index, key, dict(docs.dtypes))
        _INDEXES[at] = stored.build(S.stems(docs, [*index, key], *texts))
    return _INDEXES[at]


def bm25_topk(spark, folder):
    return _ranked(S.rank(_stored(spark, folder, "documents"), S.query_stems(spark, SEARCH)))


def bm25_per_source(spark, folder):
    return _ranked(S.rank(_stored(spark, folder, "documents"), S.query_stems(spark, SEARCH), only=F.col("source") == "faq-nordmark"))


def bm25_excluding_irrelevant(spark, folder):
    hidden = F.coalesce(F.col("source").startswith("lektionen"), F.lit(False))
    return _ranked(S.rank(_stored(spark, folder, "documents"), S.query_stems(spark, SEARCH), hidden=hidden))


def bm25_labels(spark, folder):
    return _ranked(S.rank(_stored(spark, folder, "indexdokumente"), S.query_stems(spark, "Artikel 12 Notfallplanung Schulungen")))


def index_directory(spark, folder):
    """The directory of the stored indexes: per work and language documents, mean length and entries."""
    return _stored(spark, folder, "indexdokumente").directory()


def query_highlight(spark, folder):
    terms = S.query_stems(spark, "Prüfung Auslagerung Frist")
    return table(spark, folder, "indexdokumente").select("dok_nr", S.highlight(F.col("t"), terms).alias("hervorgehoben"))


def language_fallback(spark, folder):
    return S.choose_language(table(spark, folder, "indexdokumente").select("regelwerk", "sprache").distinct(), "regelwerk", "sprache", "en")


def teaser(spark, folder):
    return _docs(spark, folder).select("doc_id", X.teaser(F.col("text")).alias("teaser"))


def shorten_word_boundary(spark, folder):
    return _docs(spark, folder).select("doc_id", X.shorten_at_word(F.col("text"), 90).alias("kurz"))


def html_clean(spark, folder):
    return table(spark, folder, "meldungen").select("nr", X.clean_html(F.col("titel")).alias("titel"), X.clean_html(F.col("zusammenfassung")).alias("zusammenfassung"))


def url_canonical(spark, folder):
    return table(spark, folder, "meldungen").select("nr", X.canonical_url(F.col("url")).alias("url"))


def url_id(spark, folder):
    return table(spark, folder, "meldungen").select("nr", X.url_id(F.col("url")).alias("kennung"), X.is_web_address(F.col("url")).alias("webadresse"))


HOSTS = ["nordmark-ticker.test", "rondo-news-01.example", "ulmer-blog-18.test", "pexa-feed-14.example"]


def url_allowlist(spark, folder):
    return table(spark, folder, "meldungen").select("nr", X.url_allowed(F.col("url"), HOSTS).alias("erlaubt"), X.host_of(F.col("url")).alias("rechner"))


def key_slug(spark, folder):
    return table(spark, folder, "feedquellen").select("id", X.slug(F.col("name")).alias("schluessel"), X.percent_encode(F.col("name")).alias("kodiert"))


def heading_numbers(spark, folder):
    docs = _docs(spark, folder)
    return docs.select("doc_id", X.paragraph_mark(F.col("text")).alias("absatz"), X.dotted_number(F.col("text")).alias("gliederung"))


def act_number_map(spark, folder):
    rows = table(spark, folder, "fassungen").select("regelwerk", F.regexp_replace(F.col("quelle.celex"), "^9(\\d{4})X", "3$1R").alias("celex"))
    return rows.select("regelwerk", X.act_number(F.col("celex")).alias("nummer")).where("nummer is not null").distinct()


QUERIES = {f.__name__: f for f in (
    bm25_topk, stem_vocabulary, term_postings, label_postings, doc_lengths, index_stats, bm25_per_source, bm25_excluding_irrelevant,
    bm25_labels, index_directory, query_highlight, language_fallback, teaser, shorten_word_boundary, html_clean, url_canonical, url_id, url_allowlist,
    key_slug, heading_numbers, act_number_map,
)}

# --- SQL --------------------------------------------------------------------------------------------------

_STOP = "(" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + ")"


def fold_sql(c: str) -> str:
    return f"replace(translate(lower({c}), '{X.FOLDED[0]}', '{X.FOLDED[1]}'), 'ß', 'ss')"


def stem_sql(words: str, column: str = "wort") -> str:
    """CTE text: from a relation with ``column`` of words to the same rows with ``stem``; stopped words are dropped."""
    end = "^(.{4,}?)(" + "|".join(X.ENDINGS) + ")$"
    return f"""(SELECT * EXCLUDE (_f, _a, _b), CASE WHEN regexp_full_match(_f, '[0-9]+') THEN _f WHEN regexp_matches(_f, '^.{{3,}}ies$') THEN left(_f, length(_f) - 3) || 'y'
        WHEN length(_b) > 4 AND right(_b, 1) = substr(_b, length(_b) - 1, 1) AND right(_b, 1) IN ('n','m','t','l','r','s','f','p') THEN left(_b, length(_b) - 1) ELSE _b END AS stem
      FROM (SELECT *, regexp_replace(regexp_replace(_a, '{end}', '\\1'), '{end}', '\\1') AS _b
        FROM (SELECT *, CASE WHEN regexp_matches(_f, '^.{{3,}}ungen$') THEN left(_f, length(_f) - 5) WHEN regexp_matches(_f, '^.{{3,}}ung$') THEN left(_f, length(_f) - 3) ELSE _f END AS _a
          FROM (SELECT *, {fold_sql(column)} AS _f FROM {words}) WHERE length(_f) >= 2 AND _f NOT IN {_STOP}))
      ) WHERE length(stem) >= 2 AND stem NOT IN {_STOP}"""


_WORDS = r"(SELECT source, doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS wort FROM documents)"
_TOKENS = f"tok AS (SELECT source, doc_id, stem FROM {stem_sql(_WORDS)})"
_LABEL_WORDS = r"""(SELECT regelwerk, sprache, dok_nr, unnest(list_concat(list_concat(regexp_split_to_array(coalesce(b, ''), '[^\p{L}\p{N}]+'), regexp_split_to_array(coalesce(b, ''), '[^\p{L}\p{N}]+')), regexp_split_to_array(coalesce(t, ''), '[^\p{L}\p{N}]+'))) AS wort FROM indexdokumente)"""
_LABEL_TOKENS = f"tok AS (SELECT regelwerk, sprache, dok_nr, stem FROM {stem_sql(_LABEL_WORDS)})"


def bm25_sql(tokens: str, index: list[str], key: str, query: str, where: str = "true", hidden: str = "false") -> str:
    keys, idx = ", ".join([*index, key]), ", ".join(index)
    same = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in index)
    split = r"regexp_split_to_array('" + query + r"', '[^\p{L}\p{N}]+')"
    return f"""
    WITH {tokens}, t AS (SELECT * FROM tok WHERE {where}),
    q AS (SELECT DISTINCT stem FROM {stem_sql(f"(SELECT unnest({split}) AS wort)")}),
    l AS (SELECT {keys}, count(*) AS len FROM t GROUP BY ALL),
    m AS (SELECT {idx}, round(avg(len), 2) AS avgdl FROM l GROUP BY ALL),
    p AS (SELECT {keys}, stem, count(*) AS tf FROM t WHERE stem IN (SELECT stem FROM q) GROUP BY ALL),
    d AS (SELECT stem, count(*) AS df FROM p GROUP BY stem),
    s AS (SELECT {", ".join("p." + c for c in [*index, key])}, count(*) AS treffer,
        sum(ln(1 + ((SELECT count(*) FROM l) - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / m.avgdl))) AS r
      FROM p JOIN d ON d.stem = p.stem JOIN l ON {same.replace("x.", "p.").replace("y.", "l.")} AND l.{key} = p.{key} JOIN m ON {same.replace("x.", "p.").replace("y.", "m.")} GROUP BY ALL)
    SELECT {keys}, CAST(treffer AS INT) AS treffer, round(r * (0.45 + 0.55 * treffer / (SELECT count(*) FROM q)) * CASE WHEN treffer = (SELECT count(*) FROM q) THEN 1.25 ELSE 1.0 END, 6) AS punkte
    FROM s WHERE NOT ({hidden}) ORDER BY r * (0.45 + 0.55 * treffer / (SELECT count(*) FROM q)) * CASE WHEN treffer = (SELECT count(*) FROM q) THEN 1.25 ELSE 1.0 END DESC, {keys} LIMIT 80"""


def clean_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, char in X.ENTITIES.items():
        out = f"replace({out}, '&{name};', '{char}')"
    for i, name in enumerate(X.XML_ENTITIES):  # RE2 has no look-ahead: set the five aside while unknown names are dropped
        out = f"replace({out}, '&{name};', chr({57344 + i}))"
    out = f"regexp_replace({out}, '&[a-zA-Z][a-zA-Z0-9]{{1,10}};', ' ', 'g')"
    for i, name in enumerate(X.XML_ENTITIES):
        out = f"replace({out}, chr({57344 + i}), '&{name};')"
    for name, char in X.XML_ENTITIES.items():
        out = f"replace({out}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({out}, '[\p{{Z}}\s\x0B\x{{85}}]+', ' ', 'g'))"


_CANON = r"""regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""
_URLS = r"""(SELECT nr, url, list_filter(string_split(CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_replace(split_part(url, '#', 1), '^[^?]*\?', '') ELSE '' END, '&'),
    lambda p: NOT regexp_full_match(lower(split_part(p, '=', 1)), 'utm_.*|nn|fbclid|gclid|')) AS kept FROM meldungen)"""
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 2))"

SQL = {
    "stem_vocabulary": f"WITH {_TOKENS}, w AS (SELECT wort, count(*) AS anzahl FROM {_WORDS} GROUP BY wort) SELECT wort, stem, anzahl FROM {stem_sql('w')}",
    "term_postings": f"WITH {_TOKENS} SELECT source, doc_id, stem, count(*) AS tf FROM tok GROUP BY ALL",
    "label_postings": f"WITH {_LABEL_TOKENS} SELECT regelwerk, sprache, dok_nr, stem, count(*) AS tf FROM tok GROUP BY ALL",
    "doc_lengths": f"WITH {_TOKENS} SELECT source, doc_id, count(*) AS laenge FROM tok GROUP BY ALL",
    "index_stats": f"WITH {_TOKENS}, l AS (SELECT source, doc_id, count(*) AS n FROM tok GROUP BY ALL) SELECT source, count(*) AS dokumente, round(avg(n), 2) AS avgdl FROM l GROUP BY source",
    "bm25_topk": bm25_sql(_TOKENS, ["source"], "doc_id", SEARCH),
    "bm25_per_source": bm25_sql(_TOKENS, ["source"], "doc_id", SEARCH, "source = 'faq-nordmark'"),
    "bm25_excluding_irrelevant": bm25_sql(_TOKENS, ["source"], "doc_id", SEARCH, hidden="coalesce(starts_with(source, 'lektionen'), false)"),
    "bm25_labels": bm25_sql(_LABEL_TOKENS, ["regelwerk", "sprache"], "dok_nr", "Artikel 12 Notfallplanung Schulungen"),
    "index_directory": f"""WITH {_LABEL_TOKENS}, p AS (SELECT regelwerk, sprache, dok_nr, stem, count(*) AS tf FROM tok GROUP BY ALL), l AS (SELECT regelwerk, sprache, dok_nr, sum(tf) AS n, count(*) AS e FROM p GROUP BY ALL)
        SELECT regelwerk, sprache, count(*) AS dokumente, round(avg(n), 2) AS avgdl, CAST(sum(e) AS BIGINT) AS eintraege FROM l GROUP BY ALL""",
    "query_highlight": rf"""WITH d AS (SELECT dok_nr, t, CASE WHEN t IS NULL THEN NULL ELSE regexp_extract_all(t, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') END AS ws FROM indexdokumente),
        x AS (SELECT dok_nr, unnest(ws) AS wort, unnest(range(len(ws))) AS i FROM d), v AS (SELECT DISTINCT wort FROM x), k AS (SELECT wort FROM {stem_sql("v")} AND stem IN ('pruf', 'auslag', 'frist')),
        y AS (SELECT dok_nr, string_agg(CASE WHEN k.wort IS NULL THEN x.wort ELSE '[' || x.wort || ']' END, '' ORDER BY i) AS h FROM x LEFT JOIN k ON k.wort = x.wort GROUP BY dok_nr)
        SELECT d.dok_nr, CASE WHEN d.t IS NULL THEN NULL ELSE coalesce(y.h, '') END AS hervorgehoben FROM d LEFT JOIN y USING (dok_nr)""",
    "language_fallback": "SELECT regelwerk, CASE WHEN bool_or(sprache = 'en') THEN 'en' ELSE min(sprache) END AS sprache FROM indexdokumente WHERE sprache IS NOT NULL GROUP BY regelwerk",
    "teaser": "SELECT doc_id, CASE WHEN length(text) > 220 THEN left(text, 220) || '…' ELSE text END AS teaser FROM documents",
    "shorten_word_boundary": """SELECT doc_id, CASE WHEN length(text) > 90 THEN coalesce(nullif(regexp_extract(text, '(?s)^(.{1,90}) ', 1), ''), left(text, 90)) || '…' ELSE text END AS kurz FROM documents""",
    "html_clean": f"SELECT nr, {clean_sql('titel')} AS titel, {clean_sql('zusammenfassung')} AS zusammenfassung FROM meldungen",
    "url_canonical": f"SELECT nr, {_CANON} AS url FROM {_URLS}",
    "url_id": f"SELECT nr, left(sha256(lower({_CANON})), 16) AS kennung, coalesce(regexp_matches(lower(trim(url)), '^https?://') AND strlen(trim(url)) > 10, false) AS webadresse FROM {_URLS}",
    "url_allowlist": f"""SELECT nr, coalesce(regexp_matches(url, '^(?i:https)://') AND NOT contains(split_part(split_part(url, '://', 2), '/', 1), '@')
        AND NOT regexp_matches({_HOST}, '^(\\d{{1,3}}(\\.\\d{{1,3}}){{3}}|\\[.*)$') AND regexp_extract(split_part(split_part(url, '://', 2), '/', 1), ':(\\d+)$', 1) IN ('', '443')
        AND ({" OR ".join(f"{_HOST} = '{h}' OR ends_with({_HOST}, '.{h}')" for h in HOSTS)}), false) AS erlaubt, nullif({_HOST}, '') AS rechner FROM meldungen""",
    "key_slug": "SELECT id, lower(regexp_replace(name, '[^A-Za-z0-9]', '_', 'g')) AS schluessel, url_encode(name) AS kodiert FROM feedquellen",
    "heading_numbers": r"""SELECT doc_id, regexp_extract(text, '^\s*\((\d{1,3}[a-z]?)\)', 1) AS absatz, regexp_extract(text, '^(\d{1,3}(?:\.\d{1,3})*)\.?\s+\S', 1) AS gliederung FROM documents""",
    "act_number_map": r"""SELECT DISTINCT regelwerk, substr(c, 2, 4) || '/' || CAST(CAST(substr(c, 7, 4) AS INT) AS VARCHAR) AS nummer
        FROM (SELECT regelwerk, regexp_replace(quelle.celex, '^9(\d{4})X', '3\1R') AS c FROM fassungen) WHERE regexp_matches(c, '^3\d{4}[RLD]\d{4}$')""",
}
