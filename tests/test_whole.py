"""Queries that must do the whole job, against literal cases and independent SQL or brute force."""

import datetime as dt
import os
import re
from email.utils import parsedate_to_datetime

import duckdb
import pytest

import __spark_entry__ as entry
from blattwerk.sources.parsers import clean_text
from verify import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def lay(spark, folder, **tables):
    """Write small tables, each (rows, schema), and return their folder."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, name, folder):
    return {tuple(r) for r in entry.queries()[name](spark, folder).collect()}


def agrees(spark, name, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, FOLDER), con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(repr(plain(list(r))) for r in df.select(*rel.columns).collect())
    return got == sorted(repr(plain(list(r))) for r in rel.fetchall()) and got


# --- citation_export --------------------------------------------------------------------------------------

ITEMS = "punkt_nr long, regelwerk string, fassung string, knoten_id string, ord int, m string, t string"
NODES = "regelwerk string, fassung string, id string, eltern string"


def test_citation_export_is_whole(spark, tmp_path):
    long = "Wort " * 40 + "Ende"
    items = [(1, "w", "f", "a", 1, "(1)", long), (2, "w", "f", "a", 2, "(2)", "zwei"), (3, "w", "f", "a2", 1, None, "Kind 2"), (4, "w", "f", "a1", 1, None, "Kind 1"), (5, "w", "f", "b1", 1, None, "nur Kind"), (6, "w", "g", "a1", 1, None, "andere Fassung")]
    nodes = [("w", "f", "a", None), ("w", "f", "a1", "a"), ("w", "f", "a1", "a"), ("w", "f", "a2", "a"), ("w", "f", "b1", "b")]
    got = {(f, i): z for _, f, i, z in run(spark, "citation_export", lay(spark, tmp_path, punkte=(items, ITEMS), knoten=(nodes, NODES)))}
    assert got["f", "a"] == f"(1) {long}\n(2) zwei\n\nKind 1\n\nKind 2 (w, Fassung f)"
    assert got["f", "b"] == "nur Kind (w, Fassung f)" and got["g", "a1"] == "andere Fassung (w, Fassung g)" and len(got) == 6


@given_tables
def test_citation_export_against_sql(spark):
    item = r"regexp_replace(CASE WHEN trim(coalesce(m, '')) = '' THEN t ELSE regexp_replace(m, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') || ' ' || t END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
    assert agrees(spark, "citation_export", f"""WITH p AS (SELECT regelwerk, fassung, knoten_id AS id, string_agg({item}, chr(10) ORDER BY ord, punkt_nr) AS t FROM punkte WHERE t IS NOT NULL AND fassung IS NOT NULL AND knoten_id IS NOT NULL GROUP BY ALL),
        k AS (SELECT DISTINCT regelwerk, fassung, id, eltern FROM knoten WHERE eltern <> id),
        a AS (SELECT regelwerk, fassung, id, 0 AS n, id AS kind, t FROM p UNION ALL SELECT regelwerk, fassung, k.eltern, 1, id, t FROM p JOIN k USING (regelwerk, fassung, id))
        SELECT regelwerk, fassung, id, string_agg(t, chr(10) || chr(10) ORDER BY n, kind) || ' (' || concat_ws(', ', regelwerk, 'Fassung ' || fassung) || ')' AS zitat FROM a GROUP BY regelwerk, fassung, id""")


# --- footnote_match ---------------------------------------------------------------------------------------

LESSONS = "id string, themen array<string>, abschnitte array<struct<fundstellen array<struct<rw string, pfad string>>>>"


def test_footnote_match_by_work_or_topic(spark, tmp_path):
    place = lambda *works: [([(w, None) for w in works],)]
    lessons = [("l1", ["a"], place("w")), ("l1", ["a"], place("w")), ("l2", ["b", "a"], None), ("l3", None, place("w", "v")), ("l4", [None, "c"], [(None,)])]
    news = [(1, ["a"], ["w"]), (2, ["b"], []), (3, [], ["v"]), (4, None, None), (5, [None, "d"], ["x"]), (6, ["a", "b"], None), (7, ["c", None], ["v"])]
    folder = lay(spark, tmp_path, lektionen=(lessons, LESSONS), meldungen=(news, "nr long, themen array<string>, regelwerke array<string>"))
    assert run(spark, "footnote_match", folder) == {(1, 3), (2, 1), (3, 1), (6, 2), (7, 2)}


@given_tables
def test_footnote_match_against_sql(spark):
    assert agrees(spark, "footnote_match", """WITH w AS (SELECT DISTINCT id, f.rw AS k FROM (SELECT id, unnest(a.fundstellen) AS f FROM (SELECT id, unnest(abschnitte) AS a FROM lektionen))), n AS (SELECT nr, unnest(regelwerke) AS k FROM meldungen),
        l AS (SELECT DISTINCT id, unnest(themen) AS thema FROM lektionen), m AS (SELECT nr, unnest(themen) AS thema FROM meldungen)
        SELECT nr, count(DISTINCT id) AS lektionen FROM (SELECT nr, id FROM n JOIN w USING (k) UNION ALL SELECT nr, id FROM m JOIN l USING (thema)) GROUP BY nr""")


# --- feed_date_parse, feed_month_bucket -------------------------------------------------------------------

DATES = {
    "Tue, 15 Oct 2024 11:53:52 GMT": "2024-10-15T11:53:52Z", " 1 Nov 2024 00:30 +0200\n": "2024-10-31T22:30:00Z", "Fri, 21 Nov 2025 23:58:07 EST": "2025-11-22T04:58:07Z",
    "15 Oct 24 11:53:52 UT": "2024-10-15T11:53:52Z", "2024-10-15t11:53:52.9-05:00": "2024-10-15T16:53:52Z", "2024-10-15T11:53:52Z": "2024-10-15T11:53:52Z", "29 Nov 2025 10:32:05 CET": "2025-11-29T09:32:05Z",
    "Wed, 15 Oct 2024 11:53:52 GMT": None, "31 Feb 2024 11:53:52 GMT": None, "2024-10-15T25:00:00Z": None, "2024-10-15 11:53:52": None, "15.10.2024": None, "1733217489": None, "bald": None, "": None,
}


def test_feed_dates_of_both_forms(spark, tmp_path):
    rows = [*enumerate(DATES, 1), (99, None)]
    folder = lay(spark, tmp_path, meldungen=(rows, "nr long, datum string"))
    assert run(spark, "feed_date_parse", folder) == {(n, DATES.get(d)) for n, d in rows}
    now = dt.datetime.now(dt.UTC).strftime("%Y-%m")
    assert dict(run(spark, "feed_month_bucket", folder)) == {"2024-10": 5, "2025-11": 2, now: 9}


@given_tables
def test_feed_dates_against_the_mail_parser(spark):
    raw = dict(duckdb.sql(f"SELECT nr, datum FROM '{FOLDER}/meldungen.parquet'").fetchall())
    got = dict(run(spark, "feed_date_parse", FOLDER))
    assert set(got) == set(raw)
    mail = re.compile(r"[A-Z][a-z]{2}, \d\d [A-Z][a-z]{2} \d{4} \S+ (?:[+-]\d{4}|UT|GMT|EST|EDT)")
    iso = re.compile(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)")

    def at(read, d):
        try:
            return read(d).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:  # no such day
            return None

    seen = 0
    for nr, d in raw.items():
        if d and mail.fullmatch(d):
            assert got[nr] == at(parsedate_to_datetime, d)
            seen += 1
        elif d and iso.fullmatch(d):
            assert got[nr] == at(dt.datetime.fromisoformat, re.sub(r"\.\d+", "", d.upper()))
    assert seen > 50


# --- feed_scan --------------------------------------------------------------------------------------------

ITEM = "nr long, titel string, url string, datum string, zusammenfassung string, herausgeber string, kategorie string"


def test_feed_scan_reads_all_four(spark, tmp_path):
    long = "Satz. " * 300
    rows = [
        (1, " Frist & <Folgen> ", "https://a.test/x?a=1&b=2", "15.10.2024", f"<p>Gr&uuml;nbach &amp; Co</p> {long}", "", "K"),
        (2, "Titel", "https://a.test/y", None, None, None, None),
        (3, None, "https://a.test/z", "x", "ohne Titel", "H", "K"),
        (4, "ohne Adresse", None, "x", "y", "H", "K"),
    ]
    got = {r[0]: r[1:] for r in run(spark, "feed_scan", lay(spark, tmp_path, meldungen=(rows, ITEM)))}
    assert set(got) == {1, 2} and got[2] == ("Titel", "https://a.test/y", None, "")
    assert got[1][:3] == ("Frist &", "https://a.test/x?a=1&b=2", "15.10.2024")
    assert "Grünbach & Co" in got[1][3] and got[1][3].count("Satz.") == 300


@given_tables
def test_feed_scan_against_brute_force(spark):
    want = set()
    for nr, t, u, d, z in duckdb.sql(f"SELECT nr, titel, url, datum, zusammenfassung FROM '{FOLDER}/meldungen.parquet'").fetchall():
        u, d = ((x or "").strip() for x in (u, d))
        if (t or "").strip() and re.match(r"(?i)https?://...", u):
            want.add((nr, clean_text(t), u, d or None, clean_text(z or "")))
    assert run(spark, "feed_scan", FOLDER) == want and len(want) > 500


# --- prefix_relations, mapping_matrix ---------------------------------------------------------------------

PLACE = "struct<rw string, pfad string>"
EDGES = f"verweis_nr long, von {PLACE}, nach {PLACE}, typ string, quelle string, konfidenz double, erfasst timestamp_ntz, beleg string"


def edges(*pairs):
    return [(n, a, b, "t", "q", 1.0, None, "x") for n, (a, b) in enumerate(pairs, 1)]


def test_prefix_relations_in_both_directions(spark, tmp_path):
    rows = edges((("w", "art/1"), ("v", "art/9")), (("w", None), ("w", "art/1/abs/2")), (("v", "art/9"), ("w", "art/1/abs/2")))
    places = [("w", "art/1"), ("w", "art/1/abs/2"), ("w", "art/2"), ("v", "art/9"), ("u", "art/1")]
    folder = lay(spark, tmp_path, verweise=(rows + rows[:1], EDGES), knoten=(places, "regelwerk string, pfad string"))
    assert run(spark, "prefix_relations", folder) == {("w", "art/1", 2), ("w", "art/1/abs/2", 3), ("w", "art/2", 1), ("v", "art/9", 2)}


_TOUCH = " OR ".join(f"(e.{s}.rw = p.regelwerk AND (e.{s}.pfad IS NULL OR p.pfad = e.{s}.pfad OR (starts_with(p.pfad, e.{s}.pfad || '/') AND len(string_split(e.{s}.pfad, '/')) % 2 = 0)))" for s in ("von", "nach"))


@given_tables
def test_prefix_relations_against_sql(spark):
    assert agrees(spark, "prefix_relations", f"WITH p AS (SELECT DISTINCT regelwerk, pfad FROM knoten WHERE pfad IS NOT NULL) SELECT p.regelwerk, p.pfad, count(DISTINCT e.verweis_nr) AS beziehungen FROM p JOIN verweise e ON {_TOUCH} GROUP BY ALL")


def test_mapping_matrix_counts_every_relation(spark, tmp_path):
    rows = edges(*[(("a-vo-1", None), (to, None)) for to in ("b-rts-1", "b-gl-2", "b-gl-3", "b-neu-4", "ohne", None)], (("x", None), ("b-dvo-1", None)))
    df = entry.queries()["mapping_matrix"](spark, lay(spark, tmp_path, verweise=(rows + rows[:1], EDGES)))
    got = {r.von: r for r in df.collect()}
    assert (got["vo"].rts, got["vo"].gl, got["vo"].andere, got["vo"].lz, got[""].dvo) == (1, 2, 3, 0, 1)
    assert sum(sum(r[1:]) for r in got.values()) == 7


@given_tables
def test_mapping_matrix_against_sql(spark):
    kinds = ["rts", "its", "vo", "rl", "lz", "rs", "kat", "std", "gl", "dvo"]
    columns = ", ".join(f"count(*) FILTER (nach = '{k}') AS {k}" for k in kinds)
    assert agrees(spark, "mapping_matrix", f"""WITH k AS (SELECT regexp_extract(von, '-([a-z]+)-\\d+$', 1) AS von, regexp_extract(nach, '-([a-z]+)-\\d+$', 1) AS nach FROM (SELECT DISTINCT verweis_nr, von.rw AS von, nach.rw AS nach FROM verweise))
        SELECT von, {columns}, count(*) FILTER (nach IS NULL OR nach NOT IN {tuple(kinds)}) AS andere FROM k GROUP BY von""")


# --- version_ids ------------------------------------------------------------------------------------------


def test_version_ids_over_all_deliveries(spark, tmp_path):
    rows = [(5, 1, "w", "2024-01-02b"), (1, 1, "w", "2024-01-02"), (2, 1, "w", " 2024-01-02 "), (7, 2, "w", "2024-01-02"), (8, 2, "w", "2024-05-06"), (3, 3, "w", "2024-05-06x"), (9, 3, "v", "2024-01-02"), (4, None, "v", "2024-01-02c")]
    folder = lay(spark, tmp_path, fassungen=(rows, "zeile long, lieferung int, regelwerk string, id string"))
    assert run(spark, "version_ids", folder) == {(1, "w", "2024-01-02"), (5, "w", "2024-01-02b"), (8, "w", "2024-05-06"), (3, "w", "2024-05-06b"), (9, "v", "2024-01-02"), (4, "v", "2024-01-02b")}


@given_tables
def test_version_ids_against_sql(spark):
    assert agrees(spark, "version_ids", r"""WITH v AS (SELECT regelwerk, regexp_replace(id, '\s', '', 'g') AS id, min((lieferung, zeile)) AS erst FROM fassungen GROUP BY ALL)
        SELECT erst[2] AS zeile, regelwerk, left(id, 10) || repeat('b', CAST(row_number() OVER (PARTITION BY regelwerk, left(id, 10) ORDER BY erst) - 1 AS INT)) AS fassung FROM v""")
