"""Literal cases of text functions, search, versions, screening, citations and state."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from blattwerk.functions import text as X
from blattwerk.operators import citations as C
from blattwerk.operators import integrity as I
from blattwerk.operators import screening as S
from blattwerk.operators import search as Q
from blattwerk.operators import state as Z
from blattwerk.operators import versions as V
from blattwerk.streaming import intake


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first().x


STEMS = [("Informationsregister", "informationsregist"), ("Informationsregisters", "informationsregist"), ("Meldungen", "meld"), ("Meldung", "meld"), ("Auslagerung", "auslag"), ("Auslagerungen", "auslag"), ("IKT", "ikt"),
         ("Drittparteienrisiko", "drittparteienrisiko"), ("2022", "2022"), ("Resilienz", "resilienz"), ("Finanzunternehmen", "finanzunternehm"), ("requirements", "requirement"), ("policies", "policy"), ("und", None), ("the", None), ("a", None), (None, None)]


def test_stems(spark):
    df = spark.createDataFrame(STEMS, "w string, s string").select("w", "s", X.stem(F.col("w")).alias("g"))
    assert [(r.w, r.g) for r in df.collect()] == STEMS
    words = spark.createDataFrame([("IKT-Drittparteienrisiko der Finanzunternehmen",), ("",), (None,)], "t string").select(X.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in words] == [["IKT", "Drittparteienrisiko", "der", "Finanzunternehmen"], [], []]


@pytest.mark.parametrize(
    "expr,value,want",
    [
        (X.canonical_url, "https://a.example/x.html?nn=150166&utm_source=rss#content", "https://a.example/x.html"),
        (X.canonical_url, "https://a.example/y/?b=2&fbclid=1&a=1", "https://a.example/y?b=2&a=1"),
        (X.clean_html, "<p>Text&nbsp;mit &uuml;ber  &unbekannt; &amp;</p>", "Text mit über &"),
        (X.clean_html, "&amp;lt;b&amp;gt; &#8211;", "<b> &#8211;"),
        (X.clean_html, None, None),
        (lambda c: X.teaser(c, 5), "abcdefg", "abcde…"),
        (lambda c: X.teaser(c, 5), "abcde", "abcde"),
        (lambda c: X.shorten_at_word(c, 9), "eins zwei drei", "eins zwei…"),
        (lambda c: X.shorten_at_word(c, 4), "überlang", "über…"),
        (X.slug, "A.1-ß", "a_1__"),
        (X.percent_encode, "a b~*", "a%20b~%2A"),
        (X.act_number, "32022R2554", "2022/2554"),
        (X.act_number, "32016L0097", "2016/97"),
        (X.act_number, "62022R2554", None),
    ],
)
def test_scalars(spark, expr, value, want):
    assert one(spark, expr, value) == want


def test_addresses(spark):
    urls = [("https://a.example/x", True), ("https://sub.a.example/", True), ("http://a.example/", False), ("https://a.example:8443/", False), ("https://u:p@a.example/", False), ("https://10.0.0.1/", False), ("https://xa.example/", False), (None, False), ("", False)]
    df = spark.createDataFrame(urls, "u string, e boolean").select(X.url_allowed(F.col("u"), ["a.example"]).alias("g"), "e").collect()
    assert all(r.g == r.e for r in df)
    assert X.is_acronym("ITS") and X.is_acronym("NIS-2") and not X.is_acronym("Its") and not X.is_acronym("2022")
    assert one(spark, lambda c: X.starts_a_word(c, "its"), "bereits") is False and one(spark, lambda c: X.starts_a_word(c, "risiko"), "ikt-risikorahmen") is True


def test_ranking(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "Meldung der Meldungen"), ("a", 2, "Meldung und Prüfung"), ("b", 3, "Prüfung"), ("b", 4, None), ("b", 5, ""), (None, 6, "Prüfung")], "i string, d long, t string")
    stored = Q.StoredIndex(spark, f"file://{tmp_path}/index", ["i"], "d", dict(docs.dtypes), 8).build(Q.stems(docs, ["i", "d"], (F.col("t"), 1)))
    ranked = Q.rank(stored, ["meld", "pruf"], most=None).collect()
    assert {r.d: r.treffer for r in ranked} == {1: 1, 2: 2, 3: 1, 6: 1}
    assert max(ranked, key=lambda r: r.punkte).d == 2
    all_, shown, own = (Q.rank(stored, ["pruf"], o, h, None).collect() for o, h in ((None, None), (None, F.col("i") == "b"), (F.col("i") == "a", None)))
    assert {r.d: r.punkte for r in all_}[2] == {r.d: r.punkte for r in shown}[2] and {r.d for r in shown} == {2} and {r.d for r in own} == {2}
    assert Q.rank(stored, []).count() == 0 and Q.rank(stored, ["nirgends"]).count() == 0
    assert {(r.i, r.dokumente, r.avgdl, r.eintraege) for r in stored.directory().collect()} == {("a", 2, 2.0, 3), ("b", 1, 1.0, 1), (None, 1, 1.0, 1)}
    plan = spark._jvm.PythonSQLUtils.explainString(stored.postings(["pruf"])._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*eimer", plan) and re.search(r"PushedFilters: \[.*stem", plan)
    assert {r.stem for r in stored.postings(["pruf"]).collect()} == {"pruf"}
    empty = Q.StoredIndex(spark, f"file://{tmp_path}/leer", ["i"], "d", dict(docs.dtypes)).build(Q.stems(docs.limit(0), ["i", "d"], (F.col("t"), 1)))
    assert Q.rank(empty, ["pruf"]).count() == 0 and empty.directory().count() == 0
    assert Q.query_stems(spark, "Prüfungen der Prüfung und Meldung") == ["pruf", "meld"]
    assert one(spark, lambda c: Q.highlight(c, ["meld"]), "Die Meldung!") == "Die [Meldung]!"


def test_versions(spark):
    old = spark.createDataFrame([("w", "1", "a"), ("w", "2", "b"), ("w", "3", "c")], "w string, id string, hash string")
    new = spark.createDataFrame([("w", "1", "a"), ("w", "2", "x"), ("w", "4", "d")], "w string, id string, hash string")
    assert {(r.id, r.art) for r in V.diff(old, new, ["w", "id"]).collect()} == {("2", "geaendert"), ("3", "entfallen"), ("4", "neu")}
    assert V.diff(old.limit(0), old.limit(0), ["w", "id"]).count() == 0
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "id string, eltern string")
    assert {(r.oben, r.id, r.tiefe) for r in V.descendants(nodes, []).collect()} == {(x, x, 0) for x in "abcd"} | {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}
    with pytest.raises(ValueError):
        V.descendants(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, eltern string"), [])
    refs = spark.createDataFrame([("l", k) for k in "1234"], "l string, id string")
    assert {r.id: r.status for r in V.staleness(refs, new.drop("w"), old.drop("w"), ["id"]).collect()} == {"1": "aktuell", "2": "zu pruefen", "3": "fehlt", "4": "erfasst"}
    days = spark.createDataFrame([(1, "w", "2024-01-01"), (2, "w", "2024-01-01"), (3, "w", "2024-02-01")], "n int, w string, t string")
    assert {r.n: r.fassung for r in V.version_ids(days, "w", F.col("t"), ["n"]).collect()} == {1: "2024-01-01", 2: "2024-01-01b", 3: "2024-02-01"}


LEX = S.Lexicon((S.Term("DORA", 10, ("2022/2554",)), S.Term("ITS", 7), S.Term("Auslagerung", 9, ("outsourcing",), ("t",))), ("Podcast",))


@pytest.mark.parametrize("title,text,points", [("DORA kommt", "", 20), ("Neu", "DORA gilt", 10), ("its", "its scope", 0), ("ITS", "", 14), ("Podcast", "", -12), ("Outsourcing", "Auslagerung", 9), (None, None, 0)])
def test_scores(spark, title, text, points):
    assert one(spark, lambda a, b: S.score(a, b, LEX)["punkte"], title, text) == points


def test_extract_and_category(spark):
    long = "Das ist ein Satz ohne Belang hier. Die Auslagerung wird in diesem Satz erwähnt! Noch ein Satz, der lang genug ist. Schluss?"
    assert one(spark, lambda c: S.extract(c, ["Auslagerung"], 90), long) == ("Das ist ein Satz ohne Belang hier. Die Auslagerung wird in diesem Satz erwähnt!")
    assert one(spark, lambda c: S.extract(c, ["x"], 20), "kurz") == "kurz"
    assert one(spark, lambda c: S.extract(c, ["x"], 20), "a" * 30 + " " + "b" * 30)[-1] == "…"
    assert one(spark, S.category, "Konsultation zum Merkblatt", None) == "Konsultation" and one(spark, S.category, None, None) == "Fachartikel"


def test_stored_titles_stay_and_known_ids_are_not_taken(spark):
    """The sequential loop: what is stored stays; then item by item, against the ids stored at the start and all titles taken so far."""
    rng = random.Random(11)
    pool = ["Frist", "Bericht", "Stelle", "Auflage", "Quartal", "Gebühr", "Antrag", "Prüfung"]
    rows = [(n, rng.choice("gh"), n < 25, f"id{rng.randint(0, 70)}" if rng.random() < 0.9 else None, " ".join(rng.sample(pool, rng.choice((2, 4, 5, 6, 7))))) for n in range(160)]
    alike = lambda a, b: min(len(a), len(b)) >= 3 and 10 * len(a & b) > 7 * len(a | b)
    words = lambda t: {w for w in t.lower().split() if len(w.encode()) > 3}
    want = set()
    for g in "gh":
        known, titles = {i for _, x, da, i, _ in rows if x == g and da}, []
        for n, x, da, i, t in rows:
            if x == g and (da or (i is None or i not in known) and not any(alike(words(t), o) for o in titles)):
                titles.append(words(t))
                want.add((g, n))
    df = spark.createDataFrame(rows, "n long, g string, da boolean, id string, t string")
    got = {(r.g, r.n) for r in S.greedy_selection(df, "n", "t", ["g"], "da", "id").collect()}
    assert got == want and 60 < len(want) < 140


def test_similar_titles_and_greedy_loop(spark):
    import itertools

    rng = random.Random(5)
    words = ["alpha", "bravo", "charlie", "delta", "echos", "foxtrot", "golfe", "hotel"]
    titles = [(n, rng.choice("ab"), " ".join(rng.sample(words, rng.randint(2, 7)))) for n in range(90)] + [(90 + k, "a", "alpha bravo charlie delta") for k in range(40)] + [(200, "a", None), (201, "a", "")]
    sets = {n: frozenset(w for w in (t or "").split() if len(w) > 3) for n, _, t in titles}
    alike = lambda x, y: len(x) >= 3 and len(y) >= 3 and 10 * len(x & y) > 7 * len(x | y)
    df = spark.createDataFrame(titles, "n long, g string, t string")
    pairs, members = S.similar_titles(df, "n", "t")
    rep = {r.n: r.klasse for r in members.collect()}
    assert all(rep[n] == min(m for m in sets if sets[m] == sets[n]) for n in sets)
    want = {(a, b) for a, b in itertools.combinations(sorted(set(rep.values())), 2) if alike(sets[a], sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    taken: list[tuple] = []
    for n, g, _ in sorted(titles):
        if not any(h == g and alike(sets[m], sets[n]) for m, h in taken):
            taken.append((n, g))
    assert {(r.n, r.g) for r in S.greedy_selection(df, "n", "t", ["g"]).collect()} == set(taken)


@pytest.mark.parametrize("rare,most,at_once", [(None, 16, 4_000_000), (20, 16, 300), (3, 8, 4_000_000), (60, 12, 300)])
def test_similar_counts_as_by_pairs(spark, monkeypatch, rare, most, at_once):
    """Words all rare, some frequent, nearly all frequent; sets longer than what is counted; groups larger than what is held at a time."""
    import itertools

    monkeypatch.setattr(S.likeness, "AT_ONCE", at_once)
    rng = random.Random(3)
    words = [f"wort{i}" for i in range(24)]
    pools = [words[:12], words[4:22], words[9:]]
    titles = [" ".join(rng.sample(p, rng.randint(2, min(len(p), 18)))) for p in rng.choices(pools, k=250)]
    titles += [f"Neue Vorgaben bekannt gemacht {rng.choice(['alpha', 'bravo'])} {rng.randint(1000, 1100)}{rng.choice(['', ' eins', ' zwei drei', ' hier nach dort'])}" for _ in range(150)]
    titles += ["", None, "abc de", titles[0], titles[-1].upper()]
    sets = {n: frozenset(w for w in (t or "").lower().split() if len(w) > 3) for n, t in enumerate(titles)}
    first = {n: min(m for m in sets if sets[m] == sets[n]) for n in sets}
    links = dict.fromkeys(first.values(), 0)
    for a, b in itertools.combinations(links, 2):
        if min(len(sets[a]), len(sets[b])) >= 3 and 10 * len(sets[a] & sets[b]) > 7 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    got = {tuple(r) for r in S.similar_counts(spark.createDataFrame([*enumerate(titles)], "n long, t string"), "n", "t", rare, most).collect()}
    assert got == {(n, first[n], links[first[n]]) for n in sets} and sum(links.values()) > 1000


def test_titles_of_one_pattern_are_counted_without_their_pairs(spark, tmp_path):
    """20,000 titles that are all alike have 200 million pairs."""
    import threading

    from blattwerk.plans import screens

    n = 20_000
    spark.range(n).select(F.col("id").alias("nr"), F.format_string("Neue Vorgaben zur Meldepflicht bekannt gemacht (Nr. %d)", F.col("id") + 100_000).alias("titel")).write.parquet(f"{tmp_path}/meldungen.parquet")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = screens.title_similarity_links(spark, str(tmp_path)).groupBy("verbindungen").agg(F.count("*"), F.count_if(F.col("nr") == F.col("klasse"))).collect()
    finally:
        late.cancel()
    assert [tuple(r) for r in got] == [(n - 1, n, n)]


def test_citations(spark):
    text = "Nach Artikel 6 Absatz 1 der Verordnung (EU) 2022/2554 und Artikel 9 gilt § 23 Absatz 2. " + "x" * 60
    found = C.mine(spark.createDataFrame([(1, "w", text), (2, "w", None), (3, "w", "")], "d long, regelwerk string, t string"), ["d", "regelwerk"], "t")
    rows = {(r.art, r.nummer, r.absatz, r.akt) for r in found.collect()}
    assert rows == {("art", "6", "1", "2022/2554"), ("art", "9", None, None), ("par", "23", "2", None)}
    paths = spark.createDataFrame([("w", "art/9"), ("v", "art/6"), ("w", "art/6"), ("w", "par/2"), ("v", "art/6/abs/2")], "regelwerk string, pfad string")
    acts = spark.createDataFrame([("2022/2554", "v")], "nummer string, regelwerk string")
    got = {(r.nach_rw, r.nach_pfad) for r in C.resolve(found, paths, acts).collect()}
    assert got == {("v", "art/6"), ("w", "art/9")}
    assert C.evidence("abc", 0, 3) == "abc" and C.evidence("x" * 100, 50, 52) == "…" + "x" * (45 + 2 + 47) + "…"
    assert one(spark, C.path_prefixes, "art/28/abs/4") == ["art/28", "art/28/abs/4"]


def test_state_folds(spark):
    rows = [("u", dt.datetime(2024, 1, d), d, k) for d, k in ((1, True), (2, True), (3, False), (4, True), (5, True))] + [("v", dt.datetime(2024, 1, d), d, True) for d in range(1, 9)] + [("w", dt.datetime(2024, 1, 1), 1, False), ("x", dt.datetime(2024, 1, 1), 1, None)]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz, n int, k boolean")
    assert {r.u: r.stufe for r in Z.repetition(df, ["u"], ["ts", "n"], F.col("k")).collect()} == {"u": 2, "v": 4, "w": 0}
    assert {tuple(r) for r in Z.toggled(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), ["k"]).collect()} == {("b",)}
    assert one(spark, lambda a, b: Z.gap_filled(a, b), "Ausl", "Auslagerung") is True and one(spark, lambda a, b: Z.gap_filled(a, b), "Aus", "Auslagerung") is False


def test_integrity(spark):
    df = spark.createDataFrame([(1, "a", None), (1, " ", "x"), (2, "b", "y")], "id int, f string, r string")
    got = I.all_findings(I.duplicates(df, "t", "id"), I.required(df, "t", "id", ["f"]), I.orphans(df, "t", "id", F.col("r"), spark.createDataFrame([("x",)], "k string"), "k"), I.too_short(df, "t", "id", "f", 1))
    assert {(r.pruefung, r.schluessel, r.befund) for r in got.collect()} == {("doppelt", "1", "2 mal"), ("pflichtfeld", "1", "f"), ("verwaist", "2", "y")}


def test_stream_equals_batch(spark, tmp_path):
    import json

    land = tmp_path / "land"
    land.mkdir()
    items = [(f"DORA Meldung Nummer {n} betrifft Institut {n % 3} in Gruppe", f"https://a.example/{n % 7}", f"2024-0{n % 2 + 1}-0{n % 9 + 1}T00:00:00") for n in range(12)]
    write = lambda k, rows: (land / f"{k}.json").write_text("\n".join(json.dumps({"titel": t, "text": "", "url": u, "zeit": z}) for t, u, z in rows))
    store, check = f"file://{tmp_path}/store", f"file://{tmp_path}/check"
    for k, part in enumerate((items[:6], items[6:], [])):
        write(k, part)
        intake.start(spark, f"file://{land}", store, check, LEX, 8).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.count() == stored.select("monat", "kennung").distinct().count() > 0
    before = {tuple(r) for r in stored.select("monat", "kennung").collect()}
    intake.start(spark, f"file://{land}", store, check, LEX, 8).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(store).select("monat", "kennung").collect()} == before


def test_answers_of_every_kind(spark):
    rows = [(1, "a", "a", [1, 2], [2, 1, 2], {"x": 1, "y": 2}, {"y": 2, "x": 1}), (2, "a", "b", [1], [1, 2], {"x": 1}, {"x": 2}), (3, None, "b", None, [1], None, {"x": 1})]
    df = spark.createDataFrame(rows, "n int, g string, r string, gm array<int>, rm array<int>, gp map<string,int>, rp map<string,int>")
    got = df.select("n", Z.one_choice(F.col("g"), F.col("r")).alias("e"), Z.same_choice(F.col("gm"), F.col("rm")).alias("m"), Z.paired(F.col("gp"), F.col("rp")).alias("p"), Z.in_order(F.col("gm"), F.col("rm")).alias("o")).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [(True, True, True, False), (False, False, False, False), (False, None, False, False)]


def test_content_references_of_all_shapes(spark):
    from blattwerk.operators import content

    f = "struct<rw string, pfad string>"
    tables = {
        "lektionen": spark.createDataFrame([("l", [([("w", "a/1"), ("w", None)],), (None,), ([("v", "b"), ("v", "b")],)]), (None, None)], f"id string, abschnitte array<struct<fundstellen array<{f}>>>"),
        "quizzes": spark.createDataFrame([("q", [(None,), (("w", "a/2"),)])], f"id string, fragen array<struct<fundstelle {f}>>"),
        "karten": spark.createDataFrame([(None, ("w", "a/3")), ("k", (None, "x"))], f"id string, fundstelle {f}"),
        "fallstudien": spark.createDataFrame([("c", [("s1", [(("w", "a/4"),), (None,)], [("w", "a/5")]), (None, None, [("w", "a/6")])])], f"id string, schritte array<struct<id string, optionen array<struct<fundstelle {f}>>, fundstellen array<{f}>>>"),
        "cheatsheets": spark.createDataFrame([("s", [([("w", "a/7"), (None, None)],)])], f"id string, bloecke array<struct<punkte array<{f}>>>"),
    }
    got = sorted(tuple(r) for r in content.references(tables).collect())
    assert got == sorted([
        ("lektionen", "l/abschnitt-1", "w", "a/1"), ("lektionen", "l/abschnitt-3", "v", "b"), ("lektionen", "l/abschnitt-3", "v", "b"), ("quizzes", "q/frage-2", "w", "a/2"), ("karten", "?", "w", "a/3"),
        ("fallstudien", "c/s1", "w", "a/4"), ("fallstudien", "c/s1", "w", "a/5"), ("fallstudien", "c/?", "w", "a/6"), ("cheatsheets", "s", "w", "a/7"),
    ])
