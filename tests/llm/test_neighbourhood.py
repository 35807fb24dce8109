"""Deduplication of news: reading, comparing, and merging in any number of steps."""

import random

import pyarrow as pa
import pytest

from blattwerk.llm import neighbourhood as N


@pytest.mark.parametrize(
    "raw,clean",
    [("Schl&&#117;uml;ssel", "Schl&uuml;ssel".replace("&uuml;", "&uuml;")), ("<p>Im 4.</p><p>Quartal</p>", "Im 4. Quartal"), ("FÃ¼Ã\x9fe  â\x80\x93 ja", "Fuesse – ja"), ("Gr&uuml;nbach\xa0AG", "Gruenbach AG"), (None, ""), ("Œuvre é", "Œuvre e")],
)
def test_clean(raw, clean):
    if "&&#" in raw if raw else False:
        assert N.clean(raw) == "Schluessel"
    else:
        assert N.clean(raw) == clean


def test_records():
    r = lambda t, s=None, k="K", b=("Auslagerung (+3)",): N.read_item(t, s, k, b)
    base = r("Bußgeld über 315.000 Euro gegen Jascorelt Leasing Erlwörth nach Mängeln im Bereich Auslagerung")
    assert base == ("k", "jascorelt leasing erlwoerth", "auslagerung", "", "315000", "", "", "", False)
    caps = r("JASCORELT LEASING ERLWOERTH FINED 315,000 EURO")
    assert caps[1] == "" and caps[4] == "315000" and N.same_news(base, caps)
    assert r("Notice No. 101186: x")[1] == "nr 101186" and r("Fachtag Nr. 1042…", "Der Fachtag Nr. 104297 x")[1] == "nr 104297"
    assert r("A meldet Ausfall im 1. Quaartal 2025")[5] == r("Q1 2025: failure")[5] == "1/2025"
    assert r("Konsultation 09/2026: x")[3] == "9/2026" and r(None)[6] == "" and r(None, None, None, None)[1] == ""
    assert r("Wacht bei Xa Yb Zc auf", "Bei Xa Yb Zc wacht jemand.")[1] == r("Titel", "(Ort) Bei Xa Yb Zc wacht jemand.")[1] == "xa yb zc"
    assert r("Strafe", "Gegen Müller AG wird ermittelt.", b=None)[7] == "" and r("Strafe wegen Betrug", "Betrug: Müller AG.", b=None)[7] == "betrug"


def test_same_news():
    a = ("k", "jasco leasing erlwoerth", "m", "", "5", "", "", "", True)
    unsure = (*a[:8], False)
    slip = (a[0], "jasco leasing erlwoert", *a[2:8], False)
    assert N.same_news(a, a) and N.same_news(a, slip) and not N.same_news(a, (a[0], "jasco leasing erlwoert", *a[2:]))
    assert not N.same_news(a, (*a[:4], "6", *a[5:])) and not N.same_news(a, (*a[:2], "n", *a[3:])) and N.same_news(unsure, a)
    gap = ("k", "jasco leasing erlwoerth", "", "", "5", "", "jasco leasing erlwoerth m 5", "m", False)
    assert N.same_news(a, gap) and not N.same_news((*a[:2], "anderes", *a[3:]), gap)
    assert N.same_news(gap, (*gap[:6], "wegen m zahlt jasco leasing erlwoerth", "m", False)) and not N.same_news(gap, (*gap[:6], "wegen n zahlt jasco leasing erlwoerth", "n", False))
    assert N.same_news((a[0], "gegen " + a[1], *a[2:]), a)
    empty = ("", "", "", "", "", "", "", "", False)
    assert not N.same_news(empty, empty)
    assert N.one_edit("abcd", "abdc") and N.one_edit("abcd", "abc") and not N.one_edit("abcd", "axyd") and not N.one_edit("nr 1", "nr 2")


def news(seed):
    rng = random.Random(seed)
    names = [f"{a}{b} {f} {o}" for a in ("Jas", "Kul") for b in ("lant", "ding") for f in ("Bank", "Depot") for o in ("Erldorf", "Seehof")]
    wording = [lambda n, m, x: f"Bußgeld über {x}.000 Euro gegen {n} wegen {m}", lambda n, m, x: f"{n}: Aufsicht verhängt Bußgeld von {x}.000 Euro ({m})", lambda n, m, x: f"WEGEN {m.upper()}: {n.upper()} MUSS {x}.000 EURO ZAHLEN"]
    rows, first = [], {}
    for nr in range(1, 401):
        key = (rng.choice(names), rng.choice(("Auslagerung", "Meldepflicht")), rng.choice((15, 20)))
        key = (names[0], "Auslagerung", 15) if nr % 3 == 0 else key  # one item of news holds a third of all rows
        charge = 0 if nr <= 40 else 1 + (nr - 41) // 45
        if charge == 0 and key in first:
            continue
        first.setdefault(key, nr)
        title = rng.choice(wording)(*key)
        summary = None if rng.random() < 0.2 else f"<p>Gegen {key[0]} wurden {key[2]}.000 Euro verhängt.</p> Thema: {key[1]}."
        rows.append((nr, charge, title, summary, "Sanktion", None if rng.random() < 0.1 else [f"{key[1]} (+{rng.randint(1, 9)})"], key))
    return rows, first


ITEMS = "nr long, charge int, titel string, zusammenfassung string, kategorie string, begruendung array<string>"


@pytest.mark.parametrize("backlog,window", [(1, 12), (4, 12), (20, 12)])
def test_batches_find_every_repeat(spark, backlog, window):
    """Brute force: what the rows were made from, whatever their wording and whatever they lack."""
    rows, first = news(3)
    blanks = [(1000 + n, n % 9, *rest) for n, rest in enumerate([(None, None, None, None), ("", " ", "Sanktion", ["Auslagerung (+1)"]), (None, "", None, [])] * 9)]
    df = spark.createDataFrame([r[:6] for r in rows] + blanks, ITEMS)
    runs = N.Runs(spark, most=3, per_range=300, least=100)
    got = {r.nr: r.erste for r in N.deduplicate(spark, df, backlog=backlog, window=window, runs=runs).collect()}
    want = {r[0]: first[r[6]] for r in rows} | {b[0]: b[0] for b in blanks}
    assert got == want and sum(a != b for a, b in got.items()) > 200
    assert backlog > 1 or runs.ranges > 1 and runs.compactions > 1
    runs.drop()


def test_any_wording_and_any_name(spark):
    rows = [
        (1, 0, "Aufsicht verhängt Bußgeld gegen Müller AG wegen Geldwäsche in Köln", None, "Sanktion", ["Geldwäsche (+3)"]),
        (2, 1, "Müller AG muss wegen Geldwäsche Bußgeld zahlen", None, "Sanktion", ["Geldwäsche (+9)"]),
        (3, 1, "MÜLLER AG ZAHLT WEGEN GELDWÄSCHE", None, "Sanktion", ["Geldwäsche (+9)"]),
        (4, 1, "Meier AG muss wegen Geldwäsche Bußgeld zahlen", None, "Sanktion", ["Geldwäsche (+9)"]),
        (5, 2, "Müller AG muss Bußgeld zahlen, es geht um Geldwäsche", None, None, None),
    ]
    got = {r.nr: r.erste for r in N.deduplicate(spark, spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, None, None, None, None), (2, 1, "", " ", None, []), (3, None, "x" * 20000, None, "", [None]), (4, 2, None, None, None, None)], ITEMS)
    for backlog in (1, 4):
        assert {r.nr: r.erste for r in N.deduplicate(spark, df, backlog=backlog).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert N.deduplicate(spark, df.limit(0)).count() == 0


def item(nr, who, sum_, charge=0):
    return (nr, charge, "Titel", f"Bußgeld über {sum_}.000 Euro gegen {who}.", "Sanktion", ["Auslagerung (+3)"])


def test_a_batch_reads_only_its_ranges(spark):
    """Of 6,000 history keys a batch of one item reads the ranges of its three keys and those beside them, without a shuffle of the history."""
    names = [f"{a}{b}{c} Bank Seehof" for a in ("Jas", "Kul", "Nor", "Tre") for b in "aeiou" for c in ("lant", "ding", "mark", "berg", "tal")]
    history = spark.createDataFrame([item(n, names[n % 100], 100 + n // 100) for n in range(2000)], ITEMS)
    runs = N.Runs(spark, per_range=100, least=50)
    N.deduplicate(spark, history, runs=runs).count()
    assert runs.runs == 1 and runs.ranges > 40 and runs.rows().count() == 6000
    read = []
    plain = runs.rows
    runs.rows = lambda touched=None: read.append(plain(touched)) or read[-1]
    got = N.deduplicate(spark, spark.createDataFrame([item(9000, names[7], 103, 1)], ITEMS), runs=runs).collect()
    assert [(r.nr, r.erste) for r in got] == [(9000, 307)]
    assert read[0].count() <= 1500
    cogroup = read[0].groupBy("bereich").cogroup(plain([0]).groupBy("bereich")).applyInArrow(N.range_search(3), N._SEEN)
    plan = spark._jvm.PythonSQLUtils.explainString(cogroup._jdf.queryExecution(), "formatted")
    assert "Exchange" not in plan and f"SelectedBucketsCount: 1 out of {runs.ranges}" in plan
    runs.drop()


def test_runs_compact(spark):
    """Compaction keeps every row, makes one run of many and cuts the ranges anew."""
    runs = N.Runs(spark, most=2, per_range=100, least=10)
    for k in range(4):
        N.deduplicate(spark, spark.createDataFrame([item(1000 * k + n, f"{chr(65 + n % 26)}as{chr(97 + n // 26)} Bank Ort", 100 + k) for n in range(300)], ITEMS), runs=runs)
    assert (runs.runs, runs.compactions) == (2, 1) and runs.rows().count() == 3600
    assert runs.rows().groupBy("bereich").count().agg({"count": "max"}).first()[0] < 500
    runs.drop()


def test_windows_cross_borders(spark):
    """One range or many: the same pairs."""
    rows = [item(n, f"{'Kor' if n % 2 else 'Kro'}norheim Bank Buxbruch {chr(65 + n % 13)}x", 100 + n % 7, n // 100) for n in range(400)]
    df = spark.createDataFrame(rows, ITEMS)
    found = []
    for per_range in (40_000, 40):
        runs = N.Runs(spark, per_range=per_range, least=per_range)
        found.append({tuple(r) for r in N.deduplicate(spark, df, runs=runs).collect()})
        assert (runs.ranges > 1) == (per_range == 40)
        runs.drop()
    assert found[0] == found[1] and sum(a != b for a, b in found[0]) > 200


@pytest.mark.parametrize("blank", [None, "", " "])
def test_a_missing_kind_hides_no_repeat(spark, blank):
    schema = "nr long, charge int, titel string, zusammenfassung string, kategorie string, begruendung array<string>"
    item = lambda nr, charge, kind, who="Jaslant Bank Erldorf", sum_=15: (nr, charge, "Titel", f"Bußgeld über {sum_}.000 Euro gegen {who}.", kind, ["Auslagerung (+3)"])
    crowd = [item(10 + k, 0, "Meldung", sum_=100 + k) for k in range(40)] + [item(60 + k, 0, "Meldung", f"Kul{a}ding Bank Seehof") for k, a in enumerate("abcdefghijklmnopqrst")]
    rows = [item(1, 0, "Sanktion"), item(2, 0, blank, "Kulding Depot Erldorf"), *crowd, item(100, 1, blank), item(101, 2, "Sanktion", "Kulding Depot Erldorf")]
    rows += [item(103, 3, "Meldung", "Rondo Bank Seehof", 9), item(104, 4, "Sanktion", "Rondo Bank Seehof", 9)]
    got = {r.nr: r.erste for r in N.deduplicate(spark, spark.createDataFrame(rows, schema), backlog=1).collect()}
    assert got[100] == 1 and got[101] == 2 and got[103] == 103 and got[104] == 104


def test_ranges_by_tree_or_bisection(spark, monkeypatch):
    rng = random.Random(8)
    keys = ["".join(rng.choice("aäz|\x1f🙂 ") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    runs, found = N.Runs(spark), []
    runs.borders = sorted(set(rng.sample(keys, 12)))
    for limit in (256, 0):
        monkeypatch.setattr(N, "TREE", limit)
        found.append([r.bereich for r in runs.placed(spark.createDataFrame([(k,) for k in keys], "schluessel string")).collect()])
    assert found[0] == found[1] == [sum(b <= k for b in runs.borders) for k in keys]


def test_what_meets_again_is_not_compared_again(monkeypatch):
    """Two entries without a name stand side by side under five keys: one comparison."""
    types = {"bereich": pa.int32(), "schluessel": pa.string(), "sicher": pa.bool_(), "satz": pa.list_(pa.string())}
    schema = pa.schema([(c, types.get(c, pa.int64())) for c in N._ROW])
    row = lambda nr, gram: {"bereich": 0, "schluessel": f"0\x1f{gram}\x1f\x1f\x1f\x1fbetrug\x1fk\x1f\x1f{nr:020}", "nr": nr, "erste": nr, "figuren": 1, "wer": 2, "was": 3, "wie": 4, "sicher": False}
    rows = lambda nr: pa.Table.from_pylist([row(nr, gram) | {"satz": ["k", "", "betrug", "", "", "", "a b c d", ""]} for gram in ("a b", "a b c", "b c", "b c d", "c d")], schema)
    calls, plain = [], N.same_news
    monkeypatch.setattr(N, "same_news", lambda a, b: calls.append((a, b)) or plain(a, b))
    found = N.range_search(12)((pa.scalar(0),), rows(1), rows(2)).to_pylist()
    assert [(f["neu"], f["alt"], f["alt_neu"], f["alt_erste"]) for f in found if f["neu"] is not None] == [(2, 1, False, 1)]
    assert calls == [(("k", "", "betrug", "", "", "", "a b c d", "", False),) * 2]


def test_keys_of_the_history_are_made_once(spark, monkeypatch):
    """Borders are placed by keys that are written, not by keys that are made anew for counting, for looking and for writing."""
    plans, plain = [], N.Runs.cut
    monkeypatch.setattr(N.Runs, "cut", lambda self, keyed: plans.append(spark._jvm.PythonSQLUtils.explainString(keyed._jdf.queryExecution(), "formatted")) or plain(self, keyed))
    got = N.deduplicate(spark, spark.createDataFrame([item(n, f"Jas{chr(97 + n)}ant Bank Seehof", 100, n // 20) for n in range(26)] + [item(30, "Jasbant Bank Seehof", 100, 2)], ITEMS))
    assert {(r.nr, r.erste) for r in got.collect()} == {(n, n) for n in range(26)} | {(30, 1)}
    assert len(plans) == 1 and "Generate" not in plans[0] and "Scan parquet" in plans[0]


def test_the_first_reason_counts(spark):
    reasons = [None, [], [None], [""], ["", None, "Betrug (+1)", "Anderes"], ["Anderes (+2)", None]]
    df = spark.createDataFrame([(n, 0, "Bußgeld gegen Müller AG", None, "Sanktion", r) for n, r in enumerate(reasons)], ITEMS).withColumnRenamed("charge", "_stapel")
    got = {r.nr: tuple(r)[2:] for r in N.records(df).collect()}
    assert got == {n: N.read_item("Bußgeld gegen Müller AG", None, "Sanktion", r) for n, r in enumerate(reasons)}
