"""Snapshots, timestamps and references against brute force and literal cases."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blattwerk.functions import moments as M
from blattwerk.operators import references as R
from blattwerk.operators import snapshots as S
from blattwerk.operators import timestamps as T


# --- snapshots --------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, S.SPAN - 1), max_size=300), st.booleans())
def test_bitmaps_come_back(low, runs):
    low = sorted(low | set(range(100, 9000)) if runs else low)
    packed = S.pack(np.array(low, dtype="i8"))
    assert list(np.flatnonzero(S.unpack(packed))) == low
    if runs and len(low) > 8000:
        assert len(packed) < 2500


def brute(rows):
    last = {}
    for n, (l, k, e, v) in enumerate(rows):
        if l is not None and (e, n) >= last.get((l, k), ((dt.datetime.min, -1), None))[0]:
            last[l, k] = ((e, n), v)
    numbers = {l for l, _ in last}
    out = set()
    for l in range(min(numbers) + 1, max(numbers) + 1):
        a, b = ({k: v for (m, k), (_, v) in last.items() if m == n} for n in (l - 1, l))
        out |= {(l, k, "neu") for k in b.keys() - a.keys()} | {(l, k, "entfallen") for k in a.keys() - b.keys()} | {(l, k, "geaendert") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = [*(f"k{i}" for i in range(60)), None]
    rows = [(rng.choice([1, 2, 3, 5, None]), rng.choice(keys), dt.datetime(2025, 1, rng.randint(1, 28)), rng.choice(["x", "y", "", None])) for _ in range(600)]
    rows += [(2, "heiss", dt.datetime(2025, 1, 1), "x")] * 300  # one key with a third of all rows
    df = spark.createDataFrame([(*r, n, "egal") for n, r in enumerate(rows)], "l int, k string, e timestamp_ntz, v string, n long, bucket string")
    got = S.changes(df, ["k"], "l", ["e", "n"], [F.col("v")], buckets=4)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert S.changes(df.limit(0), ["k"], "l", ["e", "n"], [F.col("v")]).count() == 0


def test_ordinals_persist(spark):
    first = spark.createDataFrame([(f"k{i}", 1) for i in range(50)], "k string, s int")
    known = S.new_ordinals(first, ["k"], "s", 4).cache()
    more = spark.createDataFrame([(f"k{i}", 2) for i in range(20, 90)] + [(None, 2)], "k string, s int")
    added = S.new_ordinals(more, ["k"], "s", 4, known)
    old, new = ({r.k: (r.bucket, r.ordinal) for r in d.collect()} for d in (known, added))
    assert not old.keys() & new.keys() and len(old | new) == 91 and len({*old.values(), *new.values()}) == 91
    for b in range(4):  # dense: every bucket counts from 0
        numbers = sorted(o for x, o in [*old.values(), *new.values()] if x == b)
        assert numbers == list(range(len(numbers)))


def test_snapshots_one_by_one_or_all_at_once(spark, tmp_path):
    """A register carries on: each call reads its new snapshot only, keeps all ordinals, and together they find what one call finds."""
    rng = random.Random(5)
    rows = [(l, f"k{k}", dt.datetime(2025, 1, 1), rng.choice("xyz")) for l in (1, 2, 4) for k in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "l int, k string, e timestamp_ntz, v string")
    whole = {tuple(r) for r in S.changes(df, ["k"], "l", ["e"], [F.col("v")], buckets=4).collect()}
    path, found, numbers = f"file://{tmp_path}/register", set(), {}
    for l in (1, 2, 4):
        # earlier snapshots are there no more, or spoilt: they are not read again
        seen = df.where(F.col("l") == l).unionByName(df.where(F.col("l") < l).withColumn("v", F.lit("verdorben")))
        found |= {tuple(r) for r in S.changes(seen, ["k"], "l", ["e"], [F.col("v")], path, 4).collect()}
        now = {r.k: (r.bucket, r.ordinal) for r in spark.read.parquet(f"{path}/ordnungszahlen").collect()}
        assert numbers.items() <= now.items()
        numbers = now
    assert found == whole == brute([(l, k, e, v) for l, k, e, v in rows])
    assert S.changes(df, ["k"], "l", ["e"], [F.col("v")], path, 4).count() == 0  # nothing new


def test_register_spellings(spark):
    rows = [("sha256:ABC", "abc"), (" abc\n", "abc"), ("-", None), ("", None), (None, None), ("k. A.", None)]
    got = spark.createDataFrame(rows, "h string, e string").select(S.canonical_hash(F.col("h")).alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)
    days = [("2024-02-10T00:00:00Z", "2024-02-10"), (" 31.10.2025", "2025-10-31"), ("2. März 2024", "2024-03-02"), ("-", None), (" ", None), ("bald", "bald")]
    got = spark.createDataFrame(days, "h string, e string").select(M.day_or_raw(F.col("h")).alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)


# --- timestamps -------------------------------------------------------------------------------------------

MOMENTS = [
    ("2024-06-06T08:11:28Z", "2024-06-06T08:11:28Z"), ("2024-11-19t20:39:49z", "2024-11-19T20:39:49Z"), ("2024-02-07", "2024-02-07T00:00:00Z"),
    ("2024-03-31T02:30", "2024-03-31T01:30:00Z"), ("27.10.2024 02:30", "2024-10-27T00:30:00Z"), ("27.10.2024, 03:30 Uhr", "2024-10-27T02:30:00Z"),
    ("29/08/2024 17:07", "2024-08-29T15:07:00Z"), ("08.04.26 08:33", "2026-04-08T06:33:00Z"), ("21.03.2024 - 06.56 Uhr", "2024-03-21T05:56:00Z"),
    ("Sun, 28 Jan 2024 02:53:29 +0100", "2024-01-28T01:53:29Z"), ("Wednesday, 10-Jan-24 14:55:25 GMT", "2024-01-10T14:55:25Z"), ("15 Aug 2024 09:48:26 CEST", "2024-08-15T07:48:26Z"),
    ("Mon, 12 Aug 2024 12:00:00 BST", "2024-08-12T11:00:00Z"), ("Mon, 01 Apr 2024 10:22:08 JST ", "2024-04-01T01:22:08Z"), ("Montag, 3. Juni 2024 um 00:22 Uhr", "2024-06-02T22:22:00Z"),
    ("9. Februar 2025, 17:46 MEZ", "2025-02-09T16:46:00Z"), ("May 29, 2024 9:31 AM", "2024-05-29T07:31:00Z"), ("April 13, 2024 12:05 PM", "2024-04-13T10:05:00Z"),
    ("20241027T024608Z", "2024-10-27T02:46:08Z"), ("1722306660", "2024-07-30T02:31:00Z"), ("1718471476343", "2024-06-15T17:11:16Z"), ("2025-02-03 18:30:10 UTC", "2025-02-03T18:30:10Z"),
    ("2024-02-21T20:06:32.949632273Z", "2024-02-21T20:06:32Z"), ("2024-07-17T16:34:40", "2024-07-17T14:34:40Z"),
    *((x, None) for x in ("2025", "Q3", "31.02.2024", "2025-13-01T10:00:00Z", "0000-00-00", "99.99.9999", "k. A.", "", " ", "heute", "2024-08-12 25:00", "13:00", "2024-01-01 10:00 XYZ", "May 5, 2024 13:00 PM", "12345678901")),
]


@pytest.mark.parametrize("raw,utc", MOMENTS)
def test_moments(raw, utc):
    got = M.seconds_utc(raw, "Europe/Berlin")
    assert (None if got is None else dt.datetime.fromtimestamp(got, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")) == utc


def test_zones_and_text(spark):
    assert M.seconds_utc("2024-07-01 12:00", "America/New_York") - M.seconds_utc("2024-07-01 12:00", "Asia/Tokyo") == 13 * 3600
    assert M.zone_or("Mars/Olymp", "Europe/Berlin") == M.zone_or(" ", "Europe/Berlin") == M.zone_or(None, "Europe/Berlin") == "Europe/Berlin"
    values = [0, -1, 1722306660, 951827696]
    got = spark.createDataFrame([(v,) for v in values], "s long").select(M.utc_text(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [dt.datetime.fromtimestamp(v, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for v in values]


def test_dictionary_grows_and_joins_back(spark, tmp_path):
    path = f"file://{tmp_path}/worte"
    rows = spark.createDataFrame([(1, "2024-02-07", "UTC"), (2, "2024-02-07", "UTC"), (3, "nie", "UTC"), (4, None, "UTC")], "nr int, roh string, zone string")
    first = T.extend(spark, path, T.distinct_values(rows))
    assert first.count() == 2
    more = rows.unionByName(spark.createDataFrame([(5, "08.02.2024", "UTC")], rows.schema))
    second = T.extend(spark, path, T.distinct_values(more))
    assert second.count() == 3
    got = {r.nr: r.utc for r in T.normalise(more, second).collect()}
    assert got == {1: "2024-02-07T00:00:00Z", 2: "2024-02-07T00:00:00Z", 3: None, 4: None, 5: "2024-02-08T00:00:00Z"}
    assert T.normalise(more.limit(0), second).count() == 0


def test_known_values_are_not_parsed_again(spark, tmp_path):
    """A dictionary of earlier runs is used as it is: a planted value comes back, and only new values are added."""
    path = f"file://{tmp_path}/worte"
    rows = spark.createDataFrame([(1, "2024-02-07", "UTC"), (2, "08.02.2024", "UTC")], "nr int, roh string, zone string")
    spark.createDataFrame([("2024-02-07", "UTC", 0)], "roh string, zone string, sekunden long").write.parquet(path)
    assert {r.nr: r.utc for r in T.normalise(rows, T.dictionary_of(spark, rows, path)).collect()} == {1: "1970-01-01T00:00:00Z", 2: "2024-02-08T00:00:00Z"}
    T.dictionary_of(spark, rows, path)
    assert spark.read.parquet(path).count() == 2


# --- references -------------------------------------------------------------------------------------------


def test_orphans_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: dt.datetime(2024, rng.randint(1, 12), rng.randint(1, 28))
    target = [(f"w{rng.randint(0, 4)}", f"p{rng.randint(0, 3)}", a := day(), rng.choice([None, a + dt.timedelta(days=rng.randint(0, 90))])) for _ in range(40)]
    target += target[:5] + [("w0", None, day(), None)]
    refs = [(n, rng.choice([*(f"w{i}" for i in range(6)), None]), rng.choice([*(f"p{i}" for i in range(5)), None]), rng.choice([day(), day(), day(), None])) for n in range(400)]
    refs += [(1000 + n, "w1", "p1", day()) for n in range(200)]
    want = set()
    for n, w, p, t in refs:
        if t is None or (w is None and p is None):
            continue
        rows = [x for x in target if (w is None or x[0] == w) and (p is None or x[1] == p)]
        if not any(a <= t and (b is None or t < b) for _, _, a, b in rows):
            want.add((n, "fehlt" if not rows else "geloescht" if any(b is not None and b <= t for *_, b in rows) else "spaeter"))
    r = spark.createDataFrame(refs, "n int, rw string, pfad string, t timestamp_ntz")
    k = spark.createDataFrame(target, "regelwerk string, pfad string, von timestamp_ntz, bis timestamp_ntz")
    on = [("rw", "regelwerk"), ("pfad", "pfad")]
    got = R.orphans(r, k, on, "partial", "t", ("von", "bis"))
    assert {(x.n, x.grund) for x in got.collect()} == want
    assert R.orphans(r.limit(0), k, on, "partial", "t", ("von", "bis")).count() == 0
    assert R.orphans(r, k.limit(0), on, "partial", "t", ("von", "bis")).where("grund <> 'fehlt'").count() == 0


def test_match_semantics(spark):
    k = spark.createDataFrame([("a", "x")], "w string, p string")
    r = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", None), (4, "a", "y"), (5, None, None), (6, None, "x"), (7, None, "z")], "n int, w string, p string")
    found = lambda match: {x.n for x in R.orphans(r, k, [("w", "w"), ("p", "p")], match).collect()}
    assert found("partial") == {3, 4, 7} and found("simple") == {4} and found("full") == {2, 3, 4, 6, 7}
    with pytest.raises(ValueError):
        found("anders")


def test_required_columns(spark):
    """A path without a work is an orphan, since works must be equal, whatever the periods."""
    day = dt.datetime(2024, 1, 1)
    k = spark.createDataFrame([("a", "x", day, None), ("a", "y", None, day)], "w string, p string, von timestamp_ntz, bis timestamp_ntz")
    r = spark.createDataFrame([(1, "a", "x", day), (2, None, "x", day), (3, "a", None, day), (4, None, None, day), (5, None, "x", None), (6, "a", "y", day)], "n int, w string, p string, t timestamp_ntz")
    found = lambda **more: {(x.n, x.grund) for x in R.orphans(r, k, [("w", "w"), ("p", "p")], "partial", "t", ("von", "bis"), **more).collect()}
    assert found() == {(6, "geloescht")} and found(required=("w",)) == {(2, "fehlt"), (6, "geloescht")}


def test_p4_null_work(spark, tmp_path):
    import duckdb

    from blattwerk.plans import general

    place, day = "struct<rw string, pfad string>", dt.datetime(2024, 3, 1)
    spark.createDataFrame([("w", "art/1", day, None)], "regelwerk string, pfad string, erfasst timestamp_ntz, geloescht timestamp_ntz").write.parquet(f"{tmp_path}/knoten.parquet")
    spark.createDataFrame([(1, (None, "art/1"), ("w", "/ART/1 "), day), (2, ("w", None), (None, None), day), (3, ("v", None), ("w", "art/2"), day)] * 2, f"verweis_nr long, von {place}, nach {place}, erfasst timestamp_ntz").write.parquet(f"{tmp_path}/verweise.parquet")
    spark.createDataFrame([], f"id string, stand date, abschnitte array<struct<fundstellen array<{place}>>>").write.parquet(f"{tmp_path}/lektionen.parquet")
    got = {tuple(r) for r in R.p4_found(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("knoten", "verweise", "lektionen"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == set(con.sql(general.SQL["p4_found"]).fetchall()) == {("verweise", "1", "von", "2024-03", "fehlt"), ("verweise", "3", "von", "2024-03", "fehlt"), ("verweise", "3", "nach", "2024-03", "fehlt")}


def test_canonical_paths(spark):
    got = spark.createDataFrame([(x,) for x in ("/Art/5/", " art/5", "ART/5 ", "art/5")], "p string").select(R.canonical_path(F.col("p")).alias("p")).distinct().collect()
    assert [r.p for r in got] == ["art/5"]
