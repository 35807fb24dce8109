"""Encoding against the tokenizer itself and exact round trips; mixing against its bounds."""

import random

import pytest
from pyspark.sql import functions as F

from blattwerk.llm import encoding as E
from blattwerk.llm import mixing as M

pytest.importorskip("tiktoken")


def oracle(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    rng = random.Random(1)
    pieces = ["Artikel", " 28", " Absatz", "4", "\n", "\n\n", "   ", " \t", "it's", " we'LL", "…", "ä", "漢字", "🙂", "<|endoftext|>", "--", ".", "é", " \n ", "　", "x" * 40]
    made = ["".join(rng.choice(pieces) for _ in range(n)) for n in (1, 3, 30, 400, 900, 2000)]
    return [*made, "", " ", "\n", "a" * 700, " " * 700, "a " * 400, "!" * 650 + "b", "wort " * 100 + "z" * 500 + " ende"]


def test_encodes_like_the_tokenizer():
    want = oracle(texts())
    assert [E.encode(t) for t in texts()] == want and E.encode(None) == []
    assert [E.decode(i) for i in want] == texts()


@pytest.mark.parametrize("chunk,overlap", [(100, 60), (64, 16), (1000, 200), (37, 37), (10, 10)])
def test_chunks_are_stitched_exactly(chunk, overlap):
    one = E.encoder().encode_ordinary
    assert [E.encode_by_chunks(t, one, chunk, overlap) if t else [] for t in texts()] == oracle(texts())


@pytest.mark.parametrize("chunk,overlap,spread", [(64, 16, 4), (100, 60, 1), (1000, 100, 256)])
def test_shares_of_long_texts(spark, chunk, overlap, spread):
    rows = [(n, t, "extra") for n, t in enumerate(texts())] + [(900, None, None), (901, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in E.encode_texts(df, chunk=chunk, overlap=overlap, spread=spread).collect()}
    want = oracle([t or "" for _, t, _ in rows])
    assert got == {r[0]: w for r, w in zip(rows, want, strict=True)}
    assert E.encode_texts(df.limit(0)).count() == 0


def test_every_text_goes_by_chunks(monkeypatch):
    """No text is encoded whole: what reaches the encoder is never longer than a chunk and its overlap, unless one pre-token is."""
    seen = []
    one = E.encoder().encode_ordinary
    text = "Artikel 28 Absatz 4: die Stelle prüft. " * 200
    assert E.encode_by_chunks(text, lambda t: seen.append(len(t)) or one(t), E.CHUNK, E.OVERLAP) == E.encode(text)
    assert len(seen) >= len(text) // E.CHUNK and max(seen) <= E.CHUNK + E.OVERLAP
    assert E.encode_by_chunks("x" * 5000, lambda t: seen.append(len(t)) or one(t), 100, 20) == E.encode("x" * 5000)


def test_shares():
    rows = [("a", 0.5, 2, 10, 1000), ("b", 0.3, 8, 1, 10), ("c", 0.2, 3, 0, 0)]
    shares = {s.source: s for s in M.allocate(rows)}
    assert shares["b"].target == 80 and shares["c"].target == 0 and shares["a"].target == pytest.approx(930)
    assert shares["a"].copies == 0 and shares["a"].rest == pytest.approx(930) and shares["b"].copies == 8 and shares["b"].rest == 0
    assert M.allocate([]) == [] and M.allocate([("a", 0.0, 1, 1, 5)])[0].target == 0
    tight = M.allocate([("a", 0.5, 1, 5, 100), ("b", 0.5, 1, 5, 100)], 1000)
    assert [s.target for s in tight] == [100, 100]


def test_mix_reaches_its_shares(spark):
    rng = random.Random(2)
    rows = [(n, rng.choices("abc", (6, 3, 1))[0], rng.randint(1, 60)) for n in range(6000)] + [(9000, "a", 0), (9001, None, 50), (9002, "z", 50)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").cache()
    have = {s: sum(t for _, x, t in rows if x == s) for s in "abc"}
    shares = M.allocate([(s, w, cap, sum(x == s for _, x, _ in rows), have[s]) for s, w, cap in (("a", 0.2, 1), ("b", 0.4, 3), ("c", 0.4, 3))])
    for per_bin in (50, 5000):
        mix = M.mix(sizes, shares, per_bin=per_bin).collect()
        total = {s: sum(r.tokens * r.kopien for r in mix if r.source == s) for s in "abc"}
        assert all(abs(total[s.source] - s.target) <= 30 for s in shares)
        assert max(r.kopien for r in mix) <= 3 and {r.doc_id for r in mix}.isdisjoint({9000, 9001, 9002}) and len({r.doc_id for r in mix}) == len(mix)
        if per_bin == 50:
            first = {(r.doc_id, r.kopien) for r in mix}
    assert first == {(r.doc_id, r.kopien) for r in mix}  # the same order, whatever the bins
    assert M.mix(sizes.limit(0), shares).count() == 0 and M.mix(sizes, []).count() == 0


def test_pareto_order_has_the_wanted_probability(spark):
    chance = 0.3
    df = spark.range(20000).select(M.pareto_place(M.uniform(7, F.col("id")), F.lit(chance)).alias("p"))
    assert abs(df.where(F.col("p") < 0.5).count() / 20000 - chance) < 0.02  # odds equal inclusion odds


@pytest.mark.parametrize("measure", [0.5, 1.0])
def test_inclusion_is_unequal_as_intended(spark, measure):
    """Over many draws (one per source) every size is drawn as often as its probability says, large documents always, and every draw has the same tokens."""
    sizes, draws = [10] * 60 + [40] * 40 + [90] * 20 + [4000], [f"q{k}" for k in range(40)]
    df = spark.createDataFrame([(1000 * k + n, q, t) for k, q in enumerate(draws) for n, t in enumerate(sizes)], "doc_id long, source string, tokens long")
    target = 4000 + 1200
    factors = M.inclusion(df, spark.createDataFrame([(q, float(target)) for q in draws], "source string, _rest double"), measure).collect()
    (factor,) = {round(r["_faktor"], 9) for r in factors}
    assert factor == pytest.approx(1200 / sum(t * t**measure for t in sizes[:-1])) and len(factors) == len(draws)
    mix = M.mix(df, [M.Share(q, 1 / 40, 1, len(sizes), sum(sizes), target) for q in draws], measure=measure).collect()
    drawn = [[r for r in mix if r.source == q] for q in draws]
    assert all(abs(sum(r.tokens for r in d) - target) <= 45 for d in drawn) and all(any(r.tokens == 4000 for r in d) for d in drawn)
    for size in (10, 40, 90):
        often = sum(r.tokens == size for r in mix) / len(draws) / sizes.count(size)
        assert often == pytest.approx(min(1, factor * size**measure), abs=0.06)


def test_certain_documents_cascade(spark):
    df = spark.createDataFrame([(1, "a", 1000), (2, "a", 400), (3, "a", 30), (4, "a", 30)], "doc_id long, source string, tokens long")
    find = lambda rest: [r["_faktor"] for r in M.inclusion(df, spark.createDataFrame([("a", rest)], "source string, _rest double"), 1.0).collect()][0]
    assert find(1430.0) == pytest.approx(30 / 1800) and find(1460.0) >= 1 / 30 and find(100.0) == pytest.approx(100 / (1000**2 + 400**2 + 1800))
