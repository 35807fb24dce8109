"""Mixing sources to target shares of tokens by Pareto order sampling.

Every source gets a number of tokens. Divided by what it has, that is the number of copies its documents should have
on average: the whole part is allocated with certainty, the rest is drawn. The probability with which a document is drawn
for one more copy grows with its size (a power of its tokens, ``MEASURE``): documents for which it would reach 1 are taken
first, the others share what is left. Which documents are drawn is decided by their order: random odds divided by
inclusion odds, smallest first, until the tokens of the source are reached, so the sample's size is fixed. The order is
cut without sorting a source: tokens are summed per source and bin of the order, only the documents of the one bin in
which the cut lies are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written
from .encoding import VOCABULARY, token_counts

#: Documents meant to lie in one bin of the order: what one task ranks.
PER_BIN = 5_000
#: Inclusion probabilities are in proportion to this power of a document's tokens; 0 would make all of a source alike.
MEASURE = 0.5


@dataclass(frozen=True)
class Share:
    """What one source is to give: ``copies`` of everything and ``rest`` tokens more, drawn."""

    source: str
    anteil: float
    cap: int
    documents: int
    tokens: int
    target: float

    @property
    def copies(self) -> int:
        return min(self.cap, int(self.target / self.tokens + 1e-9)) if self.tokens else 0

    @property
    def rest(self) -> float:
        return max(0.0, self.target - self.copies * self.tokens) if self.tokens and self.copies < self.cap else 0.0


def allocate(rows: list[tuple[str, float, int, int, int]], total: float | None = None) -> list[Share]:
    """Share ``total`` tokens out to sources given as (source, anteil, cap, documents, tokens).

    ``total`` is by default what the listed sources have together. A source that cannot give its part, even if all of
    it is repeated ``cap`` times, gives that; the others make up for it in proportion to their shares, as far as their
    own caps allow. The number of sources is that of the list of shares, so this is plain arithmetic on the driver.
    """
    total = float(sum(r[4] for r in rows)) if total is None else float(total)
    full: dict[str, float] = {}
    while True:
        free = [r for r in rows if r[0] not in full]
        left, weight = total - sum(full.values()), sum(r[1] for r in free)
        targets = {r[0]: max(0.0, left) * r[1] / weight if weight > 0 else 0.0 for r in free}
        over = {r[0]: float(r[2] * r[4]) for r in free if targets[r[0]] > r[2] * r[4]}
        if not over:
            return [Share(*r, target=full.get(r[0], targets.get(r[0], 0.0))) for r in rows]
        full |= over


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that depends on the key and the seed only, so that a lost task computes the same again."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def pareto_place(u: Column, chance: Column) -> Column:
    """Random odds over inclusion odds, q, as q / (1 + q): the same order, within (0, 1)."""
    odds, inclusion = u / (1 - u), chance / (1 - chance)
    return F.when(chance >= 1, F.lit(0.0)).otherwise(odds / (odds + inclusion))


def inclusion(sizes: DataFrame, rest: DataFrame, measure: float = MEASURE) -> DataFrame:
    """(source, _faktor): the inclusion probability of a document of t tokens is the lesser of 1 and _faktor * t ** ``measure``.

    The factor makes the expected tokens of a source those of ``rest`` (source, _rest). Documents whose probability would exceed
    1 are certain; they are the largest, so they are found along the sizes, of which each counts once per source.
    """
    counted = sizes.join(rest.where("_rest > 0"), "source").groupBy("source", "_rest", "tokens").agg(F.count("*").alias("_n"))
    m = F.pow(F.col("tokens").cast("double"), F.lit(measure))
    largest_first = Window.partitionBy("source").orderBy(F.desc("tokens"))
    all_of = Window.partitionBy("source")
    rows = counted.withColumns({"_m": m, "_t": F.col("_n") * F.col("tokens"), "_mt": F.col("_n") * F.col("tokens") * m})
    rows = rows.withColumns({"_sicher": F.sum("_t").over(largest_first) - F.col("_t"), "_offen": F.sum("_mt").over(all_of) - F.sum("_mt").over(largest_first) + F.col("_mt")})
    rows = rows.withColumn("_faktor", (F.col("_rest") - F.col("_sicher")) / F.col("_offen"))
    # from the first size on that is not certain if all larger ones are; if every size is, everything is taken
    open_ = rows.where((F.col("_faktor") * F.col("_m") < 1) & (F.col("_faktor") >= 0))
    found = open_.groupBy("source").agg(F.max_by("_faktor", "tokens").alias("_faktor"))
    return counted.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("_faktor", F.lit(1.0)).alias("_faktor"))


def mix(sizes: DataFrame, shares: list[Share], key: str = "doc_id", seed: int = 20240229, per_bin: int = PER_BIN, measure: float = MEASURE) -> DataFrame:
    """(key, source, tokens, kopien) of the mix from ``sizes`` (key, source, tokens): documents used at least once.

    Texts without tokens and sources without a share are not used. ``kopien`` never exceeds the cap of the source.
    Ties in the order fall by key. The tokens of a source come within half a document of what it is to give.
    """
    spark = sizes.sparkSession
    plan = spark.createDataFrame([(s.source, s.copies, float(s.rest)) for s in shares if s.tokens] or [("", 0, 0.0)], "source string, _copies int, _rest double")
    most = max([s.documents for s in shares], default=0)
    bins = 1 << max(6, int(most // per_bin).bit_length())
    used = sizes.select(key, "source", "tokens").where("tokens > 0")
    # one number per listed source, collected like the list itself; small tables, which Spark broadcasts if their size allows
    factors = [(r.source, float(r["_faktor"])) for r in inclusion(used, plan.select("source", "_rest"), measure).collect()]
    plan = plan.join(spark.createDataFrame(factors or [("", 0.0)], "source string, _faktor double"), "source", "left")
    chance = F.least(F.lit(1.0), F.coalesce("_faktor", F.lit(0.0)) * F.pow(F.col("tokens").cast("double"), F.lit(measure)))
    placed = used.join(plan, "source").withColumn("_place", pareto_place(uniform(seed, F.col(key)), chance))
    placed = placed.withColumn("_bin", F.least(F.floor(F.col("_place") * bins), F.lit(bins - 1)).cast("int"))
    sums = placed.where("_rest > 0").groupBy("source", "_bin", "_rest").agg(F.sum("tokens").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bin")) - F.col("_sum")
    cut = sums.withColumn("_before", before).where("_before + _sum >= _rest and _before < _rest")
    cut = cut.select("source", F.col("_bin").alias("_cut"), F.col("_before").alias("_before")).collect()  # at most one row per listed source
    cuts = spark.createDataFrame([tuple(r) for r in cut] or [("", -1, 0)], "source string, _cut int, _before bigint")
    placed = placed.join(cuts, "source", "left")
    # a source whose rest reaches beyond its last bin (rounding) takes everything once more
    below = (F.col("_rest") > 0) & (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut")))
    edge = placed.where("_rest > 0 and _bin = _cut")
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("_place", key).rowsBetween(Window.unboundedPreceding, -1))
    reached = F.col("_before") + F.coalesce(running, F.lit(0)) + F.col("tokens") / 2
    taken = edge.withColumn("_more", (reached <= F.col("_rest")).cast("int"))
    rest = placed.where(~((F.col("_rest") > 0) & F.col("_cut").isNotNull() & (F.col("_bin") == F.col("_cut")))).withColumn("_more", below.cast("int"))
    both = rest.unionByName(taken).withColumn("kopien", (F.col("_copies") + F.col("_more")).cast("int"))
    return both.where("kopien > 0").select(key, "source", "tokens", "kopien")


def sized(spark: SparkSession, folder: str, path: str = VOCABULARY) -> tuple[DataFrame, list[Share]]:
    """Sizes in tokens of the documents of the listed sources, and the shares planned for them."""
    listed = table(spark, folder, "zielanteile").where("source is not null").groupBy("source").agg(F.sum("anteil").alias("anteil"), F.min("max_wiederholung").alias("cap"))
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").join(listed.select("source"), "source", "left_semi")
    sizes = written(token_counts(docs, ["doc_id", "source"], path=path), "groessen")
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    rows = listed.join(have, "source", "left").orderBy("source").collect()  # one row per listed source
    return sizes, allocate([(r.source, r.anteil or 0.0, r.cap or 0, r.documents or 0, r.tokens or 0) for r in rows])


def p7_mischung(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: every document used, its size and how often it is used."""
    sizes, shares = sized(spark, folder)
    return mix(sizes, shares)


def p7_anteile(spark: SparkSession, folder: str) -> DataFrame:
    """Per listed source: the share wanted and the share really reached, in tokens of the mix.

    ``voll``: the source is used as often as its cap allows. Sources without documents reach 0.
    """
    sizes, shares = sized(spark, folder)
    used = mix(sizes, shares).groupBy("source").agg(
        F.count("*").alias("dokumente"), F.sum("kopien").alias("kopien"), F.max("kopien").alias("hoechstens"),
        F.sum(F.col("tokens") * F.col("kopien")).alias("tokens"),
    )
    plan = spark.createDataFrame(
        [(s.source, s.anteil, s.cap, s.documents, s.tokens, s.target, bool(s.tokens and s.copies >= s.cap)) for s in shares],
        "source string, anteil double, max_wiederholung int, vorhanden bigint, tokens_vorhanden bigint, ziel_tokens double, voll boolean",
    )
    found = plan.join(used, "source", "left").na.fill(0, ["dokumente", "kopien", "hoechstens", "tokens"])
    return found.withColumn("anteil_erreicht", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)))
