"""Inverted index, stored, and BM25 ranking.

Stems are computed row by row in generated code, so the only shuffle on the way to postings is their own aggregation,
after a partial one per task. The stored index has its postings in buckets by the hash of the stem, sorted by stem, with the
length of the document in each; a search reads the buckets of its stems only, and the directory for numbers of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written

K1, B = 1.2, 0.75


def stems(docs: DataFrame, keys: list[str], *texts: tuple[Column, int]) -> DataFrame:
    """(*keys, stem) for every indexed word of the texts; each text's words count ``weight`` times. Null texts give nothing."""
    parts = [X.words(t) if weight == 1 else F.flatten(F.array_repeat(X.words(t), weight)) for t, weight in texts]
    exploded = docs.select(*keys, F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("_w"))
    # an array of one or no stem instead of a filter: a filter would be pushed below and compute every stem twice
    return exploded.select(*keys, F.explode(F.array_compact(F.array(X.stem(F.col("_w"))))).alias("stem"))


def postings(stemmed: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, stem, tf)."""
    return stemmed.groupBy(*keys, "stem").agg(F.count("*").alias("tf"))


def lengths(stemmed: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, laenge): documents without an indexed word do not appear."""
    return stemmed.groupBy(*keys).agg(F.count("*").alias("laenge"))


def index_stats(doc_lengths: DataFrame, index: list[str]) -> DataFrame:
    """(*index, dokumente, avgdl), the mean length rounded to two places."""
    return doc_lengths.groupBy(*index).agg(F.count("*").alias("dokumente"), F.round(F.avg("laenge"), 2).alias("avgdl"))


def query_stems(spark, query: str) -> list[str]:
    """The distinct stems of a search text, in order."""
    one = spark.range(1).select(F.posexplode(X.words(F.lit(query))).alias("p", "w")).select("p", X.stem(F.col("w")).alias("s")).where("s is not null")
    return list(dict.fromkeys(r.s for r in one.orderBy("p").collect()))


class StoredIndex:
    """Postings and directory of all indexes below a path. ``index``: the columns that tell indexes apart; ``key``: that of documents."""

    def __init__(self, spark, path: str, index: list[str], key: str, types: dict[str, str], buckets: int = 16) -> None:
        self.spark, self.index, self.key, self.buckets = spark, index, key, buckets
        self._postings, self._directory = f"{path}/worte", f"{path}/verzeichnis"
        named = [f"`{c}` {types[c]}" for c in index]
        self._posting_types = ", ".join(["stem string", *named, f"`{key}` {types[key]}", "tf bigint", "laenge bigint", "eimer int"])
        self._directory_types = ", ".join([*named, "dokumente bigint", "avgdl double", "eintraege bigint"])

    def _bucket(self, stem: Column) -> Column:
        return F.pmod(F.xxhash64(stem), F.lit(self.buckets)).cast("int")

    def build(self, stemmed: DataFrame) -> StoredIndex:
        """Write all indexes from (*index, key, stem). A stem that most documents have is spread over several files of its bucket."""
        keys = [*self.index, self.key]
        rows = postings(stemmed, keys).withColumn("laenge", F.sum("tf").over(Window.partitionBy(*keys)))
        laid = rows.withColumn("eimer", self._bucket(F.col("stem"))).repartition("eimer", F.pmod(F.xxhash64(self.key), F.lit(4))).sortWithinPartitions("eimer", "stem")
        laid.write.mode("overwrite").partitionBy("eimer").parquet(self._postings)
        per_document = self.postings().groupBy(*keys, "laenge").agg(F.count("*").alias("_n"))
        listed = per_document.groupBy(*self.index).agg(F.count("*").alias("dokumente"), F.round(F.avg("laenge"), 2).alias("avgdl"), F.sum("_n").alias("eintraege"))
        listed.write.mode("overwrite").parquet(self._directory)
        return self

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(stem, *index, key, tf, laenge) of the given stems, or of all."""
        rows = self.spark.read.schema(self._posting_types).parquet(self._postings)
        if terms is None:
            return rows.drop("eimer")
        buckets = self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t"))).distinct().collect()  # of a search's few words
        return rows.where(F.col("eimer").isin([b[0] for b in buckets]) & F.col("stem").isin(terms)).drop("eimer")

    def directory(self) -> DataFrame:
        """(*index, dokumente, avgdl, eintraege) of every index."""
        return self.spark.read.schema(self._directory_types).parquet(self._directory)


def rank(index: StoredIndex, terms: list[str], only: Column | None = None, hidden: Column | None = None, most: int | None = 80) -> DataFrame:
    """BM25 with coverage boost: (*index, key, treffer, punkte), best first, at most ``most``.

    Document frequencies and the number of documents are those of the indexes that ``only`` leaves, also of ``hidden`` ones,
    which are left out of the result only. Mean lengths are those of each index. Ties fall by key. No terms, no rows.
    """
    keys = [*index.index, index.key]
    if not terms:
        return index.postings().limit(0).select(*keys, F.lit(0).alias("treffer"), F.lit(0.0).alias("punkte"))
    listed = index.directory() if only is None else index.directory().where(only)
    found = index.postings(terms)
    found = found if only is None else found.where(only)
    hits = found.groupBy(*keys, "laenge").agg(*[F.sum(F.when(F.col("stem") == t, F.col("tf")).otherwise(0)).alias(f"_tf{i}") for i, t in enumerate(terms)])
    hits = written(hits, "treffer")  # read twice: for the document frequencies and for the scores
    n = listed.agg(F.sum("dokumente")).first()[0] or 0  # one number
    df = hits.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()  # one row of counts
    idf = [F.log1p(F.lit((n - df[i] + 0.5) / (df[i] + 0.5))) for i in range(len(terms))]
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in index.index]
    hits = hits.alias("h").join(listed.alias("m"), same).select("h.*", "m.avgdl")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("laenge") / F.col("avgdl"))
    score = sum((idf[i] * F.col(f"_tf{i}") * F.lit(K1 + 1) / (F.col(f"_tf{i}") + norm) for i in range(len(terms))), F.lit(0.0))
    matched = sum(((F.col(f"_tf{i}") > 0).cast("int") for i in range(len(terms))), F.lit(0))
    cover = matched / F.lit(len(terms))
    scored = hits.select(*keys, matched.alias("treffer"), (score * (F.lit(0.45) + F.lit(0.55) * cover) * F.when(matched == len(terms), 1.25).otherwise(1.0)).alias("punkte"))
    scored = scored if hidden is None else scored.where(~hidden)
    return scored if most is None else scored.orderBy(F.desc("punkte"), *keys).limit(most)


def highlight(text: Column, terms: list[str], mark: tuple[str, str] = ("[", "]")) -> Column:
    """The text with every word marked whose stem is among the terms."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    marked = F.transform(pieces, lambda w: F.when(X.stem(w).isin(*terms), F.concat(F.lit(mark[0]), w, F.lit(mark[1]))).otherwise(w))
    return F.array_join(marked, "")


def choose_language(indexes: DataFrame, work: str, lang: str, wanted: str) -> DataFrame:
    """One language per work: the wanted one if the work has it, else the first by name."""
    first = F.min(F.struct((F.col(lang) != wanted).alias("other"), F.col(lang).alias("lang")))
    return indexes.where(F.col(lang).isNotNull()).groupBy(work).agg(first["lang"].alias(lang))
