"""Intake of news as a stream: stateless scoring of every micro-batch, then a merge into month partitions.

News may arrive arbitrarily late and still belong to their own month, so there is no watermark: each micro-batch is merged
with the stored months it touches, idempotently by batch number, in ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as X
from ..operators import screening as S
from ..session import stored


def scored(news: DataFrame, lexicon: S.Lexicon, threshold: int) -> DataFrame:
    """Items with id, score, category, extract and month, from the threshold up; works on streams and tables alike."""
    s = S.score(F.col("titel"), F.col("text"), lexicon)
    rows = news.where(X.is_web_address(F.col("url"))).select(
        "*", X.url_id(F.col("url")).alias("kennung"), s["punkte"].alias("punkte"), F.array_join(s["begruendung"], "; ").alias("begruendung"),
        S.category(F.col("titel"), F.col("text")).alias("kategorie"), F.date_format("zeit", "yyyy-MM").alias("monat"),
    )
    return rows.where(F.col("punkte") >= threshold)


def merge_months(batch: DataFrame, store: str, number: int) -> None:
    """Add a micro-batch to the stored months: unknown ids whose title is not alike to one stored or taken before.

    Every batch writes its own folder, so doing a batch again replaces what it wrote and nothing else.
    """
    spark = batch.sparkSession
    own = f"{store}/stapel={number}"
    fresh = batch.withColumn("_neu", F.lit(1))
    if stored(spark, store):
        old = spark.read.schema(f"{batch._jdf.schema().toDDL()}, stapel INT").parquet(store).where(F.col("stapel") != number).drop("stapel").withColumn("_neu", F.lit(0))
        months = batch.select("monat").distinct()
        near = old.join(months, "monat", "left_semi").select(fresh.columns)
        fresh = fresh.join(near.select("monat", "kennung").distinct(), ["monat", "kennung"], "left_anti").unionByName(near)
    ranked = fresh.withColumn("_rang", F.struct("_neu", "zeit", "kennung"))
    order = F.concat_ws("|", F.col("_neu").cast("string"), F.date_format("zeit", "yyyyMMddHHmmssSSSSSS"), "kennung")
    keyed = ranked.drop("_rang").withColumn("_folge", order)
    taken = S.greedy_selection(keyed.select("monat", "_folge", "titel", (F.col("_neu") == 0).alias("_alt")), "_folge", "titel", ["monat"], "_alt")
    kept = keyed.join(taken, ["monat", "_folge"], "left_semi").where("_neu = 1").drop("_neu", "_folge")
    kept.write.mode("overwrite").parquet(own)


def start(spark: SparkSession, landing: str, store: str, checkpoint: str, lexicon: S.Lexicon, threshold: int = 8) -> DataStreamWriter:
    """The intake of JSON files (titel, text, url, zeit) that land in a folder, ready to be started with a trigger."""
    news = spark.readStream.schema("titel string, text string, url string, zeit timestamp_ntz").json(landing)
    writer = scored(news, lexicon, threshold).writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, number: merge_months(batch, store, number))
