"""Encoding of whole corpora with a public byte-level BPE vocabulary, by overlapping chunks.

Every text is cut into chunks that reach into each other; chunks are pre-tokenised in parallel, each for itself. The pattern scans
from left to right and looks at nothing before a boundary, so as soon as two neighbouring chunks have a boundary in common inside
their overlap, the later chunk is right from there on: that is where they are stitched. A stitch is only made where the
character before it is no blank, since the pattern looks ahead after blanks. The pieces between stitches are encoded in
parallel and their ids concatenated. Where no boundary is shared (a pre-token longer than an overlap) the chunk is joined to the one
before it, as are the chunks after it until one is met; such a stretch is one pre-token and is one piece of work in any encoder, so the
result is always exact. A text of one chunk takes the same way with no stitch to look for.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written

#: Where the vocabulary lies on every machine; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk and of the overlap with the next one.
CHUNK, OVERLAP = 1_000, 200
#: Chunks meant for one task's share of a text: longer texts are spread over tasks.
SPREAD = 256


@lru_cache(4)
def encoder(path: str = VOCABULARY):
    """The encoder over a file of ranks, loaded once per Python worker. Names of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of one text; a null and an empty text give an empty list."""
    return encoder(path).encode_ordinary(text) if text else []


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes concatenated, then read as UTF-8."""
    one = encoder(path).decode_single_token_bytes
    return b"".join(map(one, ids)).decode("utf-8", errors="replace")


@lru_cache(1)
def _pattern():
    return regex.compile(PATTERN)


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of ``text`` that may serve as stitches: after a non-blank."""
    return [m.end() for m in _pattern().finditer(text) if not text[m.end() - 1].isspace()]


def cut(text: str, first: int, begin: int, end: int, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(number, wording) of the chunks that begin in ``begin`` to ``end`` of a text of which ``text`` starts at ``first``: each ``chunk`` characters and ``overlap`` more."""
    for at in range(begin, end, chunk):
        yield at // chunk, text[at - first : at - first + chunk + overlap]


def marks(part: str, k: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of chunk ``k`` that lie in what it shares with the chunk before it and with the one after it, from the start of the text."""
    ends = boundaries(part)
    if len(part) > chunk and ends and ends[-1] == len(part):
        ends.pop()  # the last pre-token may be cut off
    base = k * chunk
    return [base + e for e in ends if e < overlap] if k else [], [base + e for e in ends if e > chunk]


def stitches(shared: list[tuple[list[int], list[int]]]) -> list[int | None]:
    """Per border between neighbouring chunks the first boundary both have, given the marks of each chunk; nothing where they have none."""
    return [next((e for e in tail if e in set(head)), None) for (_, tail), (head, _) in zip(shared, shared[1:], strict=False)]


def pieces(parts: list[str], k: int, seams: list[int | None], chunk: int) -> list[str]:
    """The text of chunks ``k`` on, cut at the seams between them; over a border without seam the chunks stay together."""
    out, open_at = [], None
    held: list[str] = []
    for n, part in enumerate(parts):
        base = (k + n) * chunk
        seam = seams[n] if n < len(seams) else None
        begin = base if open_at is None else open_at
        last = n == len(parts) - 1
        upto = len(part) if last else (seam if seam is not None else base + chunk) - base
        held.append(part[begin - base : upto])
        open_at = None
        if seam is not None or last:
            out.append("".join(held))
            held, open_at = [], seam
    return out


def encode_by_chunks(text: str, encode_ordinary, chunk: int, overlap: int) -> list[int]:
    """Ids of one text by overlapping chunks, stitched where their boundaries resynchronise."""
    parts = [p for _, p in cut(text, 0, 0, len(text), chunk, overlap)]
    if len(parts) > 1 and len(parts[-1]) <= overlap:
        parts.pop()  # it lies in the chunk before it as a whole
    seams = stitches([marks(p, n, chunk, overlap) for n, p in enumerate(parts)]) if len(parts) > 1 else []
    return [i for piece in pieces(parts, 0, seams, chunk) for i in encode_ordinary(piece)]


def _ids_of(path: str, chunk: int, overlap: int, size_only: bool):
    """The task that encodes texts, given as the last column, by chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path).encode_ordinary
        for b in batches:
            ids = [encode_by_chunks(t, one, chunk, overlap) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if size_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), out], names=[*b.schema.names[:-1], "_out"])

    return run


def _mapped(df: DataFrame, keys: list[str], text: str, path: str, size_only: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_out " + ("bigint" if size_only else "array<int>")])
    return df.select(*keys, F.col(text).alias("_t")).mapInArrow(_ids_of(path, chunk, overlap, size_only), schema)


def shares(long: DataFrame, key: str, text: str, chunk: int, overlap: int, spread: int) -> DataFrame:
    """(key, a, anteil): texts cut once, in one pass, into shares of ``spread`` chunks and an overlap."""
    kind = dict(long.dtypes)[key]
    step = chunk * spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                whole = b.column(1)[i].as_py()
                for a, at in enumerate(range(0, len(whole), step)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([a], pa.int32()), pa.array([whole[at : at + step + overlap]])], names=[key, "a", "anteil"])

    return long.select(key, text).mapInArrow(run, f"`{key}` {kind}, a int, anteil string").repartition(key, "a")  # not in the task that cut them


def encode_long(long: DataFrame, key: str, text: str, path: str, chunk: int, overlap: int, spread: int) -> DataFrame:
    """(key, ids) of texts that many tasks work at: each share is one large chunk to its neighbours, stitched with them the same way.

    ``key`` must be unique. Shares without a common boundary go together into one task: they are within one pre-token.
    """
    kind, step = dict(long.dtypes)[key], chunk * spread

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for a, t in zip(pdf["a"], pdf["anteil"], strict=True):
                parts = [p for _, p in cut(t, 0, 0, min(len(t), step), chunk, overlap)]
                local = [marks(p, n, chunk, overlap) for n, p in enumerate(parts)]
                head = [e for e in boundaries(parts[0]) if e < overlap] if a else []
                tail = [e for e in local[-1][1] if e > step] if len(t) > step else []
                found.append(([a * step + e for e in head], [a * step + e for e in tail]))
            yield pd.DataFrame({key: pdf[key], "a": pdf["a"], "head": [f[0] for f in found], "tail": [f[1] for f in found]})

    cut_ = written(shares(long, key, text, chunk, overlap, spread), "anteile")
    seen = cut_.mapInPandas(edges, f"`{key}` {kind}, a int, head array<bigint>, tail array<bigint>")
    w = Window.partitionBy(key).orderBy("a")
    seams = seen.withColumn("bis", F.array_min(F.array_intersect("tail", F.lead("head").over(w)))).withColumn("von", F.lag("bis").over(w))
    # shares up to the next seam are one stretch
    seams = seams.withColumn("strecke", F.sum(F.when(F.col("von").isNotNull() | (F.col("a") == 0), 1).otherwise(0)).over(w))
    begin = F.coalesce(F.col("von") - F.col("a").cast("bigint") * step, F.lit(0)).cast("int")
    last = F.lead("a").over(w).isNull()
    upto = F.when(last, F.length("anteil")).otherwise(F.coalesce(F.col("bis") - F.col("a").cast("bigint") * step, F.lit(step))).cast("int")
    stretch = seams.join(cut_, [key, "a"]).select(key, "strecke", "a", F.substring(F.col("anteil"), begin + 1, upto - begin).alias("t"))
    whole = stretch.groupBy(key, "strecke").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "t"))), lambda x: x["t"]), "").alias("t"))
    encoded = _mapped(whole, [key, "strecke"], "t", path, False, chunk, overlap)
    return encoded.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("strecke", "_out"))), lambda x: x["_out"])).alias("ids"))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(key, ids) of every row. Null and empty texts give an empty list, blank texts are encoded as they are.

    All texts go by chunks; those of more than ``spread`` chunks are cut into shares first, so that no task gets them whole.
    Repeated texts are encoded each for itself; ``key`` must be unique; further columns play no part; an empty table
    gives no rows.
    """
    long = F.coalesce(F.length(text) > chunk * spread, F.lit(False))
    short = _mapped(docs.where(~long), [key], text, path, False, chunk, overlap).withColumnRenamed("_out", "ids")
    return short.unionByName(encode_long(docs.where(long), key, text, path, chunk, overlap, spread))


def token_counts(docs: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(*keys, tokens) of every row: the sizes of texts without their ids."""
    return _mapped(docs, keys, text, path, True).withColumnRenamed("_out", "tokens")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k without special tokens."""
    return encode_texts(table(spark, folder, "documents").select("doc_id", "text"))


def p6_rueckweg(spark: SparkSession, folder: str) -> DataFrame:
    """Per language: texts, tokens, and how many texts come back exactly when their ids are decoded."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: decode(list(x)))

    found = docs.join(encode_texts(docs), "doc_id")
    return found.groupBy("lang").agg(
        F.count("*").alias("texte"),
        F.sum(F.size("ids")).alias("tokens"),
        F.count_if(back("ids") == F.coalesce("text", F.lit(""))).alias("gleich"),
    )
