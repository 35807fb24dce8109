"""What changed between full snapshots: persistent ordinals, compressed bitmaps, aligned vectors.

Keys get ordinals that never change: a key belongs to a bucket by its hash and takes the next free number there.
Of each snapshot and container (``SPAN`` ordinals of a bucket) there is one compact row: a compressed bitmap of
the ordinals present, and the digests of their values, aligned to the set bits. Two consecutive snapshots are
then compared container by container: AND-NOT of the bitmaps gives additions and removals, AND gives the common
keys, and the aligned vectors show which of those changed. Only changed ordinals are looked up again as keys.

Ordinals and containers are stored in a register that grows with every snapshot. A new snapshot is numbered by it and compared
with the containers of the one before; the rows of earlier snapshots are not read again.

A container holds at most ``SPAN`` keys whatever the input, so no task ever gets an unbounded group; rows that
repeat a key are reduced before the shuffle, so a key that holds a third of all rows costs one row per map task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import moments
from ..session import new_place, remove, stored, table, written

#: Ordinals of a container: a bitmap of at most 8 KB.
SPAN = 1 << 16
#: Keys a bucket is meant to hold, so that the work spreads; any number is right, more only adds containers.
KEYS_PER_BUCKET = 20_000

_EDGES = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_KIND = {1: "neu", 2: "entfallen", 3: "geaendert"}


# --- compressed bitmaps -----------------------------------------------------------------------------------


def pack(low: np.ndarray) -> bytes:
    """Compress sorted distinct ordinals of a container: as array, runs or bit field, whichever is smallest."""
    low = np.asarray(low, dtype="<u2")
    if not len(low):
        return b"A"
    starts = np.flatnonzero(np.diff(low.astype("i4"), prepend=-2) != 1)
    lengths = np.diff(np.append(starts, len(low)))
    runs = np.column_stack([low[starts], (lengths - 1).astype("<u2")]).astype("<u2")
    bits = np.zeros(SPAN, bool)
    bits[low] = True
    forms = (b"A" + low.tobytes(), b"R" + runs.tobytes(), b"B" + zlib.compress(np.packbits(bits).tobytes(), 1))
    return min(forms, key=len)


def unpack(packed: bytes | None) -> np.ndarray:
    """The bits of a compressed bitmap as a boolean array of ``SPAN``; null is empty."""
    bits = np.zeros(SPAN, bool)
    if not packed or len(packed) == 1:
        return bits
    if packed[:1] == b"A":
        bits[np.frombuffer(packed[1:], "<u2")] = True
    elif packed[:1] == b"R":
        edges = np.zeros(SPAN + 1, "i4")
        runs = np.frombuffer(packed[1:], "<u2").reshape(-1, 2).astype("i4")
        np.add.at(edges, runs[:, 0], 1)
        np.add.at(edges, runs.sum(axis=1) + 1, -1)
        bits = np.cumsum(edges[:-1]) > 0
    else:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed[1:]), "u1"))[:SPAN].astype(bool)
    return bits


def differences(before: tuple, after: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Low ordinals and kinds (1 added, 2 removed, 3 changed) between two (bitmap, vector) containers."""
    was, now = unpack(before[0]), unpack(after[0])
    added, removed, both = np.flatnonzero(now & ~was), np.flatnonzero(was & ~now), np.flatnonzero(was & now)
    changed = both
    if len(both):
        at = lambda bits, vector: np.frombuffer(vector, "S16").reshape(-1)[(np.cumsum(bits) - 1)[both]]
        changed = both[at(was, before[1]) != at(now, after[1])]
    lows = np.concatenate([added, removed, changed])
    return lows, np.repeat([1, 2, 3], [len(added), len(removed), len(changed)])


# --- operators --------------------------------------------------------------------------------------------


def bucket_count(rows: int) -> int:
    """A power of two near one bucket per ``KEYS_PER_BUCKET`` rows; a stored register keeps the number it began with."""
    return 1 << max(4, int(rows // KEYS_PER_BUCKET).bit_length())


def _same(on: list[str], left: str, right: str) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in on]


def new_ordinals(keys: DataFrame, on: list[str], since: str, buckets: int, known: DataFrame | None = None) -> DataFrame:
    """(*on, bucket, ordinal) of the keys that are not in ``known``; ordinals are counted from 0 in each bucket and go on where ``known`` ends.

    They follow in the order of ``since``, then of the key, so the numbers are the same whether snapshots are registered one
    by one or all at once.
    """
    fresh = keys if known is None else keys.alias("n").join(known.alias("k"), _same(on, "n", "k"), "left_anti")
    order = Window.partitionBy("bucket").orderBy(F.col(since), *on)
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(*on), F.lit(buckets)).cast("int")).withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint"))
    if known is not None:
        taken = known.groupBy("bucket").agg((F.max("ordinal") + 1).alias("_from"))
        fresh = fresh.join(taken, "bucket", "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("_from", F.lit(0)))
    return fresh.select(*on, "bucket", "ordinal")


def containers(states: DataFrame, snapshot: str) -> DataFrame:
    """One row per bucket, container and snapshot: ``karte`` (compressed bitmap) and ``werte`` (16-byte digests in its order).

    ``states``: rows of (bucket, ordinal, ``snapshot``, digest), one per key and snapshot.
    """

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        return pd.DataFrame({"bucket": [key[0]], "behaelter": [key[1]], snapshot: [key[2]], "karte": [pack(pdf["low"].to_numpy())], "werte": [b"".join(pdf["digest"])]})

    low = (F.col("ordinal") % SPAN).cast("int").alias("low")
    rows = states.select("bucket", F.floor(F.col("ordinal") / SPAN).cast("bigint").alias("behaelter"), F.col(snapshot), low, "digest")
    kind = dict(states.dtypes)[snapshot]
    return rows.groupBy("bucket", "behaelter", snapshot).applyInPandas(build, f"bucket int, behaelter bigint, {snapshot} {kind}, karte binary, werte binary")


def container_changes(cells: DataFrame, snapshot: str) -> DataFrame:
    """Compare each snapshot's containers with those of the snapshot numbered one less: (bucket, ordinal, snapshot, art)."""
    first, last = cells.agg(F.min(snapshot), F.max(snapshot)).first()  # two numbers
    after = cells.select("bucket", "behaelter", F.col(snapshot), F.col("karte").alias("k2"), F.col("werte").alias("w2"))
    before = cells.select("bucket", "behaelter", (F.col(snapshot) + 1).cast(dict(cells.dtypes)[snapshot]).alias(snapshot), F.col("karte").alias("k1"), F.col("werte").alias("w1"))
    inside = (F.col(snapshot) > F.lit(first)) & (F.col(snapshot) <= F.lit(last))
    pairs = before.join(after, ["bucket", "behaelter", snapshot], "full").where(inside)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lows, kinds = differences((r.k1, r.w1), (r.k2, r.w2))
                if len(lows):
                    yield pd.DataFrame({"bucket": np.int32(r.bucket), "ordinal": r.behaelter * SPAN + lows.astype("i8"), snapshot: getattr(r, snapshot), "art": kinds.astype("i4")})

    kind = dict(cells.dtypes)[snapshot]
    found = pairs.mapInPandas(compare, f"bucket int, ordinal bigint, {snapshot} {kind}, art int")
    names = F.create_map(*[F.lit(x) for pair in _KIND.items() for x in pair])
    return found.withColumn("art", names[F.col("art")])


class Register:
    """What is stored of all snapshots below a path: the keys' ordinals, and one container row per snapshot, bucket and ``SPAN`` ordinals."""

    def __init__(self, spark: SparkSession, path: str, on: list[str], snapshot: str, types: dict[str, str]) -> None:
        self.spark, self.on, self.snapshot = spark, on, snapshot
        self._keys, self._cells, self._size = (f"{path}/{n}" for n in ("ordnungszahlen", "behaelter", "eimer"))
        self._key_types = ", ".join([f"`{c}` {types[c]}" for c in on] + ["bucket int", "ordinal bigint"])
        self._cell_types = f"bucket int, behaelter bigint, karte binary, werte binary, `{snapshot}` {types[snapshot]}"

    def keys(self) -> DataFrame | None:
        return self.spark.read.schema(self._key_types).parquet(self._keys) if stored(self.spark, self._keys) else None

    def cells(self) -> DataFrame | None:
        return self.spark.read.schema(self._cell_types).parquet(self._cells) if stored(self.spark, self._cells) else None

    def last(self) -> int | None:
        """The number of the last snapshot stored."""
        cells = self.cells()
        return None if cells is None else cells.agg(F.max(self.snapshot)).first()[0]

    def buckets(self, wanted: int) -> int:
        """The number of buckets it was begun with, which is ``wanted`` for a new one."""
        if not stored(self.spark, self._size):
            self.spark.createDataFrame([(wanted,)], "eimer int").write.parquet(self._size)
        return self.spark.read.parquet(self._size).first()[0]

    def number(self, keys: DataFrame, since: str, buckets: int) -> None:
        """Give new keys their ordinals."""
        new_ordinals(keys, self.on, since, buckets, self.keys()).write.mode("append").parquet(self._keys)

    def add(self, states: DataFrame) -> None:
        """Store the containers of new snapshots; a write is done whole or not at all."""
        containers(states, self.snapshot).write.mode("append").partitionBy(self.snapshot).parquet(self._cells)


def changes(rows: DataFrame, on: list[str], snapshot: str, arrived: list[str], values: list[Column], register: str | None = None, buckets: int | None = None) -> DataFrame:
    """Changes between consecutive full snapshots: (``snapshot``, *on, art), art being neu, entfallen or geaendert.

    Of several rows of a key in a snapshot the last by ``arrived`` counts. ``values`` are compared null-safely: null is a
    value of its own. Rows without a snapshot number belong to none and are left out; keys that are null or partly
    null are keys like any other; repeated rows count once; an empty table gives no changes; a number without rows
    between the first and the last snapshot is an empty snapshot. Columns not named play no part.

    ``register``: where the register of earlier snapshots lies, or a new one shall; then only snapshots after the last one in it
    are read, and only their changes returned. Without it a register is made for this call.
    """
    spark = rows.sparkSession
    book = Register(spark, register or new_place(spark, "register"), on, snapshot, dict(rows.dtypes))
    before = book.last()
    fresh = rows.where(F.col(snapshot).isNotNull() if before is None else F.col(snapshot) > F.lit(before))
    tagged = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), v), F.lit("0")) for v in values])
    last = F.max(F.struct(*arrived, F.unhex(F.md5(tagged)).alias("digest")))
    place = new_place(spark, "staende")
    current = written(fresh.groupBy(*on, snapshot).agg(last["digest"].alias("digest")), "staende", place)
    keys = current.groupBy(*on).agg(F.min(snapshot).alias("_since"))
    book.number(keys, "_since", book.buckets(buckets or bucket_count(current.count())))
    numbers = book.keys()
    book.add(current.alias("c").join(numbers.alias("o"), _same(on, "c", "o")).select("o.bucket", "o.ordinal", f"c.{snapshot}", "c.digest"))
    remove(spark, place)
    cells = book.cells()
    found = container_changes(cells if before is None else cells.where(F.col(snapshot) >= before), snapshot)
    return found.join(numbers, ["bucket", "ordinal"]).select(snapshot, *on, "art")


# --- the register of versions -----------------------------------------------------------------------------


def tidy_id(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, _EDGES, "")


def canonical_hash(c: Column) -> Column:
    """A hash in one spelling: lower case, no name of the algorithm, no blanks; null however absence is marked."""
    plain = F.regexp_replace(F.lower(tidy_id(c)), r"^sha-?\d+[:=]\s*", "")
    return F.when(~plain.isin(*moments.ABSENT), plain)


def p1_found(spark: SparkSession, folder: str, register: str | None = None) -> DataFrame:
    """Versions that appeared, vanished or changed from one delivery of the register to the next; with ``register`` since its last one."""
    rows = table(spark, folder, "fassungen").select(
        "lieferung", "regelwerk", tidy_id(F.col("id")).alias("id"), "eingang", "zeile",
        canonical_hash(F.col("hash")).alias("_hash"), moments.day_or_raw(F.col("gueltig_bis")).alias("_tag"),
    )
    return changes(rows, ["regelwerk", "id"], "lieferung", ["eingang", "zeile"], [F.col("_hash"), F.col("_tag")], register)


def p1_bilanz(spark: SparkSession, folder: str) -> DataFrame:
    """Per delivery: how many versions appeared, vanished and changed."""
    return p1_found(spark, folder).groupBy("lieferung").agg(
        F.count_if(F.col("art") == "neu").alias("neu"),
        F.count_if(F.col("art") == "entfallen").alias("entfallen"),
        F.count_if(F.col("art") == "geaendert").alias("geaendert"),
    )
