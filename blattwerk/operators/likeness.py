"""How many sets each set is alike to (Jaccard above 0.7), counted without listing the pairs.

Two sets of a and b elements are alike if they have at least o = 7(a + b) // 17 + 1 common ones. Every set of up to ``most``
elements puts out its subsets that large; a subset of s elements that two sets share counts for them with the sign and weight of
inclusion and exclusion, (-1)^(s - o) C(s - 1, o - 1), so that a pair with c common elements comes to 1 if c >= o, else to 0.
What is done grows with the sets, however many are alike. Subsets are made in numpy and never shuffled: a set goes once to each
element that may be the first of such a subset, in an order that has the frequent ones last. Sets that still share a
subset of frequent elements only differ in their rare ones, so those subsets are made once per distinct rest, with its weight.

Elements are 64-bit hashes and subsets the sums of theirs, compared a few million at a time: the odds of a false equality are under
one in a million for each four million subsets.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Subsets that are compared at a time, and sets at most (or a hundredth of all, if that is more) that share a first element.
AT_ONCE, RARE, RARE_MOST = 4_000_000, 5_000, 500_000


def least_common(a: int, b: int) -> int:
    """The common elements from which sets of a and b elements are alike."""
    return 7 * (a + b) // 17 + 1


def _sizes(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest subset that a set of k elements needs, and the weights by s, a, b."""
    least, weight = np.arange(most + 1), np.zeros((most + 1,) * 3)
    for a in range(3, most + 1):
        for b in range(3, most + 1):
            o = least_common(a, b)
            if o <= min(a, b):
                least[a] = min(least[a], o)
                for s in range(o, min(a, b) + 1):
                    weight[s, a, b] = (-1) ** (s - o) * comb(s - 1, o - 1)
    return least, weight


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of the column w."""
    lengths = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column("w").flatten().to_numpy().view(np.uint64), np.cumsum(lengths) - lengths, lengths


def _batch(ids: pa.Array, parts: list[tuple]) -> pa.RecordBatch:
    """Rows from parts (rows, keys, k, how many elements are in every subset, weights, matrix of elements)."""
    column = lambda i, kind: pa.array(np.concatenate([np.broadcast_to(np.asarray(p[i], kind), len(p[0])) for p in parts]))
    lengths = np.concatenate([np.full(len(p[0]), p[5].shape[1]) for p in parts])
    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate([p[5].ravel() for p in parts]).view(np.int64)))
    keys = pa.array(np.concatenate([p[1] for p in parts]).view(np.int64))
    return pa.RecordBatch.from_arrays([keys, ids.take(column(0, np.int64)), column(2, np.int32), column(3, np.int32), column(4, np.int64), words], ["t", "klasse", "k", "fest", "n", "w"])


def _placing(frequent: list[int], most: int, rest: bool):
    """Sets to rows by their rare first elements; with ``rest``, to their frequent elements where a subset may have no other."""
    least, _ = _sizes(most)
    ids = np.array(frequent, np.int64).view(np.uint64)
    by_id = np.argsort(ids)
    known, rank_of = ids[by_id], by_id + 1

    def run(batches):
        for batch in batches:
            values, starts, lengths = _lists(batch)
            parts = []
            for k in np.unique(lengths):
                rows, spare = np.flatnonzero(lengths == k), k - least[k]
                w = np.sort(values[starts[rows][:, None] + np.arange(k)], axis=1)
                rank = np.zeros(w.shape, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    rank = np.where(known[at] == w, rank_of[at], 0)
                    w = np.take_along_axis(w, np.argsort(rank, axis=1, kind="stable"), axis=1)
                rare = (rank == 0).sum(axis=1)
                for p in range(spare + 1):
                    own = rare == p if rest else rare > p
                    if own.any():
                        parts.append((rows[own], w[own, min(p, k - 1)], k, 1, 1, w[own, p:]))
            if parts:
                yield _batch(batch.column("klasse"), parts)

    return run


def _pairing(most: int):
    """Rests of frequent elements to rows by their first two."""
    least, _ = _sizes(most)

    def run(batches):
        for batch in batches:
            values, starts, lengths = _lists(batch)
            k, n = batch.column("k").to_numpy(), batch.column("n").to_numpy()
            parts = []
            for size, m in {*zip(k.tolist(), lengths.tolist())}:
                rows = np.flatnonzero((k == size) & (lengths == m))
                w = values[starts[rows][:, None] + np.arange(m)]
                for q in range(1, m - least[size] + 2):  # from q on, and one before, are enough elements
                    for p in range(q):
                        parts.append((rows, w[:, p] * np.uint64(0x9E3779B97F4A7C15) + w[:, q], size, 2, n[rows], np.concatenate([w[:, p : p + 1], w[:, q:]], axis=1)))
            if parts:
                yield _batch(batch.column("klasse"), parts)

    return run


def _counting(most: int, at_once: int):
    """Rows in the order of t to (klasse, n): how many are alike by the subsets that begin as t says."""
    least, weight = _sizes(most)

    def made(size: int, fixed: int, m: int) -> int:
        return sum(comb(m - fixed, m - s) for s in range(max(least[size], fixed), m + 1))

    def cost(table: pa.RecordBatch) -> int:
        shapes, n = np.unique(np.stack([table.column("k").to_numpy(), table.column("fest").to_numpy(), _lists(table)[2]]), axis=1, return_counts=True)
        return sum(int(x) * made(*shape) for shape, x in zip(shapes.T.tolist(), n))

    def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]

    def counted(table: pa.RecordBatch) -> pa.RecordBatch:
        values, starts, lengths = _lists(table)
        k, fixed, n = (table.column(c).to_numpy() for c in ("k", "fest", "n"))
        total = np.zeros(len(k), np.int64)
        # elements that no other row of the same t has are in no subset that two share
        t, row = table.column("t").to_numpy(), np.repeat(np.arange(len(k)), lengths)
        _, at, times = np.unique(values + t.view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
        kept = (times[at] > 1) | (n[row] > 1)
        lengths = np.where(kept[starts] & kept[starts + fixed - 1], np.bincount(row, kept, len(k)).astype(np.int64), 0)  # else the row is alone
        values = values[kept & (lengths > 0)[row]]
        starts = np.cumsum(lengths) - lengths
        shapes = np.unique(np.stack([k, fixed, lengths]), axis=1).T.tolist()
        blocks = []
        for size, f, m in shapes:
            if m < max(least[size], f):
                continue
            rows = np.flatnonzero((k == size) & (fixed == f) & (lengths == m))
            w = np.ascontiguousarray(values[starts[rows][:, None] + np.arange(m)].T)
            blocks.append((size, f, m, rows, w, w.sum(axis=0)))
        for s in range(3, most + 1):
            fit = [b for b in blocks if max(least[b[0]], b[1]) <= s <= b[2]]
            slices = sum(len(b[3]) * comb(b[2] - b[1], b[2] - s) for b in fit) // at_once + 1
            for z in range(slices):
                sums, whose = [], []
                for _, f, m, rows, w, whole in fit:
                    for without in combinations(range(f, m), m - s):
                        x, r = whole.copy(), rows
                        for i in without:
                            x -= w[i]
                        if slices > 1:
                            mine = (x >> np.uint64(20)) % np.uint64(slices) == z
                            x, r = x[mine], r[mine]
                        sums.append(x)
                        whose.append(r)
                if not sums:
                    continue
                x, r = np.concatenate(sums), np.concatenate(whose)
                order = np.argsort(x)
                x, r = x[order], r[order]
                same = x[1:] == x[:-1]
                shared = n[r] > 1
                shared[1:] |= same
                shared[:-1] |= same
                x, r = x[shared], r[shared]
                if not len(x):
                    continue
                group = np.cumsum(np.concatenate([[0], x[1:] != x[:-1]]))
                held = np.bincount(group * (most + 1) + k[r], weights=n[r], minlength=(group[-1] + 1) * (most + 1)).reshape(-1, most + 1)
                np.add.at(total, r, ((held @ weight[s].T)[group, k[r]] - weight[s][k[r], k[r]]).astype(np.int64))
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([table.column("klasse").take(pa.array(some)), pa.array(total[some])], ["klasse", "n"])

    def run(batches):
        held, due, limit = [], 0, at_once
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            due += cost(batch)
            if due >= limit:
                table = joined(held)
                t = table.column("t").to_numpy()
                last = int(np.searchsorted(t, t[-1]))  # the rows of the last t may go on
                if last:
                    yield counted(table.slice(0, last))
                held = [table.slice(last)]
                due = cost(held[0])
                limit = max(at_once, 2 * due)
        if held:
            yield counted(joined(held))

    return run


def alike_counts(sets: DataFrame, rare: int | None = None, most: int = 16) -> DataFrame:
    """(klasse, n) from (klasse, w), w the distinct hashes of a set: parts of how many other sets it is alike to, to be added up.

    Only sets of 3 to ``most`` elements count. ``rare``: an element in more sets is a frequent one; only these are collected,
    which are at most a hundred times as many as a set has elements, or one per 500,000 elements.
    """
    sets = sets.where(F.size("w").between(3, most) & F.col("klasse").isNotNull())
    kind = sets.schema["klasse"].dataType.simpleString()
    rows, out = f"t bigint, klasse {kind}, k int, fest int, n bigint, w array<bigint>", f"klasse {kind}, n bigint"
    if rare is None:
        rare = max(RARE, min(sets.count() // 100, RARE_MOST))
    words = sets.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > rare)
    frequent = [r.t for r in words.orderBy("n", "t").collect()]
    count = lambda placed: placed.repartition("t").sortWithinPartitions("t").mapInArrow(_counting(most, AT_ONCE), out)
    found = count(sets.mapInArrow(_placing(frequent, most, False), rows))
    if not frequent:
        return found
    rests = sets.mapInArrow(_placing(frequent, most, True), rows).select("klasse", "k", "w")
    distinct = rests.groupBy("k", "w").agg(F.min("klasse").alias("klasse"), F.count("*").alias("n"))
    weighed = count(distinct.mapInArrow(_pairing(most), rows)).groupBy("klasse").agg(F.sum("n").alias("n"))
    sizes = distinct.select("k", "w", "klasse").join(weighed, "klasse").select("k", "w", "n")
    return found.unionByName(rests.join(sizes, ["k", "w"]).select("klasse", "n"))
