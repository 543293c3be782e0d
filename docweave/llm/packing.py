"""Best-fit packing of documents into sequences of a fixed number of words, by linear grouping.

Documents fall into shards by a hash; each shard is packed by itself, so that the work spreads and
a shard fits a task whatever the corpus.  In a shard: lengths of at least ``SMALL`` of the capacity
are large.  The large ones, in order of length, form groups of equal cardinality and are rounded up
to the longest of their group, which leaves few sizes.  The configuration LP over these sizes is
solved by column generation, its whole part becomes bins, and the rest is packed best-fit.  Actual
documents then take the places of the rounded ones, and small documents fill what is left, each
into the fullest bin where it fits.

Defined results: a document longer than the capacity is cut into full pieces and a remainder, so
none is dropped; null, empty and blank texts have no words and come out with a null bin; repeated
rows are packed once each; ties go by doc_id (null first); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
SMALL = 0.125
GROUPS = 24
SHARD_DOCS = 20_000
EPS = 1e-9
TASKS = 20_000


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth that fits: an unbounded knapsack over whole lengths."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = [i for i in range(len(sizes)) if worth[i] > EPS]
    least = int(sizes.min())
    own, val = sizes[order], worth[order]
    for room in range(least, capacity + 1):
        best[room] = best[room - 1]
        fit = own <= room
        if fit.any():
            got = np.where(fit, best[room - np.where(fit, own, 0)] + val, -1.0)
            i = int(got.argmax())
            if got[i] > best[room] + EPS:
                best[room], pick[room] = got[i], order[i]
    made, room = np.zeros(len(sizes), int), capacity
    while room >= least:
        if pick[room] < 0:
            room -= 1
        else:
            made[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), made


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """An optimal basis of the configuration LP: minimise bins so that every size gets its demand (revised simplex, columns priced by knapsack)."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    # With demands that are a little off no step stands still, so no basis comes twice and the loop ends by itself.
    target, last = demand + 1e-6 * np.arange(1, k + 1), np.inf
    while True:
        x = np.linalg.solve(basis, target)
        if x.sum() >= last:
            break  # as good as numbers of this precision get
        last = x.sum()
        duals = np.linalg.solve(basis.T, np.ones(k))
        worth, column = _knapsack(sizes, duals, capacity)
        if worth <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(way > EPS, np.maximum(x, 0) / np.where(way > EPS, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k)]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length (all between 1 and the capacity)."""
    n = len(lengths)
    bins = np.full(n, -1, np.int64)
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths >= SMALL * capacity).sum())
    large, small = order[:n_large], order[n_large:]
    room: list[int] = []
    if n_large:
        groups = [g for g in np.array_split(large, min(GROUPS, n_large)) if len(g)]
        tops = np.array([int(lengths[g[0]]) for g in groups])
        sizes, which = np.unique(tops, return_inverse=True)
        waiting: list[list[int]] = [[] for _ in sizes]
        for g, j in zip(groups, which, strict=True):
            waiting[j].extend(g.tolist())
        demand = np.array([len(w) for w in waiting])
        for column, times in configurations(sizes, demand, capacity):
            for _ in range(int(times + EPS)):
                members = [waiting[j].pop() for j in np.nonzero(column)[0] for _ in range(min(column[j], len(waiting[j])))]
                if members:
                    bins[members] = len(room)
                    room.append(capacity - int(lengths[members].sum()))
        # What the whole part leaves over: best fit of the actual lengths, longest first.
        rest = sorted((i for w in waiting for i in w), key=lambda i: (-lengths[i], i))
        small = np.concatenate([np.array(rest, np.int64), small]) if rest else small
    free = sorted((r, b) for b, r in enumerate(room))
    for i in small:
        need = int(lengths[i])
        at = bisect_left(free, (need, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        if r > need:
            insort(free, (r - need, b))
    return bins


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """bin_id, doc_id, piece, start (in words), n_words: for every piece of every document."""
    shards = max(1, -(-docs.count() // shard_docs))
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    src = docs.select("doc_id", F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(words), F.lit(0)).cast("bigint").alias("n"))
    src = src.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("doc_id", id_type), T.StructField("piece", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())])

    def one(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("n", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
        n = table.column("n").to_numpy()
        shard = table.column("shard")[0].as_py()
        pieces = np.maximum(-(-n // capacity), 1)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(n[doc] - piece * capacity, capacity)
        held = np.nonzero(length > 0)[0]
        bins = np.full(len(doc), -1, np.int64)
        bins[held] = pack(length[held], capacity) + (shard << 32)
        return pa.table({"bin_id": pa.array(bins, pa.int64(), mask=bins < 0), "doc_id": table.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int64()), "start": pa.array(piece * capacity, pa.int64()), "n_words": pa.array(length, pa.int64())})

    # The number of partitions is given, else small rows would end up in a few tasks.
    return src.repartition(min(shards, TASKS), "shard").groupBy("shard").applyInArrow(one, schema)
