"""Near-duplicate embeddings by an exact metric range join.

Vectors are scaled to length one; two are near when their Euclidean distance is at most ``RADIUS``.
Equal vectors are one with a weight.  Pivots partition them: a vector's home is the cell of its nearest
pivot.  A pair with homes a and b is found in one of both cells, the lower if a + b is even, else the higher,
so a vector visits only cells that may hold such a partner.  What rules a cell out is the triangle
inequality, (d(v, other pivot) - d(v, own pivot)) / 2 above the radius, and in Euclidean space the distance
from the plane between the cell's pivot and the centre of the vector's next few pivots, which rules out more
(all of the cell lies beyond that plane, as all of it is nearer to its pivot than to each of those).

Vectors within half the radius of their pivot are its core.  By the triangle inequality they all are near
each other, which is counted, not compared; and only vectors within one and a half radii of the pivot are
compared with them.  So a group of near copies of any size takes linear work.  Everything else in a cell
is compared in blocks of a bounded number of rows, each a task of its own.  Pairs never leave a task: it
gives numbers of near rows, and edges that link the same vectors as its pairs.  Pivots, a few steps of
k-means over a bounded sample, change the speed only, never the result.

Defined results: null vectors, vectors with null or non-finite parts and zero vectors have no links and are
their own class; vectors of different dimension are never near; equal vectors are at distance zero; rows
with one vec_id are rows of their own; a null vec_id sorts first and may name a class;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import roots, scratch, side
from .components import components

RADIUS = 0.25
CELL = 4_000  # rows whose home a cell should be, about
BLOCK = 16_000  # rows on either side of a task
PIVOTS = 1024  # at most
SAMPLE = 20_000  # vectors from which pivots are made
NEXT = (1, 2, 4)  # pivots whose centre is set against a cell's
SLACK = 1e-5


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v (float32 of length one as bytes) and sig (hash of v) of every row, all three null where there is no direction."""
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("dim", T.IntegerType()), T.StructField("v", T.BinaryType())])

    def scale(batches):
        for b in batches:
            column = b.column(1)
            bounds = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False)  # nulls become NaN
            bounds = bounds - bounds[0]
            width = np.diff(bounds)
            blobs: list[bytes | None] = [None] * len(width)
            for d in np.unique(width[width > 0]).tolist():
                at = np.nonzero(width == d)[0]
                x = flat[bounds[at][:, None] + np.arange(d)]
                norm = np.sqrt((x * x).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                unit = (x[ok] / norm[ok][:, None] + 0.0).astype(np.float32)  # no negative zeros, so equal vectors have equal bytes
                for i, row in zip(at[ok].tolist(), unit, strict=True):
                    blobs[i] = row.tobytes()
            dims = pa.array([None if x is None else len(x) // 4 for x in blobs], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), dims, pa.array(blobs, pa.binary())], names=schema.names)

    e = F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>"))
    return vectors.select("vec_id", e.alias("e")).mapInArrow(scale, schema).withColumn("sig", F.unhex(F.md5("v")))


def pivots_of(x: np.ndarray, k: int, radius: float) -> np.ndarray:
    """Up to k pivots, every two more than two radii apart."""
    p = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(4):
        near = (x @ p.T).argmax(1)
        for j in range(len(p)):
            if (m := near == j).any():
                c = x[m].mean(0)
                p[j] = c / max(np.sqrt((c * c).sum()), 1e-12)
    order = np.argsort(-np.bincount((x @ p.T).argmax(1), minlength=len(p)), kind="stable")
    kept: list[int] = []
    for j in order.tolist():
        if all(((p[j] - p[i]) ** 2).sum() > (2 * radius + 4 * SLACK) ** 2 for i in kept):
            kept.append(j)
    return p[kept]


def cells_of(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of each vector, the cells that may hold its partners (its home among them), and distances from the pivots; all vectors of length one."""
    s = x @ p.T
    gram = p @ p.T
    order = np.argsort(-s, axis=1)[:, : max(NEXT)]
    home, mine = order[:, 0], np.arange(len(x))
    d = np.sqrt(np.maximum(2 - 2 * s, 0))
    bound = (d - d[mine, home][:, None]) / 2
    for m in NEXT:
        if m > order.shape[1]:
            break
        top = order[:, :m]
        apart = gram[top].mean(1)  # of the centre and each pivot, as a product
        length = np.take_along_axis(apart, top, 1).mean(1)
        away = np.sqrt(np.maximum(1 + length[:, None] - 2 * apart, 0))
        gap = np.take_along_axis(s, top, 1).mean(1)[:, None] - s
        bound = np.maximum(bound, np.where(away > 1e-6, gap / np.maximum(away, 1e-6), -1))
    near = bound <= radius + SLACK
    near[mine, home] = True
    return home, near, d


def found_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell of pairs with these homes."""
    return np.where((a + b) % 2 == 0, np.minimum(a, b), np.maximum(a, b))


CELLS = "dim int, cell int, part int, role int, sig binary, m bigint, v binary"


def _cells(df: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """Rows of a cell's parts, 0 the core and 1 the rest.  role 0: compared with; 1: compares, and has the cell as its home; 2: compares, from another cell."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)
    names = [c.split()[0] for c in CELLS.split(", ")]

    def assign(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.nonzero(dims == dim)[0]
                for lo in range(0, len(rows), 2048):
                    at = pa.array(rows[lo : lo + 2048])
                    own = b.take(at)
                    n = own.num_rows
                    all_, zero = np.arange(n), np.zeros(n, np.int64)
                    if dim not in sent.value:
                        parts = [(all_, zero, zero + 1, zero), (all_, zero, zero + 1, zero + 1)]
                    else:
                        p = sent.value[dim]
                        home, near, d = cells_of(_matrix(own.column(3)).astype(np.float64), p, radius)
                        core = d[all_, home] <= radius / 2 - SLACK
                        rest = np.nonzero(~core)[0]
                        close = d <= 1.5 * radius + SLACK
                        parts = [(np.nonzero(core)[0], home[core], zero[core], zero[core]), (rest, home[rest], zero[rest] + 1, zero[rest]), (rest, home[rest], zero[rest] + 1, zero[rest] + 1)]
                        i = rest[close[rest, home[rest]]]
                        parts.append((i, home[i], zero[i], zero[i] + 1))
                        i, c = np.nonzero(near)
                        away = (c != home[i]) & (found_in(home[i], c) == c)
                        i, c = i[away], c[away]
                        parts.append((i, c, np.ones(len(i), np.int64), np.full(len(i), 2)))
                        # A core takes part in whichever cell it would be found, so both sides of its pairs with other cores are asked.
                        near = close[i, c]
                        i, c = i[near], c[near]
                        parts.append((i, c, np.zeros(len(i), np.int64), np.full(len(i), 2)))
                    i, c, part, role = (np.concatenate(x) for x in zip(*parts, strict=True))
                    for s in range(0, len(i), 20_000):
                        k = slice(s, s + 20_000)
                        take = pa.array(i[k])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), dim, np.int32)), *(pa.array(y[k].astype(np.int32)) for y in (c, part, role)), *(own.column(j).take(take) for j in (1, 2, 3))], names=names)

    return df.select("dim", "sig", "m", "v").mapInArrow(assign, CELLS)


def _compare(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of rows of x and of y."""
    least = 1 - (radius + SLACK) ** 2 / 2 - 1e-5
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(x), 1024):
        a, b = np.nonzero(x[lo : lo + 1024] @ y.T >= least)
        a = a + lo
        ok = np.sqrt(((x[a].astype(np.float64) - y[b]) ** 2).sum(1)) <= radius
        out_a.append(a[ok]), out_b.append(b[ok])
    return np.concatenate(out_a), np.concatenate(out_b)


NEAR = "sig binary, links bigint, to binary"


def near_rows(distinct: DataFrame, radius: float, cell: int, block: int) -> DataFrame:
    """sig, links, to: for each vector numbers of rows near it, to be added up, and edges.  distinct: sig, dim, v, m."""
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).collect()}
    pivots = {}
    for dim, n in sizes.items():
        share = min(1.0, SAMPLE / n)
        rows = distinct.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("sig"), F.lit(1 << 20)) < share * (1 << 20))).select("sig", "v").orderBy("sig").limit(SAMPLE).toArrow()
        if rows.num_rows:
            pivots[dim] = pivots_of(_matrix(rows.column("v").combine_chunks()).astype(np.float64), min(PIVOTS, -(-n // cell)), radius)
    cells = scratch(_cells(distinct, pivots, radius), "cells")
    key = ["dim", "cell", "part"]
    core = scratch(cells.filter("part = 0 and role = 0").groupBy("dim", "cell").agg(F.sum("m").alias("n"), F.min("sig").alias("to")), "cores")
    sure = cells.filter("part = 0 and role = 0").select("dim", "cell", "sig", "m").join(side(core), ["dim", "cell"]).select("sig", (F.col("n") - F.col("m")).alias("links"), "to").filter("links > 0")
    # So many rows of either side that a task has about a block of each.
    of = lambda role: F.greatest(F.lit(1), F.ceil(F.count(F.when(role, 1)) / block)).cast("int")
    cuts = scratch(cells.groupBy(*key).agg(of(F.col("role") == 0).alias("kt"), of(F.col("role") > 0).alias("kq"), F.max("role").alias("most")).filter("most > 0").drop("most"), "cuts")
    df = cells.join(side(cuts), key)
    hashed = lambda k: F.pmod(F.xxhash64("sig"), F.col(k)).cast("int")
    own = F.col("role") == 0
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("kq")).otherwise(F.col("kt")) - 1)))
    df = df.select(*key, F.when(own, hashed("kt")).otherwise(F.col("other")).alias("t"), F.when(own, F.col("other")).otherwise(hashed("kq")).alias("q"), "role", "sig", "m", "v")
    kinds = pa.schema([("sig", pa.binary()), ("links", pa.int64()), ("to", pa.binary())])

    def join(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        role = t.column("role").to_numpy()
        order = np.argsort(role, kind="stable")
        t, role = t.take(pa.array(order)), role[order]
        n = int((role == 0).sum())
        if not n or n == len(role):
            return kinds.empty_table()
        x = _matrix(t.column("v").combine_chunks())
        m, sig = t.column("m").to_numpy(), t.column("sig").combine_chunks()
        name = np.frombuffer(b"".join(sig.to_pylist()), "V16")
        a, b = _compare(x[n:], x[:n], radius)
        a = a + n
        other = name[a] != name[b]
        a, b = a[other], b[other]
        links = np.bincount(a, m[b], len(x)).astype(np.int64)
        # A row of the rest that has this cell as its home asks for itself.
        back = (role[a] == 2) if t.column("part")[0].as_py() else np.ones(len(a), bool)
        links += np.bincount(b[back], m[a[back]], len(x)).astype(np.int64)
        root = roots(len(x), a, b)
        keep = np.unique(np.concatenate([a, b]))
        return pa.table([sig.take(pa.array(keep)), pa.array(links[keep]), sig.take(pa.array(root[keep]))], schema=kinds)

    return sure.union(df.groupBy(*key, "t", "q").applyInArrow(join, NEAR))


def near_vectors(vectors: DataFrame, radius: float = RADIUS, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, class_id (the lowest vec_id of those linked by near pairs, directly or through others), n_links (other rows near it) for every row."""
    rows = scratch(prepared(vectors.select("vec_id", "embedding")), "vectors")
    distinct = scratch(rows.filter("v is not null").groupBy("sig").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.count(F.lit(1)).alias("m")), "distinct")
    near = scratch(near_rows(distinct, radius, cell, block), "near")
    linked = components(near.select(F.col("sig").alias("a"), F.col("to").alias("b")))
    links = near.groupBy("sig").agg(F.sum("links").alias("links"))
    found = distinct.select("sig", "m").join(links, "sig", "left").join(linked, F.col("sig") == F.col("node"), "left")
    found = found.filter("m > 1 or links is not null").select("sig", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("label", "sig").alias("team"))
    found = scratch(found, "linked")
    name = rows.select("vec_id", "sig").join(side(found.select("sig", "team")), "sig").groupBy("team").agg(F.min(F.struct("vec_id")).alias("name"))
    found = scratch(found.join(name, "team").select("sig", "n", "name"), "classes")
    df = rows.select("vec_id", "sig").join(side(found), "sig", "left")
    return df.select("vec_id", F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("name.vec_id")).alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


SQL = f"""
with recursive n as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null),
u as (select vec_id, list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e)))::float::double) as e from n where list_dot_product(e, e) > 0),
p as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_distance(a.e, b.e) <= {RADIUS}),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, p.b from reach join p on reach.b = p.a),
c as (select a, min(b) as class_id from reach group by a),
l as (select a, count(*) as n_links from p group by a)
select c.a as vec_id, class_id, coalesce(n_links, 0)::bigint as n_links from c left join l using (a)"""
