"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import drop_scratch, scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    hub = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(hub, both["a"] == hub["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    hub = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = down.join(hub, down["a"] == hub["u"]).select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("m")), F.struct(F.col("b").alias("v"), F.col("m")))).alias("x"))
    return moved.select(F.col("x.v").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that it is linked with) for every node of edges (a, b); edges from a node to itself don't count.

    Each round ends in a table of the shared folder, so lineage stays short; it stops when a round changes nothing.
    """
    e = scratch(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    mark = None
    while True:
        new = scratch(_small(_large(e)), "edges")
        drop_scratch(e)
        e = new
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == (r["n"], r["h"]):
            break
        mark = (r["n"], r["h"])
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b").distinct())
