"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.runtime import store_table

ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the least node around: the greater ones (large) or the lesser (small)."""
    other = F.when(F.col("u") < F.col("v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))) if large else F.array(F.coalesce(other, F.struct("u", "v")))
    around = edges.select(F.explode(sides).alias("e")).select("e.u", "e.v")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of the component, for every node but the roots themselves.

    ``links`` has long columns ``a`` and ``b``. The edge list never leaves the executors; each
    round is a written table, and a round that changes nothing is the last.
    """
    edges = store_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    before = mark(edges)
    for _ in range(ROUNDS):
        edges = store_table(_stars(_stars(edges, True), False))
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("the components did not settle")
