"""Triangles and clustering coefficients on the undirected simple graph.

Each edge is oriented from the end of lower (degree, id) to the other. A node then has at most
``sqrt(2 * edges)`` later neighbours however many neighbours it has, so a list of them fits in
a row, and each triangle is found exactly once, at its lowest node.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.edges import simple_degrees, simple_edges
from nodeloom.operators.skew import HOT_ROWS, hot_keys, join_hot
from nodeloom.runtime import store_table

# Later neighbours of one node that a task expands at a time.
PIECE = 256


class Neighbours(NamedTuple):
    """The stored ``degrees`` (``nodeid, degree``) and ``lists`` (``x, later``) of a simple graph.

    ``hot`` are the nodes whose rows a join has to split, or None when there are none.
    """

    degrees: DataFrame
    lists: DataFrame
    hot: DataFrame | None


def hot_nodes(degrees: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    widest = degrees.agg(F.max("degree")).first()[0]
    if widest is None or widest <= hot_rows:
        return None
    return hot_keys(degrees, ["nodeid"], "degree", hot_rows)


def annotate_degrees(simple: DataFrame, degrees: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Add the degrees ``du``, ``dv`` of both ends to ``simple`` (``u, v`` and any other columns)."""
    out = simple
    for end, other in (("u", "v"), ("v", "u")):
        out = join_hot(
            out,
            degrees.select(F.col("nodeid").alias(end), F.col("degree").alias(f"d{end}")),
            [end],
            None if hot is None else hot.withColumnRenamed("nodeid", end),
            [F.col(other)],
        )
    return out.select(*simple.columns, "du", "dv")


def neighbour_degrees(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``nodeid, neighbour, neighbour_degree`` for both directions of each linked pair."""
    simple = simple_edges(edges)
    degrees = store_table(simple_degrees(simple))
    pairs = annotate_degrees(simple, degrees, hot_nodes(degrees, hot_rows))

    def seen(node: str, neighbour: str):
        return F.struct(
            F.col(node).alias("nodeid"),
            F.col(neighbour).alias("neighbour"),
            F.col(f"d{neighbour}").alias("neighbour_degree"),
        )

    return pairs.select(F.explode(F.array(seen("u", "v"), seen("v", "u"))).alias("n")).select("n.*")


def orient(annotated: DataFrame) -> DataFrame:
    """``x, y, dx, dy`` with ``x`` ranking below ``y`` by (degree, id), and any other columns."""
    forward = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))

    def pick(a: str, b: str):
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    return annotated.select(
        pick("u", "v").alias("x"),
        pick("v", "u").alias("y"),
        pick("du", "dv").alias("dx"),
        pick("dv", "du").alias("dy"),
        *[c for c in annotated.columns if c not in ("u", "v", "du", "dv")],
    )


def later_neighbours(oriented: DataFrame) -> DataFrame:
    """``x, later``: the higher-ranking neighbours of ``x`` in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct("dy", "y")))
    return oriented.groupBy("x").agg(ranked.alias("r")).select(
        "x", F.transform("r", lambda e: e["y"]).alias("later")
    )


def neighbours(simple: DataFrame, hot_rows: int = HOT_ROWS) -> Neighbours:
    """Store the degrees and later-neighbour lists of ``simple`` (``u, v``), which is read twice.

    Both tables have several readers; the lists cost two joins over all edges, so they are
    written once instead of being derived for each reader.
    """
    simple = simple.persist(StorageLevel.MEMORY_AND_DISK)
    degrees = store_table(simple_degrees(simple))
    hot = hot_nodes(degrees, hot_rows)
    lists = store_table(later_neighbours(orient(annotate_degrees(simple, degrees, hot))))
    simple.unpersist()
    return Neighbours(degrees, lists, hot)


def ordered_neighbour_lists(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``nodeid, degree, later`` for every node, with an empty list where nothing ranks higher."""
    found = neighbours(simple_edges(edges), hot_rows)
    return found.degrees.join(found.lists.withColumnRenamed("x", "nodeid"), "nodeid", "left").withColumn(
        "later", F.coalesce("later", F.array().cast("array<bigint>"))
    )


def wedge_candidates(lists: DataFrame, piece: int = PIECE) -> DataFrame:
    """``y, x, rest``: for each later neighbour ``y`` of ``x``, those ranking above ``y``.

    One row per oriented edge. The positions of a long list are handed out in pieces to
    different tasks before they are expanded.
    """
    last = F.size("later") - 2
    pieces = (
        lists.where(F.size("later") > 1)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(last / F.lit(piece)).cast("int"))))
        .repartition("x", "piece")
    )
    start = F.col("piece") * F.lit(piece)
    return (
        pieces.select("x", "later", start.alias("start"), F.posexplode(F.slice("later", start + 1, piece)).alias("at", "y"))
        .where(F.col("start") + F.col("at") + 1 < F.size("later"))
        .select("y", "x", F.slice("later", F.col("start") + F.col("at") + 2, F.size("later")).alias("rest"))
    )


def closed_wedges(found: Neighbours) -> DataFrame:
    """``x, y, closing``: the nodes that close a triangle over the oriented edge ``x, y``."""
    met = join_hot(
        wedge_candidates(found.lists),
        found.lists.select(F.col("x").alias("y"), F.col("later").alias("later_y")),
        ["y"],
        None if found.hot is None else found.hot.withColumnRenamed("nodeid", "y"),
        [F.col("x")],
    )
    return met.select("x", "y", F.array_intersect("rest", "later_y").alias("closing")).where(
        F.size("closing") > 0
    )


def triangles(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row ``x, y, z`` per triangle, in rank order."""
    closed = closed_wedges(neighbours(simple_edges(edges), hot_rows))
    return closed.select("x", "y", F.explode("closing").alias("z"))


def _count_triangles(closed: DataFrame) -> DataFrame:
    def credit(node, n):
        return F.struct(node.alias("nodeid"), n.cast("bigint").alias("n"))

    shares = F.concat(
        F.array(credit(F.col("x"), F.size("closing")), credit(F.col("y"), F.size("closing"))),
        F.transform("closing", lambda z: credit(z, F.lit(1))),
    )
    return (
        closed.select(F.explode(shares).alias("s"))
        .groupBy(F.col("s.nodeid").alias("nodeid"))
        .agg(F.sum("s.n").alias("triangles"))
    )


def triangle_counts(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``nodeid, triangles`` for the nodes of at least one triangle."""
    return _count_triangles(closed_wedges(neighbours(simple_edges(edges), hot_rows)))


def local_clustering(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``nodeid, degree, triangles, cc``; nodes of no triangle have ``cc`` 0."""
    found = neighbours(simple_edges(edges), hot_rows)
    degrees, counted = found.degrees, _count_triangles(closed_wedges(found))
    pairs = F.lit(0.5) * F.col("degree") * (F.col("degree") - 1)
    return (
        degrees.join(counted, "nodeid", "left")
        .withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("bigint")))
        .withColumn("cc", F.when(F.col("degree") < 2, 0.0).otherwise(F.col("triangles") / pairs))
    )


def average_clustering(lcc: DataFrame) -> DataFrame:
    """One row: the sum of ``cc`` over the largest node id, and its mean over the nodes."""
    return lcc.agg(
        (F.sum("cc") / F.max("nodeid")).alias("avg_cc"), F.avg("cc").alias("mean_cc")
    )
