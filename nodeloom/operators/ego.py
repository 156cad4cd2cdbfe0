"""Size and edge count of every node's ego net, without building any ego net.

The edges of a node's ego net are its own rows and, per triangle, the rows of the pair opposite to it. The lists
of later neighbours carry how many rows each pair has, so that a list and the rest of another are intersected
together with these numbers: a task adds up what each node gets, and no triangle is joined or leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.clustering import PIECE, annotate_degrees, hot_nodes, orient
from nodeloom.operators.skew import HOT_ROWS, join_hot
from nodeloom.runtime import store_table


def ego_nets(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``nodeid, ego_size, ego_edges`` for every end of a cleaned edge table."""
    counted = (
        edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    # Degrees and rows of the nodes from one shuffle of the ends.
    ends = F.array(F.struct(F.col("u").alias("nodeid"), "copies"), F.struct(F.col("v").alias("nodeid"), "copies"))
    held = counted.select(F.explode(ends).alias("e")).groupBy("e.nodeid")
    nodes = store_table(held.agg(F.count(F.lit(1)).alias("degree"), F.sum("e.copies").alias("own")))
    degrees = nodes.select("nodeid", "degree")
    hot = hot_nodes(degrees, hot_rows)
    lists = store_table(counted_neighbours(orient(annotate_degrees(counted, degrees, hot))))
    counted.unpersist()

    met = join_hot(
        wedges(lists),
        lists.select(F.col("x").alias("y"), F.col("later").alias("later_y"), F.col("counts").alias("counts_y")),
        ["y"],
        None if hot is None else hot.withColumnRenamed("nodeid", "y"),
        [F.col("x")],
    )
    columns = ("x", "y", "own", "rest", "rest_counts", "later_y", "counts_y")
    credits = met.select(*columns).mapInArrow(_opposite_rows, "nodeid bigint, among bigint")
    among = credits.groupBy("nodeid").agg(F.sum("among").alias("among"))
    return (
        nodes.join(among, "nodeid", "left")
        .select(
            "nodeid",
            (F.col("degree") + 1).alias("ego_size"),
            (F.col("own") + F.coalesce("among", F.lit(0))).cast("bigint").alias("ego_edges"),
        )
    )


def counted_neighbours(oriented: DataFrame) -> DataFrame:
    """``x, later, counts``: the higher-ranking neighbours of ``x`` in rank order, with the rows of each pair."""
    ranked = F.array_sort(F.collect_list(F.struct("dy", "y", "copies")))
    return oriented.groupBy("x").agg(ranked.alias("r")).select("x", F.col("r.y").alias("later"), F.col("r.copies").alias("counts"))


def wedges(lists: DataFrame, piece: int = PIECE) -> DataFrame:
    """``y, x, own, rest, rest_counts``: per oriented edge its rows, and the neighbours of ``x`` above ``y`` with theirs.

    The positions of a long list are handed out in pieces to different tasks before they are expanded.
    """
    last = F.size("later") - 2
    pieces = (
        lists.where(F.size("later") > 1)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(last / F.lit(piece)).cast("int"))))
        .repartition("x", "piece")
    )
    start = F.col("piece") * F.lit(piece)
    part = F.arrays_zip(F.slice("later", start + 1, piece).alias("y"), F.slice("counts", start + 1, piece).alias("own"))
    opened = pieces.select("x", "later", "counts", start.alias("start"), F.posexplode(part).alias("at", "e"))
    rest = lambda column: F.slice(column, F.col("start") + F.col("at") + 2, F.size("later"))
    return opened.where(F.col("start") + F.col("at") + 1 < F.size("later")).select(
        F.col("e.y").alias("y"), "x", F.col("e.own").alias("own"), rest("later").alias("rest"), rest("counts").alias("rest_counts")
    )


def _opposite_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``nodeid, among``: the rows opposite to each node over all triangles of a batch of wedges."""

    def flat(lists: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        held = [x.flatten().to_numpy(zero_copy_only=False) for x in (lists, counts)]
        return np.repeat(np.arange(len(sizes)), sizes), *held

    for batch in batches:
        x, y, own = (batch.column(k).to_numpy() for k in range(3))
        a_row, a_node, a_rows = flat(batch.column(3), batch.column(4))
        b_row, b_node, b_rows = flat(batch.column(5), batch.column(6))
        nodes, code = np.unique(np.concatenate([a_node, b_node]), return_inverse=True)
        a_key = a_row * len(nodes) + code[: len(a_node)]
        b_key = b_row * len(nodes) + code[len(a_node) :]
        _, in_a, in_b = np.intersect1d(a_key, b_key, assume_unique=True, return_indices=True)
        if not len(in_a):
            continue
        row = a_row[in_a]
        # Opposite to x lies the pair y, z; to y the pair x, z; to z the pair x, y.
        gets = np.concatenate([x[row], y[row], a_node[in_a]])
        rows = np.concatenate([b_rows[in_b], a_rows[in_a], own[row]])
        found, place = np.unique(gets, return_inverse=True)
        sums = np.zeros(len(found), dtype=np.int64)
        np.add.at(sums, place, rows)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums)], names=["nodeid", "among"])
