"""Leading singular vectors of coordinate tables and of a graph's adjacency matrix.

Where one side is at most ``dense_side`` long, the square over that side is summed in the tasks and decomposed on the
driver. Where the vectors of the shorter side still fit the driver, they come from passes over the lists of the longer
one. Beyond that a block Lanczos process takes a distributed basis of any size over the shorter side. The long side is never collected. A
``dense_side`` of 0 always takes the process.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators import rotations
from nodeloom.operators.coo import Shape, summed
from nodeloom.operators.edges import extremes, needs_flip, reverse_edges
from nodeloom.operators.lanczos import MAX_WIDTH, block_lanczos
from nodeloom.operators.leading import NOISE, fits, left_vectors, project, signed
from nodeloom.operators.rowmatrix import MAX_DENSE
from nodeloom.runtime import cut_lineage

COMPONENTS = 10
# Most components of the Lanczos process: its basis has room for a block of them and for the best of twice as many.
MOST = MAX_WIDTH // 4


class RightVectors(NamedTuple):
    """Singular values, and ``j, v`` with one array entry per value for the columns that store a position."""

    s: np.ndarray
    v: DataFrame


def _from_lists(lists: DataFrame, m: int, k: int, dense_side: int) -> RightVectors:
    """From the columns as lists ``j, at, x`` over a short row side of length ``m``."""
    lists = lists.persist(StorageLevel.MEMORY_AND_DISK)
    s, u = left_vectors(lists, m, k, NOISE, dense_side=dense_side)
    v = signed(cut_lineage(project(lists, u / s if len(s) else u)), len(s))
    lists.unpersist()
    return RightVectors(s, v)


def _short(side: int, k: int, dense_side: int) -> bool:
    """Whether the vectors of a side may stand on the driver; a ``dense_side`` of 0 says that none may."""
    return side <= dense_side or (dense_side > 0 and fits(side, k))


def right_vectors(coo: DataFrame, dims: Shape, k: int, dense_side: int = MAX_DENSE) -> RightVectors:
    """Leading ``k`` right singular vectors of a coordinate table, fewer at lower rank.

    With a side of at most ``dense_side`` they are taken from the square over that side, and with one whose vectors
    fit the driver from passes over the other side.
    """
    if not 0 < k <= dims.cols:
        raise ValueError(f"k must lie between 1 and {dims.cols}")
    if not _short(min(dims), k, dense_side):
        if k > MOST:
            return RightVectors(*rotations.right_vectors(summed(coo), dims.rows, dims.cols, k, NOISE))
        return _from_process(summed(coo), dims, k)

    def lists(by: str, at: str) -> DataFrame:
        entries = F.collect_list(F.struct(F.col(at).cast("int").alias("at"), F.col("v").alias("x")))
        return coo.groupBy(F.col(by).alias("j")).agg(entries.alias("e")).select("j", "e.at", "e.x")

    if dims.rows <= dims.cols:
        return _from_lists(lists("j", "i"), dims.rows, k, dense_side)
    held = lists("i", "j").persist(StorageLevel.MEMORY_AND_DISK)
    s, v = left_vectors(held, dims.cols, k, NOISE, dense_side=dense_side)
    held.unpersist()
    offsets = np.arange(0, v.size + 1, max(v.shape[1], 1), dtype=np.int32) if v.size else np.zeros(dims.cols + 1, dtype=np.int32)
    cells = pa.table({"j": np.arange(dims.cols), "v": pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))})
    return RightVectors(s, signed(coo.sparkSession.createDataFrame(cells), len(s)))


def _from_process(coo: DataFrame, dims: Shape, k: int) -> RightVectors:
    """From a basis over the shorter side: with fewer rows the process takes the left vectors, and A turns them into the right ones."""
    if dims.rows >= dims.cols:
        found = block_lanczos(coo, k, noise=NOISE**2)
        return RightVectors(np.sqrt(found.values), signed(found.vectors, len(found.values)))
    found = block_lanczos(coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), k, noise=NOISE**2)
    s = np.sqrt(found.values)
    if not len(s):
        return RightVectors(s, found.vectors)
    by = F.array(*[F.lit(float(1 / x)) for x in s])
    lines = coo.join(found.vectors.select(F.col("j").alias("i"), F.col("v").alias("u")), "i").select(
        "j", F.zip_with("u", by, lambda u, x: u * x * F.col("v")).alias("line")
    )
    sums = lines.groupBy("j").agg(Summarizer.sum(array_to_vector("line")).alias("line"))
    return RightVectors(s, signed(cut_lineage(sums.select("j", vector_to_array("line").alias("v"))), len(s)))


def svd_embedding(edges: DataFrame, k: int = COMPONENTS, dense_side: int = MAX_DENSE) -> DataFrame:
    """``nodeid, v_1 .. v_k``: right singular vectors of the binary adjacency matrix.

    The longer side of the matrix is its columns (edges are reversed for that when needed), and
    every column has a row, those without an entry all zero. Components beyond the rank are
    NULL; beyond the number of columns likewise.
    """
    found = extremes(edges, "src", "dst").first()
    names = [f"v_{c}" for c in range(1, k + 1)]
    if found.max_src is None:
        return edges.select(F.col("src").alias("nodeid"), *[F.lit(None).cast("double").alias(n) for n in names])
    if found.min_src <= 0 or found.min_dst <= 0:
        raise ValueError("node ids of an adjacency matrix must be positive")
    m, n = found.max_src, found.max_dst
    if needs_flip(m, n):
        edges, m, n = reverse_edges(edges), n, m
    wanted = min(n, k)
    if _short(m, wanted, dense_side):
        at = F.collect_set((F.col("src") - 1).cast("int"))
        lists = (
            edges.groupBy((F.col("dst") - 1).alias("j"))
            .agg(at.alias("at"))
            .withColumn("x", F.array_repeat(F.lit(1.0), F.size("at")))
        )
        s, v = _from_lists(lists, m, wanted, dense_side)
    else:
        coo = edges.select((F.col("src") - 1).alias("i"), (F.col("dst") - 1).alias("j")).distinct()
        s, v = _from_process(coo.withColumn("v", F.lit(1.0)), Shape(m, n), wanted)
    held = len(s)
    columns = [
        (F.coalesce(F.get("v", F.lit(c)), F.lit(0.0)) if c < held else F.lit(None).cast("double")).alias(name)
        for c, name in enumerate(names)
    ]
    ids = edges.sparkSession.range(1, n + 1).select(F.col("id").alias("nodeid"))
    return ids.join(v.select((F.col("j") + 1).alias("nodeid"), "v"), "nodeid", "left").select("nodeid", *columns)
