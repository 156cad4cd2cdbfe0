"""Factorisations of row matrices: QR, SVD, principal components, sampled similarities.

SVD and principal components come from a randomised range finder: a block of vectors, one number per
column each, is multiplied by AᵀA in one pass over the rows, and the driver holds as many such vectors as the
wanted components need, never a square over the columns. Everything with one row per matrix row stays
distributed. Sparse rows can be wider than the driver holds vectors for: their vectors stand on the driver over the
rows instead, one number per row each, and those over the columns in a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nodeloom.functions.vectors import ml_vectors, older_vectors
from nodeloom.operators import coo as coordinates
from nodeloom.operators.leading import BASIS_CELLS, NOISE, OVERSAMPLE, best_vectors, left_vectors, peak_signs, project, signed, turned
from nodeloom.operators.rowmatrix import CELLS_PER_BATCH, _block, check_width, column_means, local_square, multiply_local, square_of_rows, width
from nodeloom.runtime import cut_lineage

# Columns whose rest after taking out earlier columns is below this share of their length depend on those.
DEPENDENT = 1e-12


class Qr(NamedTuple):
    q: DataFrame | None
    r: np.ndarray


class Svd(NamedTuple):
    """``v`` is a table ``j, v`` for sparse rows, with the columns that store a position."""

    u: DataFrame | None
    s: np.ndarray
    v: np.ndarray | DataFrame


class Components(NamedTuple):
    """``vectors`` is a table ``j, v`` for sparse rows."""

    vectors: np.ndarray | DataFrame
    explained: np.ndarray


def positive_peak(v: np.ndarray) -> np.ndarray:
    """Signs that make the entry of largest magnitude of each column positive."""
    peak = v[np.argmax(np.round(np.abs(v), 9), axis=0), np.arange(v.shape[1])]
    return np.where(peak < 0, -1.0, 1.0)


def _row_matrix(rows: DataFrame, row: str) -> RowMatrix:
    return RowMatrix(older_vectors(ml_vectors(rows.select(row), row), row))


def sampled_entries(coo: DataFrame, threshold: float, n_cols: int, seed: int = 42) -> DataFrame:
    """The entries of ``i, j, v`` that take part in sampled cosines, scaled so that their Gramian estimates these.

    With gamma = 10 ln(n_cols) / threshold, an entry of a column of length ``|c|`` is kept with probability
    min(1, sqrt(gamma) / |c|) and divided by min(sqrt(gamma), |c|). Columns are first scaled to entries of at most
    1, which changes no cosine and bounds the error. The draw is a hash of position and ``seed``, so that a
    rerun and a recomputed task draw alike. Without a threshold all entries are kept.
    """
    stored = coordinates.drop_zeros(coordinates.summed(coo))
    peaks = stored.groupBy("j").agg(F.max(F.abs("v")).alias("peak"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    scaled = coordinates.join_columns(stored, peaks.select("j", "peak", (F.col("norm") / F.col("peak")).alias("norm")))
    root = F.lit(float("inf") if threshold <= 0 else float(np.sqrt(10 * np.log(max(n_cols, 2)) / threshold)))
    draw = F.shiftrightunsigned(F.xxhash64("i", "j", F.lit(seed)), 11).cast("double") / F.lit(float(2**53))
    kept = scaled.where(draw < root / F.col("norm"))
    return kept.select("i", "j", (F.col("v") / F.col("peak") / F.least(root, F.col("norm"))).alias("v"))


def similar_columns(rows: DataFrame, threshold: float, row: str = "row", index: str = "i", seed: int = 42) -> DataFrame:
    """Column cosines ``i < j`` by sampling; those above ``threshold`` are estimated well, pairs never drawn have no row.

    ``index`` numbers the rows, each with a number of its own.
    """
    entries = rows.select(F.col(index).alias("i"), F.posexplode(row).alias("j", "v"))
    return similar_columns_of(coordinates.coordinate_table(entries), threshold, width(rows, row), seed)


def similar_columns_of(coo: DataFrame, threshold: float, n_cols: int, seed: int = 42) -> DataFrame:
    """The same of a coordinate table."""
    return coordinates.upper_gramian(sampled_entries(coo, threshold, n_cols, seed)).where("i < j")


def _columns_in_order(r: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """R of the columns of ``r`` taken in order, with zero rows for those that depend on earlier ones, and the others' numbers."""
    n = r.shape[1]
    q, out, free = np.zeros((r.shape[0], n)), np.zeros((n, n)), []
    for j in range(n):
        rest, size = r[:, j].copy(), np.linalg.norm(r[:, j])
        for _ in range(2):
            part = q.T @ rest
            rest -= q @ part
            out[:, j] += part
        if size > 0 and np.linalg.norm(rest) > DEPENDENT * size:
            out[j, j] = np.linalg.norm(rest)
            q[:, j] = rest / out[j, j]
            free.append(j)
    return out, free


def qr(rows: DataFrame, row: str = "row", compute_q: bool = False) -> Qr:
    """QR of rows with a non-negative diagonal of R; Q keeps the other columns of ``rows``.

    A column that depends on earlier ones has a zero row in R and a zero column in Q: QR is the matrix at any rank,
    and QᵀQ the identity but for zeros there. Q is made in two passes, the second of which takes out what the
    first leaves of ill-conditioned columns.
    """
    n = width(rows, row)
    check_width(n)
    r, free = _columns_in_order(_row_matrix(rows, row).tallSkinnyQR(False).R.toArray())
    if not compute_q:
        return Qr(None, r)
    turn = np.zeros((n, n))
    at = np.ix_(free, free)
    turn[at] = np.linalg.inv(r[at])
    first = multiply_local(rows, turn, row)
    again = np.linalg.cholesky(local_square(square_of_rows(first, row, n), n)[at]).T
    turn[at] = np.linalg.inv(again)
    r[free] = again @ r[free]
    return Qr(multiply_local(first, turn, row), r)


def _apply_square(rows: DataFrame, q: np.ndarray, mean: np.ndarray | None, row: str) -> np.ndarray:
    """(A - 1 meanᵀ)ᵀ (A - 1 meanᵀ) q in one pass, without forming the difference: a rank-one correction."""
    n, k = q.shape
    spark = rows.sparkSession
    # The last line adds up the products themselves, for the correction.
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(q))
    offset = None if mean is None else mean @ q
    step = max(1, CELLS_PER_BATCH // n)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                x = _block(batch.column(0).slice(start, step), n)
                y = x @ shared.value
                y = y if offset is None else y - offset
                part = np.vstack([x.T @ y, y.sum(axis=0)])
                total = part if total is None else np.add(total, part, out=total)
        if total is not None:
            lines = max(1, CELLS_PER_BATCH // k)
            for start in range(0, n + 1, lines):
                part = total[start : start + lines]
                offsets = np.arange(0, part.size + 1, k, dtype=np.int32)
                ids = pa.array(np.arange(start, start + len(part), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, part.ravel())], names=["i", "part"])

    dense = rows.select(F.col(row).cast("array<double>").alias("row"))
    sums = dense.mapInArrow(accumulate, "i bigint, part array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    found = sums.select("i", vector_to_array("part").alias("part")).toArrow().combine_chunks()
    shared.destroy()
    out = np.zeros((n + 1, k))
    if found.num_rows:
        out[found["i"].to_numpy()] = found["part"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out[:n] if mean is None else out[:n] - np.outer(mean, out[n])


def range_finder(
    rows: DataFrame, k: int, row: str = "row", mean: np.ndarray | None = None, tolerance: float = 1e-11, max_passes: int = 100, n_cols: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of AᵀA, and their vectors, of rows less ``mean``.

    A block of vectors is multiplied by AᵀA in one pass over the rows; see :func:`nodeloom.operators.leading.best_vectors`.
    """
    n = width(rows, row) if n_cols is None else n_cols
    block = min(n, k + OVERSAMPLE)
    if n * block > BASIS_CELLS:
        raise ValueError(f"{k} components of {n} columns exceed {BASIS_CELLS} cells on the driver")
    return best_vectors(lambda q: _apply_square(rows, q, mean, row), n, k, block, BASIS_CELLS, tolerance, max_passes)


class _Columns(NamedTuple):
    """Sparse rows as the lists ``j, at, x`` of their columns; ``ids`` number the rows."""

    lists: DataFrame
    ids: np.ndarray
    index: pa.Array


def _columns(rows: DataFrame, row: str) -> _Columns:
    """From sparse rows with one id column beside them; several pieces of one row add up."""
    (key,) = [c for c in rows.columns if c != row]
    found = rows.select(F.col(key).alias("i")).distinct().orderBy("i").toArrow()["i"].combine_chunks()
    ids = np.arange(len(found), dtype=np.int32)
    numbers = rows.sparkSession.createDataFrame(pa.table({"i": found, "at": ids}))
    entries = coordinates.from_sparse_rows(rows.select(F.col(key).alias("i"), F.col(row).alias("row")))
    # A row without an id is a row too.
    placed = entries.alias("e").join(F.broadcast(numbers.alias("n")), F.col("e.i").eqNullSafe(F.col("n.i"))).select("j", "at", "v")
    lists = placed.groupBy("j").agg(F.collect_list(F.struct("at", F.col("v").alias("x"))).alias("e")).select("j", "e.at", "e.x")
    return _Columns(lists.persist(StorageLevel.MEMORY_AND_DISK), ids, found)


def _svd_of_sparse(rows: DataFrame, k: int, row: str, compute_u: bool, r_cond: float) -> Svd:
    columns = _columns(rows, row)
    (key,) = [c for c in rows.columns if c != row]
    s, u = left_vectors(columns.lists, len(columns.ids), min(k, len(columns.ids)), r_cond)
    v = cut_lineage(project(columns.lists, u / s if len(s) else u))
    columns.lists.unpersist()
    signs = peak_signs(v, len(s))
    v, u = turned(v, signs), u * signs
    if not compute_u or not len(s):
        return Svd(None, s, v)
    offsets = np.arange(0, u.size + 1, len(s), dtype=np.int32)
    left = pa.table({key: columns.index, row: pa.ListArray.from_arrays(offsets, pa.array(u.ravel()))})
    return Svd(rows.sparkSession.createDataFrame(left), s, v)


def _components_of_sparse(rows: DataFrame, k: int, row: str) -> Components:
    columns = _columns(rows, row)
    m = len(columns.ids)
    # Left vectors of the centred rows sum to zero, so that the mean row has no part in their product with the rows.
    s, u = left_vectors(columns.lists, m, min(k, m), NOISE, centred=True)
    v = cut_lineage(project(columns.lists, u / s if len(s) else u))
    plus = lambda a, b: a + b
    per = columns.lists.select(
        F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x).alias("squares"), F.aggregate("x", F.lit(0.0), plus).alias("total")
    )
    total = per.agg(F.sum(F.col("squares") - F.col("total") * F.col("total") / F.lit(float(max(m, 1))))).first()[0] or 0.0
    columns.lists.unpersist()
    explained = s * s / total if total > 0 else np.zeros(len(s))
    return Components(signed(v, len(s)), explained)


def _is_sparse(rows: DataFrame, row: str) -> bool:
    return isinstance(rows.schema[row].dataType, StructType)


def _width(rows: DataFrame, row: str) -> int:
    if not _is_sparse(rows, row):
        return width(rows, row)
    first = rows.select(f"{row}.size").first()
    return 0 if first is None else first[0]


def svd(rows: DataFrame, k: int, row: str = "row", compute_u: bool = False, r_cond: float = NOISE) -> Svd:
    """Leading ``k`` singular triplets, fewer when the matrix has lower rank.

    ``u`` keeps the other columns of ``rows``. The largest entry of each right vector is positive. Values up to
    ``r_cond`` times the largest are dropped. As they come from the square, a value below about 1e-8 of the
    largest holds rounding only: a smaller ``r_cond`` than the default may return such components. Sparse rows have
    one id column beside them, which ``u`` keeps, and may come in pieces.
    """
    n = _width(rows, row)
    if not 0 < k <= n:
        raise ValueError(f"k must lie between 1 and {n}")
    if _is_sparse(rows, row):
        return _svd_of_sparse(rows, k, row, compute_u, r_cond)
    values, v = range_finder(rows, k, row, n_cols=n)
    s = np.sqrt(values)
    keep = int(np.sum(s > r_cond * s[0])) if len(s) and s[0] > 0 else 0
    s, v = s[:keep], v[:, :keep]
    v = v * positive_peak(v) if keep else v
    u = multiply_local(rows, v / s, row) if compute_u and keep else None
    return Svd(u, s, v)


def principal_components(rows: DataFrame, k: int, row: str = "row") -> Components:
    """The ``k`` leading principal components as columns, largest entry positive, and their shares of the variance.

    Of sparse rows, as for :func:`svd`, those without variance are left out.
    """
    n = _width(rows, row)
    if not 0 < k <= n:
        raise ValueError(f"k must lie between 1 and {n}")
    if _is_sparse(rows, row):
        return _components_of_sparse(rows, k, row)
    count, mean, variance = column_means(rows, row)
    values, vectors = range_finder(rows, k, row, mean, n_cols=n)
    total = float(variance.sum()) * (count - 1)
    explained = values / total if total > 0 else np.zeros(k)
    return Components(vectors * positive_peak(vectors), explained)


def local_rows(spark, matrix: np.ndarray) -> DataFrame:
    """A small local factor as ``i, j, v``."""
    return coordinates.from_local(spark, matrix)


def triplets(result: Svd, spark) -> DataFrame:
    """``component, s`` of a factorisation, largest first and numbered from 1."""
    rows = [(n + 1, float(x)) for n, x in enumerate(result.s)]
    return spark.createDataFrame(rows, "component int, s double").select("component", F.col("s"))
