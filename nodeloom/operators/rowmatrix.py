"""Matrices as dense rows: ``row ARRAY<DOUBLE>`` with any id columns beside it.

Squares, covariances and cosines also take sparse rows (``i``, ``row`` with ``indices`` and ``values``), in pieces or
whole, and go by their entries alone (:mod:`nodeloom.operators.squares`).

Products of columns are accumulated block-wise inside each task (one matrix product per Arrow
batch), so a Gramian shuffles no pair of entries. Its upper triangle is cut into bands of rows of
at most ``BAND_CELLS`` cells; a task accumulates one band, however many columns there are, and
reads only the columns from the band on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nodeloom.operators import squares
from nodeloom.operators.coo import Shape, column_sums, from_sparse_rows, mirror_upper

# Widest matrix whose square may stand on the driver: 4096 * 4096 doubles are 128 MiB.
MAX_DENSE = 4096
# Cells of the upper triangle that a task accumulates, those it multiplies at a time, and the longest array of a result.
BAND_CELLS = 16_777_216
CELLS_PER_BATCH = 1_000_000
PIECE = 8_192
# Most cells of a local matrix that is sent to every task.
MAX_LOCAL = 16_777_216


def check_width(n: int) -> None:
    """For squares on the driver only."""
    if n > MAX_DENSE:
        raise ValueError(f"a square of {n} columns exceeds {MAX_DENSE} on the driver")


def width(rows: DataFrame, row: str = "row") -> int:
    """Number of columns: the size of the first row."""
    first = rows.select((F.col(f"{row}.size") if is_sparse(rows, row) else F.size(row)).alias("n")).first()
    return 0 if first is None else first.n


def is_sparse(rows: DataFrame, row: str = "row") -> bool:
    return isinstance(rows.schema[row].dataType, StructType)


def _entries(rows: DataFrame, row: str, index: str) -> DataFrame:
    return from_sparse_rows(rows.select(F.col(index).alias("i"), F.col(row).alias("row")))


def shape(rows: DataFrame, row: str = "row", index: str | None = None, n_rows: int | None = None, n_cols: int | None = None) -> Shape:
    """Rows are counted, or with ``index`` the largest index plus one; a given number wins."""
    if n_rows is None:
        count = F.count(F.lit(1)) if index is None else F.max(index) + 1
        n_rows = rows.agg(count.alias("n")).first().n or 0
    return Shape(n_rows, width(rows, row) if n_cols is None else n_cols)


def _block(column: pa.Array, n: int) -> np.ndarray:
    """An Arrow list column as a 2-d array; a row of another length is an error."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != n).any():
        raise ValueError(f"a row does not have {n} columns")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def bands(n: int, cells: int = BAND_CELLS) -> list[tuple[int, int]]:
    """Rows ``first, stop`` of the upper triangle such that a band has at most ``cells`` cells, one row at least."""
    out, first = [], 0
    while first < n:
        stop = min(n, first + max(1, cells // (n - first)))
        out.append((first, stop))
        first = stop
    return out


def _upper_rows(band: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """The rows of a band right of the diagonal, in arrays of at most ``PIECE``; column 0 of the band is ``first``."""
    rows, begins, parts, held = [], [], [], 0
    for r in range(len(band)):
        for begin in range(r, band.shape[1], PIECE):
            rows.append(first + r)
            begins.append(first + begin)
            parts.append(band[r, begin : begin + PIECE])
            held += len(parts[-1])
            if held >= CELLS_PER_BATCH or (r + 1 == len(band) and begin + PIECE >= band.shape[1]):
                offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(begins), lists], names=["i", "first", "part"])
                rows, begins, parts, held = [], [], [], 0


UPPER = "i bigint, first bigint, part array<double>"


def _sum_upper(parts: DataFrame) -> DataFrame:
    """Add the bands of all tasks array by array."""
    return (
        parts.groupBy("i", "first")
        .agg(Summarizer.sum(array_to_vector("part")).alias("part"))
        .select("i", "first", vector_to_array("part").alias("part"))
    )


def upper_cells(upper: DataFrame) -> DataFrame:
    """The cells ``i <= j`` of a triangle as coordinates; of sparse rows those that are not zero."""
    if "at" in upper.columns:
        cells = upper.select("i", "first", F.explode(F.arrays_zip("at", "part")).alias("e"))
        return cells.select("i", (F.col("first") + F.col("e.at")).alias("j"), F.col("e.part").alias("v"))
    return upper.select("i", "first", F.posexplode("part").alias("at", "v")).select("i", (F.col("first") + F.col("at")).alias("j"), "v")


def local_square(upper: DataFrame, n: int) -> np.ndarray:
    """A summed square of the checked width on the driver."""
    check_width(n)
    out = np.zeros((n, n))
    found = upper.select("i", "first", "part").toArrow()
    for i, first, part in zip(found["i"].to_pylist(), found["first"].to_pylist(), found["part"]):
        line = part.values.to_numpy(zero_copy_only=False)
        out[i, first : first + len(line)] = line
    return np.triu(out) + np.triu(out, 1).T


def gramian(rows: DataFrame, row: str = "row", n_cols: int | None = None) -> DataFrame:
    """AᵀA as a coordinate table with all ``n_cols * n_cols`` positions."""
    return mirror_upper(upper_cells(square_of_rows(rows, row, n_cols)))


def square_of_rows(
    rows: DataFrame, row: str = "row", n_cols: int | None = None, centre: np.ndarray | None = None, band_cells: int = BAND_CELLS, index: str = "i"
) -> DataFrame:
    """The upper triangle of AᵀA as ``i, first, part``: row ``i`` from column ``first`` on, in one or more arrays.

    ``centre`` is subtracted from every row first. Each band reads the rows once; ``persist`` them if they are
    dear to make and there is more than one band. Of sparse rows it is ``i, first, at, part``: the cells that are not
    zero, in columns ``first + at``.
    """
    n = width(rows, row) if n_cols is None else n_cols
    if is_sparse(rows, row):
        if centre is not None:
            raise ValueError("sparse rows are not centred")
        return squares.stored_upper(_entries(rows, row, index), n)
    dense = rows.select(F.col(row).cast("array<double>").alias("row"))

    def band_of(first: int, stop: int) -> DataFrame:
        shift = None if centre is None else np.array(centre[first:])
        step = max(1, CELLS_PER_BATCH // (n - first))

        def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            band = None
            for batch in batches:
                if (batch.column(1).to_numpy() != n).any():
                    raise ValueError(f"a row does not have {n} columns")
                for start in range(0, batch.num_rows, step):
                    x = _block(batch.column(0).slice(start, step), n - first)
                    x = x if shift is None else x - shift
                    product = x[:, : stop - first].T @ x
                    band = product if band is None else np.add(band, product, out=band)
            if band is not None:
                yield from _upper_rows(band, first)

        right = F.slice("row", first + 1, n - first) if first else F.col("row")
        return dense.select(right.alias("row"), F.size("row").alias("n")).mapInArrow(accumulate, UPPER)

    parts = [band_of(*band) for band in bands(n, band_cells)]
    if not parts:
        return rows.sparkSession.createDataFrame([], UPPER)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _sum_upper(whole)


def square_of_lists(lists: DataFrame, n: int) -> DataFrame:
    """The same of sparse rows ``at ARRAY<INT>, x ARRAY<DOUBLE>`` with positions below ``n``, in one band."""
    check_width(n)
    step = max(1, CELLS_PER_BATCH // max(n, 1))

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                x = scatter(piece.column(0), piece.column(1), n)
                square = x.T @ x if square is None else square + x.T @ x
        if square is not None:
            yield from _upper_rows(square, 0)

    return _sum_upper(lists.select("at", "x").mapInArrow(accumulate, UPPER))


def scatter(at: pa.Array, x: pa.Array, n: int) -> np.ndarray:
    """Sparse rows of an Arrow batch as a dense block."""
    sizes = at.value_lengths().to_numpy(zero_copy_only=False)
    block = np.zeros((len(sizes), n))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Several entries of one position add up.
    np.add.at(block, (owner, at.flatten().to_numpy(zero_copy_only=False)), x.flatten().to_numpy(zero_copy_only=False))
    return block


def column_summary(rows: DataFrame, row: str = "row") -> DataFrame:
    """Per column ``j``: mean, sample variance, count, nnz, max, min, l1, l2, from one pass."""
    names = ["mean", "variance", "numNonZeros", "max", "min", "normL1", "normL2"]
    summary = Summarizer.metrics("count", *names).summary(array_to_vector(F.col(row).cast("array<double>")))
    unpacked = rows.agg(summary.alias("s")).select(
        F.col("s.count").alias("n"), *[vector_to_array(F.col(f"s.{m}")).alias(m) for m in names]
    )
    return unpacked.select("n", F.posexplode(F.arrays_zip(*names)).alias("j", "m")).select(
        F.col("j").cast("bigint").alias("j"),
        F.col("m.mean").alias("mean"),
        F.col("m.variance").alias("variance"),
        F.col("n").cast("bigint").alias("count"),
        F.col("m.numNonZeros").cast("bigint").alias("nnz"),
        F.col("m.max").alias("max"),
        F.col("m.min").alias("min"),
        F.col("m.normL1").alias("l1"),
        F.col("m.normL2").alias("l2"),
    )


def column_means(rows: DataFrame, row: str = "row") -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, and the mean and sample variance of each column."""
    metrics = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(row).cast("array<double>")))
    found = rows.agg(metrics.alias("s")).select("s.count", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")).first()
    return found["count"] or 0, np.array(found["mean"] or []), np.array(found["variance"] or [])


def covariance_upper(rows: DataFrame, row: str = "row", n_cols: int | None = None, band_cells: int = BAND_CELLS, index: str = "i") -> DataFrame:
    """The upper triangle of the sample covariance as ``i, first, part``.

    Dense rows are centred on the column means before the products, so large means cost no digits. Of sparse rows
    the products of the means are taken off the sums.
    """
    n = width(rows, row) if n_cols is None else n_cols
    if is_sparse(rows, row):
        count = rows.select(index).distinct().count()
        if count < 2:
            raise ValueError("covariance needs at least two rows")
        entries = _entries(rows, row, index)
        return squares.covariance_upper(entries, n, count, column_sums(entries, n, F.col("v")) / count)
    count, mean, _ = column_means(rows, row)
    if count < 2:
        raise ValueError("covariance needs at least two rows")
    upper = square_of_rows(rows, row, n, mean, band_cells)
    return upper.withColumn("part", F.transform("part", lambda v: v / F.lit(float(count - 1))))


def covariance(rows: DataFrame, row: str = "row", n_cols: int | None = None) -> DataFrame:
    """Sample covariance of the columns as a coordinate table."""
    return mirror_upper(upper_cells(covariance_upper(rows, row, n_cols)))


def column_norms(rows: DataFrame, row: str = "row", n_cols: int | None = None, index: str = "i") -> np.ndarray:
    """The length of each column of sparse rows, one number per column on the driver."""
    n = width(rows, row) if n_cols is None else n_cols
    return np.sqrt(column_sums(_entries(rows, row, index), n, F.col("v") * F.col("v")))


def cosines_upper(upper: DataFrame, norms: np.ndarray | None = None) -> DataFrame:
    """The upper triangle of a Gramian as cosines, array by array; a column of zeros has cosine 0.

    The norms stand on the diagonal, where each row's first array begins: one number per column, on the driver. The
    triangle is read for them first; with ``norms`` it is read once, and need not be stored. That of sparse rows needs them.
    """
    if "at" in upper.columns:
        if norms is None:
            raise ValueError("the cosines of a triangle of sparse rows need the norms of their columns")
        return _stored_cosines(upper, norms)
    if norms is None:
        found = upper.where("i = first").select("i", F.get("part", F.lit(0)).alias("square")).toArrow()
        norms = np.zeros(int(max(found["i"].to_pylist(), default=-1)) + 1)
        norms[found["i"].to_numpy()] = np.sqrt(found["square"].to_numpy())

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, first = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            j = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, sizes)
            size = np.repeat(norms[i], sizes) * norms[j]
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            cosines = np.divide(values, size, out=np.zeros_like(values), where=size != 0)
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), cosines)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["i", "first", "part"])

    return upper.mapInArrow(scale, UPPER)


def _stored_cosines(upper: DataFrame, norms: np.ndarray) -> DataFrame:
    held = upper.sparkSession.sparkContext.broadcast(norms)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, first = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            j = np.repeat(first, sizes) + batch.column(2).flatten().to_numpy(zero_copy_only=False)
            size = np.repeat(held.value[i], sizes) * held.value[j]
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            cosines = np.divide(values, size, out=np.zeros_like(values), where=size != 0)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), cosines)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["i", "first", "at", "part"])

    return upper.mapInArrow(scale, squares.STORED)


def multiply_local(rows: DataFrame, matrix: np.ndarray, row: str = "row") -> DataFrame:
    """Each row times a small dense matrix; other columns are kept, nothing is shuffled."""
    if not isinstance(matrix, np.ndarray) or matrix.ndim != 2:
        raise TypeError("the right side must be a 2-d numpy array")
    if matrix.size > MAX_LOCAL:
        raise ValueError("the right side is too large to send to every task")
    n = matrix.shape[0]
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix, dtype=float))
    others = [c for c in rows.columns if c != row]
    schema = rows.select(*others, F.col(row).cast("array<double>").alias(row)).schema

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = shared.value
        for batch in batches:
            product = _block(batch.column(len(others)), n) @ right
            offsets = np.arange(0, product.size + 1, right.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.ListArray.from_arrays(offsets, product.ravel())],
                names=[*others, row],
            )

    return rows.select(*others, F.col(row).cast("array<double>").alias(row)).mapInArrow(times, schema)


def multiply_table(rows: DataFrame, right: DataFrame, index: str = "i", row: str = "row") -> DataFrame:
    """``index, row``: sparse rows times a matrix of any length that stands as ``j, v`` with one array per row ``j``.

    Pieces of one row add up; a column of ``rows`` without a row on the right counts as zero.
    """
    entries = rows.select(F.col(index).alias(index), F.explode(F.arrays_zip(F.col(f"{row}.indices").alias("j"), F.col(f"{row}.values").alias("x"))).alias("e"))
    met = entries.select(index, F.col("e.j").cast("bigint").alias("j"), F.col("e.x").alias("x")).join(right, "j")
    lines = met.select(index, F.transform("v", lambda a: a * F.col("x")).alias("line"))
    return lines.groupBy(index).agg(Summarizer.sum(array_to_vector("line")).alias("line")).select(index, vector_to_array("line").alias(row))
