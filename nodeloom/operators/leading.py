"""Leading vectors of a matrix whose shorter side is short enough for the driver.

The matrix stands as the lists of its long side: ``j, at, x`` has one row per column, with the places on the short
side that store a position. They are laid out once in tiles of many columns, whose sums are passes over long arrays.
A pass multiplies a block of vectors over the short side by AAᵀ inside the tasks, tile by tile, so that no entry is
shuffled and the long side never leaves the tasks: a task sends one sum per place of the short side. The driver holds a basis over the short side of at most ``BASIS_CELLS`` cells.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.rowmatrix import CELLS_PER_BATCH, MAX_DENSE, local_square, square_of_lists

# Components below this share of the largest singular value are noise of the squared matrix.
NOISE = 1e-7
# Vectors beside the wanted ones in a block, and most cells of all vectors that the driver holds (twice, with their images).
OVERSAMPLE = 12
BASIS_CELLS = 16_777_216
# Entries of a tile, most of a run of them, cells of its lines that a task holds at once, and cells of a sum that leave together.
TILE = 500_000
RUN = 64
TILE_CELLS = 2_000_000
SENT_CELLS = 65_536
TILE_COLUMNS = ["n", "owner", "counts", "at", "x", "back_owner", "back_counts", "back", "back_x"]
# Vectors that a pass over lists takes at once where the basis has room for many such blocks.
BLOCK = 64
# Residuals below this share of the largest value are rounding of the products.
FLOOR = 1e-14
# The best vectors within the basis are taken anew when it has grown by this factor.
GROWTH = 1.1


def eigen_of_square(square: np.ndarray, k: int, r_cond: float) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors from a Gramian, those up to ``r_cond`` of the largest dropped."""
    values, vectors = np.linalg.eigh(square)
    s = np.sqrt(np.maximum(values[::-1], 0.0))
    keep = min(k, int(np.sum(s > r_cond * s[0])) if len(s) and s[0] > 0 else 0)
    v = vectors[:, ::-1][:, :keep]
    return s[:keep], v


def _bordered(square: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A symmetric matrix with new last columns."""
    w, new = edge.shape
    out = np.zeros((w, w))
    out[: w - new, : w - new] = square
    out[:, w - new :] = edge
    out[w - new :, :] = edge.T
    own = edge[w - new :]
    out[w - new :, w - new :] = (own + own.T) / 2
    return out


def best_vectors(
    apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, block: int, cells: int, tolerance: float, max_passes: int, noise: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric matrix of ``n`` columns that ``apply`` multiplies by.

    A random block is multiplied, made orthonormal to the blocks before it, and multiplied again. The best vectors
    within all blocks are exact when their residual, which the driver can take from the blocks and their images, is
    at most ``tolerance`` of the largest value; with ``noise``, of each wanted value above that share of the largest.
    When the blocks fill ``cells`` the best of them go on alone. After ``max_passes`` a warning states the residual.
    """
    most = max(3 * block, cells // n)
    fresh = np.linalg.qr(np.random.default_rng(7).standard_normal((n, block)))[0]
    basis, images, small, checked = np.zeros((n, 0)), np.zeros((n, 0)), np.zeros((0, 0)), 0
    for done in range(1, max_passes + 1):
        image = apply(fresh)
        basis, images = np.hstack([basis, fresh]), np.hstack([images, image])
        small = _bordered(small, basis.T @ image)
        w = basis.shape[1]
        due = w >= GROWTH * checked or w == n or done == max_passes
        while True:
            if due:
                checked = w
                values, turn = np.linalg.eigh(small)
                values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
                vectors = basis @ turn[:, :k]
                top = max(values[0], np.finfo(float).tiny)
                off = np.linalg.norm(images @ turn[:, :k] - vectors * values[:k], axis=0)
                if noise is None:
                    settled = off.max(initial=0.0) <= tolerance * top
                else:
                    settled = (off <= np.maximum(tolerance * values[:k], FLOOR * top))[values[:k] > noise * top].all()
                if w == n or settled:
                    return values[:k], vectors
            rest = image
            for _ in range(2):
                rest = rest - basis @ (basis.T @ rest)
            u, size, _ = np.linalg.svd(rest, full_matrices=False)
            left = min(int(np.sum(size > 1e-13 * top)), n - w)
            # Without a direction left, or before only the best go on, the best must be those of this basis.
            if due or (left and w + left <= most):
                break
            due = True
        if not left:
            return values[:k], vectors
        fresh = np.linalg.qr(u[:, :left] - basis @ (basis.T @ u[:, :left]))[0]
        # The next block holds what the best vectors lack, also when only these go on.
        if w + left > most:
            kept = turn[:, : 2 * block]
            basis, images, small = basis @ kept, images @ kept, kept.T @ small @ kept
            checked = basis.shape[1]
    warnings.warn(f"residual {off.max() / top:.1e} of the largest value after {max_passes} passes", stacklevel=3)
    return values[:k], vectors


def _pieces(batch: pa.RecordBatch, at: int, x: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``first, stop, starts, at, x`` of runs of the lists of a batch, none empty, with about ``CELLS_PER_BATCH // k`` entries."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    places, values = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (at, x))
    ends = np.cumsum(sizes)
    step, first = max(1, CELLS_PER_BATCH // max(k, 1)), 0
    while first < len(sizes):
        begin = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, begin + step, "right")))
        entries = slice(begin, int(ends[stop - 1]))
        yield first, stop, ends[first:stop] - sizes[first:stop] - begin, places[entries], values[entries]
        first = stop


class Runs(NamedTuple):
    """Sums of lines as a few passes over long arrays: a run has up to ``RUN`` entries of one sum, longest runs first.

    ``index`` has the first entries of all runs, then the second ones of those that have two, and so on; ``counts`` says how many each.
    """

    owner: np.ndarray
    counts: np.ndarray
    index: np.ndarray
    x: np.ndarray

    def add(self, lines: np.ndarray, out: np.ndarray) -> None:
        """Add to each line of ``out`` the ``lines`` of its entries."""
        if not len(self.owner):
            return
        held, spare, low = None, np.empty((len(self.owner), lines.shape[1])), 0
        for count in self.counts.tolist():
            part = spare[:count]
            np.take(lines, self.index[low : low + count], axis=0, out=part, mode="clip")
            if len(self.x):
                part *= self.x[low : low + count, None]
            if held is None:
                held, spare = spare, np.empty_like(spare)
            else:
                held[:count] += part
            low += count
        order = np.argsort(self.owner, kind="stable")
        places = self.owner[order]
        firsts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        if len(firsts) == len(places):
            out[self.owner] += held
        else:
            out[places[firsts]] += np.add.reduceat(held[order], firsts, axis=0)


def runs(sizes: np.ndarray, index: np.ndarray, x: np.ndarray) -> Runs:
    """From the entries of sum after sum, ``sizes`` of each; without ``x`` all values are 1."""
    begins = np.cumsum(sizes) - sizes
    pieces = -(-sizes // RUN)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    skipped = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
    first, long = begins[owner] + skipped, np.minimum(sizes[owner] - skipped, RUN)
    order = np.argsort(-long, kind="stable")
    owner, first, long = owner[order], first[order], long[order]
    counts = np.searchsorted(-long, -np.arange(long.max(initial=0)))
    at = np.concatenate([first[:count] + t for t, count in enumerate(counts)]) if len(counts) else np.zeros(0, dtype=np.int64)
    return Runs(owner.astype(np.int32), counts.astype(np.int32), index[at].astype(np.int32), x[at] if len(x) else x)


def _packed(r: Runs) -> list[bytes]:
    return [part.tobytes() for part in r]


def _unpacked(row: list[memoryview]) -> Runs:
    owner, counts, index, x = row
    owner, counts, index = (np.frombuffer(part, dtype=np.int32) for part in (owner, counts, index))
    return Runs(owner, counts, index, np.frombuffer(x, dtype=np.float32 if x.size == index.nbytes else np.float64))


def tiles(lists: DataFrame) -> DataFrame:
    """The lists in tiles of about ``TILE`` entries, each laid out by its lists and by its places."""

    def tile(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes, at, x = (np.concatenate(part) for part in zip(*held))
        if (x == 1.0).all():
            x = x[:0]
        else:
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            x = short if (short == x).all() else x
        order = np.argsort(at, kind="stable")
        owner = np.repeat(np.arange(len(sizes)), sizes)[order]
        both = [*_packed(runs(sizes, at, x)), *_packed(runs(np.bincount(at), owner, x[order] if len(x) else x))]
        return pa.RecordBatch.from_arrays([pa.array([len(sizes)], type=pa.int32()), *[pa.array([part], type=pa.binary()) for part in both]], names=TILE_COLUMNS)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            at, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                begin = int(ends[first - 1]) if first else 0
                stop = max(first + 1, int(np.searchsorted(ends, begin + TILE - count, "right")))
                last = int(ends[stop - 1])
                held.append((sizes[first:stop], at[begin:last], x[begin:last]))
                count, first = count + last - begin, stop
                if count >= TILE or first < len(sizes):
                    yield tile(held)
                    held, count = [], 0
        if held:
            yield tile(held)

    return lists.select("at", "x").mapInArrow(lay, ", ".join(f"{c} {'int' if c == 'n' else 'binary'}" for c in TILE_COLUMNS))


def square_times(laid: DataFrame, q: np.ndarray, centred: bool = False) -> np.ndarray:
    """AAᵀ q in one pass over the tiles; ``centred`` takes the mean over the short side out of every column first."""
    m, k = q.shape
    spark = laid.sparkSession
    q = q - q.mean(axis=0) if centred else q
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(q))
    step = max(1, SENT_CELLS // k)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            total = np.zeros((m, k)) if total is None else total
            for row in range(batch.num_rows):
                n, *parts = (batch.column(c)[row] for c in range(batch.num_columns))
                parts = [np.frombuffer(part.as_buffer(), dtype=np.uint8) for part in parts]
                there, back = _unpacked(parts[:4]), _unpacked(parts[4:])
                # Lines of a tile are held for as many vectors as fit.
                width = min(k, max(1, 2 * TILE_CELLS // (len(there.owner) + len(back.owner) + 1)))
                for low in range(0, k, width):
                    some = slice(low, low + width)
                    vectors = shared.value if width == k else np.ascontiguousarray(shared.value[:, some])
                    inner = np.zeros((n.as_py(), vectors.shape[1]))
                    there.add(vectors, inner)
                    back.add(inner, total[:, some])
        if total is not None:
            for start in range(0, m, step):
                part = total[start : start + step].ravel()
                yield pa.RecordBatch.from_arrays([pa.array([start], type=pa.int64()), pa.array([part], type=pa.list_(pa.float64()))], names=["i", "part"])

    # One sum per core, however many parts the tiles have.
    parts = laid.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(accumulate, "i bigint, part array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    found = sums.select("i", vector_to_array("part").alias("part")).toArrow()
    shared.destroy()
    out = np.zeros((m, k))
    for start, part in zip(found["i"].to_pylist(), found["part"].combine_chunks() if found.num_rows else []):
        out[start : start + step] = part.values.to_numpy(zero_copy_only=False).reshape(-1, k)
    return out - out.mean(axis=0) if centred else out


def fits(m: int, k: int) -> bool:
    """Whether the driver may hold the vectors of ``k`` components over a side of length ``m``."""
    return m * (k + OVERSAMPLE) <= BASIS_CELLS


def left_vectors(
    lists: DataFrame, m: int, k: int, noise: float = NOISE, centred: bool = False, dense_side: int = MAX_DENSE, tolerance: float = 1e-11, max_passes: int = 1_000
) -> tuple[np.ndarray, np.ndarray]:
    """Leading ``k`` singular values and vectors over the short side, fewer at lower rank; ``lists`` are read in every pass.

    A side of at most ``dense_side`` is decomposed from its square.
    """
    if m <= dense_side:
        square = local_square(square_of_lists(lists, m), m)
        if centred and m:
            square = square - square.mean(axis=0)
            square = square - square.mean(axis=1)[:, None]
            square = (square + square.T) / 2
        return eigen_of_square(square, k, noise)
    if not fits(m, k):
        raise ValueError(f"{k} components over a side of {m} exceed {BASIS_CELLS} cells on the driver")
    block = min(m, max(k + OVERSAMPLE, min(BLOCK, BASIS_CELLS // m // 16)))
    laid = tiles(lists).persist(StorageLevel.MEMORY_AND_DISK)
    values, u = best_vectors(lambda q: square_times(laid, q, centred), m, k, block, BASIS_CELLS, tolerance, max_passes, noise**2)
    laid.unpersist()
    s = np.sqrt(values)
    keep = int(np.sum(s > noise * s[0])) if len(s) and s[0] > 0 else 0
    return s[:keep], u[:, :keep]


def project(lists: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``j, v``: each list times a matrix over the short side."""
    k = matrix.shape[1]
    shared = lists.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix))

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, starts, at, x in _pieces(batch, 1, 2, k):
                product = np.add.reduceat(shared.value[at] * x[:, None], starts, axis=0)
                offsets = np.arange(stop - first + 1, dtype=np.int32) * k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first), pa.ListArray.from_arrays(offsets, product.ravel())], names=["j", "v"]
                )

    return lists.select("j", "at", "x").mapInArrow(times, "j bigint, v array<double>")


def peak_signs(vectors: DataFrame, k: int) -> np.ndarray:
    """Per component of ``j, v`` the sign of its entry of largest magnitude, the first one on ties."""
    if k == 0:
        return np.ones(0)
    place = -F.col("j")
    peaks = vectors.agg(
        *[
            F.max_by(F.get("v", F.lit(c)), F.struct(F.round(F.abs(F.get("v", F.lit(c))), 9), place)).alias(f"p{c}")
            for c in range(k)
        ]
    ).first()
    return np.array([-1.0 if p is not None and p < 0 else 1.0 for p in peaks])


def signed(vectors: DataFrame, k: int) -> DataFrame:
    """Turn each component so that its entry of largest magnitude is positive, the first one on ties."""
    return turned(vectors, peak_signs(vectors, k))


def turned(vectors: DataFrame, signs: np.ndarray) -> DataFrame:
    if not len(signs):
        return vectors
    by = F.array(*[F.lit(float(s)) for s in signs])
    return vectors.select("j", F.zip_with("v", by, lambda x, s: x * s + F.lit(0.0)).alias("v"))
