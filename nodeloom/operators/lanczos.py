"""Leading eigenvectors of AᵀA for coordinate tables with two long sides, by a block Lanczos process.

Vectors stand as blocks: a table ``s, at, q`` with one row per stripe ``s`` of ``STRIPE`` columns, the places in it
that store a position, and their entries of all vectors of the block, row by row. The basis only grows: each round
adds one table and reads the earlier ones, none is written again. The products BᵀB and BᵀAᵀAB grow by their new
border, and nothing longer than the number of basis vectors reaches the driver.

A is laid out twice, by stripes of columns and by stripes of rows; many entries of one stripe are cut into pieces.
A task multiplies a piece with the stripe's block, and sums per result place before the shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.skew import PART, hot_keys, repeat_lookup, spread_rows
from nodeloom.runtime import drop_stored, shuffle_partitions, store_table

STRIPE = 1_024
# Entries of a stripe that a task multiplies at once, and cells of sums that it holds before it sends them on.
PIECE_ENTRIES = 25_000
OPEN_CELLS = 4_000_000
# Vectors that a round adds, and most vectors of a basis.
BLOCK = 128
MAX_WIDTH = 1_024
# Directions of a new block below this share (squared) are rounding of the products.
ROUNDING = 1e-13

CHUNK = "s bigint, at array<int>, q array<double>"


class Side(NamedTuple):
    """A by stripes of one of its sides: ``s, _part, onto, at, v`` sorted by ``onto``, and the stripes in many parts."""

    pieces: DataFrame
    hot: DataFrame


class Eigen(NamedTuple):
    values: np.ndarray
    vectors: DataFrame


def lay_out(coo: DataFrame, over: str, onto: str, piece_entries: int = PIECE_ENTRIES) -> Side:
    stripe = F.lit(STRIPE).cast("bigint")
    placed = coo.select(
        F.floor(F.col(over) / stripe).cast("bigint").alias("s"), (F.col(over) % stripe).cast("int").alias("at"), F.col(onto).alias("onto"), "v"
    )
    hot = hot_keys(placed.groupBy("s").agg(F.count(F.lit(1)).alias("n")), ["s"], "n", piece_entries)
    hot = hot.persist(StorageLevel.MEMORY_AND_DISK)
    spread = spread_rows(placed, ["s"], hot, [F.col("onto")])
    entries = F.array_sort(F.collect_list(F.struct("onto", "at", "v"))).alias("e")
    pieces = spread.groupBy("s", PART).agg(entries).select("s", PART, "e.onto", "e.at", "e.v")
    return Side(pieces.persist(StorageLevel.MEMORY_AND_DISK), hot)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the lists of an Arrow column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy(zero_copy_only=False)


def _chunks(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    def lists(parts: list[np.ndarray], kind) -> pa.Array:
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), type=kind))

    flat = [q.ravel() for _, _, q in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _, _ in rows], type=pa.int64()), lists([a for _, a, _ in rows], pa.int32()), lists(flat, pa.float64())], names=["s", "at", "q"]
    )


def _summed(onto: list[np.ndarray], cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One line per result place."""
    places, lines = np.concatenate(onto), np.concatenate(cells)
    order = np.argsort(places, kind="stable")
    places = places[order]
    starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return places[starts], np.add.reduceat(lines[order], starts, axis=0)


def apply(side: Side, block: DataFrame, width: int) -> DataFrame:
    """The product of the matrix with a block, as chunks over its other side."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(onto, cells):
            places, lines = _summed(onto, cells)
            stripes = places // STRIPE
            cuts = np.flatnonzero(np.concatenate([[True], stripes[1:] != stripes[:-1]]))
            stops = np.append(cuts[1:], len(places))
            step = max(1, OPEN_CELLS // (width * STRIPE))
            for k in range(0, len(cuts), step):
                yield _chunks([(int(stripes[a]), (places[a:b] % STRIPE).astype(np.int32), lines[a:b]) for a, b in zip(cuts[k : k + step], stops[k : k + step])])

        onto, cells, held = [], [], 0
        for batch in batches:
            (ends, to), (_, at), (_, v) = (_lists(batch.column(k)) for k in (0, 1, 2))
            (own_ends, own), (q_ends, q) = _lists(batch.column(3)), _lists(batch.column(4))
            for n in range(batch.num_rows):
                mine = slice(ends[n], ends[n + 1])
                vectors = q[q_ends[n] : q_ends[n + 1]].reshape(-1, width)
                lines = vectors[np.searchsorted(own[own_ends[n] : own_ends[n + 1]], at[mine])] * v[mine, None]
                starts = np.flatnonzero(np.concatenate([[True], to[mine][1:] != to[mine][:-1]]))
                onto.append(to[mine][starts])
                cells.append(np.add.reduceat(lines, starts, axis=0))
                held += cells[-1].size
                if held >= OPEN_CELLS:
                    yield from sent(onto, cells)
                    onto, cells, held = [], [], 0
        if onto:
            yield from sent(onto, cells)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, sums, hit = None, np.zeros((STRIPE, width)), np.zeros(STRIPE, dtype=bool)
        for batch in batches:
            (ends, at), (q_ends, q) = _lists(batch.column(1)), _lists(batch.column(2))
            for n, s in enumerate(batch.column(0).to_pylist()):
                if s != stripe:
                    if stripe is not None:
                        found = np.flatnonzero(hit)
                        yield _chunks([(stripe, found.astype(np.int32), sums[found])])
                        sums[found], hit[found] = 0.0, False
                    stripe = s
                own = at[ends[n] : ends[n + 1]]
                sums[own] += q[q_ends[n] : q_ends[n + 1]].reshape(-1, width)
                hit[own] = True
        if stripe is not None:
            found = np.flatnonzero(hit)
            yield _chunks([(stripe, found.astype(np.int32), sums[found])])

    named = repeat_lookup(block, ["s"], side.hot).select("s", PART, F.col("at").alias("own"), "q")
    met = side.pieces.join(named, ["s", PART]).select("onto", "at", "v", "own", "q")
    parts = met.mapInArrow(products, CHUNK).repartition(shuffle_partitions(block.sparkSession), "s").sortWithinPartitions("s")
    return parts.mapInArrow(total, CHUNK)


def _together(blocks: list[DataFrame]) -> DataFrame:
    """The chunks of several blocks over the same columns side by side."""
    first, *others = [b.select("s", "at", F.col("q").alias(f"q{n}")) for n, b in enumerate(blocks)]
    return reduce(lambda a, b: a.join(b.drop("at"), "s"), others, first)


def _matrices(batch: pa.RecordBatch, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ends, at = _lists(batch.column(1))
    held = [_lists(batch.column(2 + k)) for k in range(len(widths))]
    for n, s in enumerate(batch.column(0).to_pylist()):
        yield s, at[ends[n] : ends[n + 1]], np.hstack([q[e[n] : e[n + 1]].reshape(-1, w) for (e, q), w in zip(held, widths)])


def border(blocks: list[DataFrame], widths: list[int], last: int) -> np.ndarray:
    """All vectors of the blocks times the ``last`` ones, summed over all columns of the matrix."""

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, x in _matrices(batch, widths):
                part = x.T @ x[:, -last:]
                total = part if total is None else np.add(total, part, out=total)
        if total is not None:
            offsets = np.arange(0, total.size + 1, last, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.ListArray.from_arrays(offsets, total.ravel())], names=["i", "part"])

    parts = _together(blocks).mapInArrow(accumulate, "i bigint, part array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("part")).alias("part")).select("i", vector_to_array("part").alias("part")).toArrow()
    out = np.zeros((sum(widths), last))
    for i, part in zip(sums["i"].to_pylist(), sums["part"].to_pylist()):
        out[i] = part
    return out


def combine(blocks: list[DataFrame], widths: list[int], turn: np.ndarray) -> DataFrame:
    """The block of all vectors times a small matrix."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, at, x in _matrices(batch, widths):
                yield _chunks([(s, at, x @ turn)])

    return _together(blocks).mapInArrow(times, CHUNK)


def _start(coo: DataFrame, width: int) -> DataFrame:
    """A block of random numbers that follow from the stripe alone: a recomputed task makes them again."""
    stripe = F.lit(STRIPE).cast("bigint")
    places = coo.select(F.floor(F.col("j") / stripe).cast("bigint").alias("s"), (F.col("j") % stripe).cast("int").alias("at")).distinct()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = _lists(batch.column(1))
            for n, s in enumerate(batch.column(0).to_pylist()):
                own = at[ends[n] : ends[n + 1]]
                yield _chunks([(s, own, np.random.default_rng([7, s]).standard_normal((len(own), width)))])

    return places.groupBy("s").agg(F.array_sort(F.collect_list("at")).alias("at")).mapInArrow(fill, CHUNK)


def _grown(square: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A symmetric matrix with new last columns."""
    w, new = edge.shape
    out = np.zeros((w, w))
    out[: w - new, : w - new] = square[: w - new, : w - new]
    out[:, w - new :] = edge
    out[w - new :, :] = edge.T
    own = edge[w - new :]
    out[w - new :, w - new :] = (own + own.T) / 2
    return out


def block_lanczos(
    coo: DataFrame, k: int, block: int = BLOCK, tolerance: float = 1e-11, max_rounds: int = 100, max_width: int = MAX_WIDTH, noise: float = 1e-14, piece_entries: int = PIECE_ENTRIES
) -> Eigen:
    """The ``k`` largest eigenvalues of AᵀA and their vectors as ``j, v``, for the columns that store a position.

    ``coo`` has one row per position. Values up to ``noise`` of the largest are left out. It stops when the residual
    of every wanted vector is at most ``tolerance`` of its value, when the basis holds all that A reaches, or after
    ``max_rounds`` with a warning that states the residual. A basis of more than ``max_width`` vectors is replaced
    by its best ones.
    """
    coo = coo.persist(StorageLevel.MEMORY_AND_DISK)
    by_column, by_row = lay_out(coo, "j", "i", piece_entries), lay_out(coo, "i", "j", piece_entries)
    width = max(k + 2, block)
    tables: list[DataFrame] = []
    copies: list[DataFrame] = []

    def held(made: DataFrame) -> DataFrame:
        """Written to the shared folder once; the copy laid out by stripe is there for speed only."""
        tables.append(store_table(made))
        copies.append(tables[-1].repartition(shuffle_partitions(made.sparkSession), "s").persist(StorageLevel.MEMORY_AND_DISK))
        return copies[-1]

    first = _start(coo, width)
    square = border([first], [width], width)
    scale = 1.0 / np.sqrt(np.maximum(np.diag(square), np.finfo(float).tiny))
    values, turn = np.linalg.eigh(square * np.outer(scale, scale))
    # Fewer columns than vectors leave fewer directions.
    sound = values > 1e-10 * max(values[-1], np.finfo(float).tiny)
    fresh = held(combine([first], [width], scale[:, None] * turn[:, sound] / np.sqrt(values[sound])))
    blocks, widths = [fresh], [int(sound.sum())]
    lengths, products = np.zeros((0, 0)), np.zeros((0, 0))
    for n in range(max_rounds):
        new, w = widths[-1], sum(widths)
        if w == 0:
            break
        image = store_table(apply(by_row, apply(by_column, fresh, new), new))
        edge = border([*blocks[:-1], fresh, image], [*widths, new], 2 * new)
        lengths, products = _grown(lengths, edge[:w, :new]), _grown(products, edge[:w, new:])
        # Best vectors within the basis, whose vectors may be orthonormal up to rounding only.
        low = np.linalg.inv(np.linalg.cholesky(lengths))
        values, turn = np.linalg.eigh(low @ products @ low.T)
        values, turn = np.maximum(values[::-1], 0.0), (low.T @ turn)[:, ::-1]
        inside = np.linalg.solve(lengths, products[:, w - new :])
        rest = edge[w:, new:] - products[:, w - new :].T @ inside
        rest = (rest + rest.T) / 2
        # Earlier images lie within the basis, so that only the last block's part has a residual.
        wanted = [c for c in range(min(k, w)) if values[c] > noise * values[0]]
        ends = turn[w - new :, wanted]
        worst = np.sqrt(np.maximum(np.einsum("ac,ab,bc->c", ends, rest, ends), 0.0)) / values[wanted] if wanted else np.zeros(0)
        sizes, axes = np.linalg.eigh(rest)
        outside = sizes > ROUNDING * max(np.diag(edge[w:, new:]).max(), np.finfo(float).tiny)
        settled = (worst <= tolerance).all() or not outside.any()
        if not settled and n + 1 == max_rounds:
            warnings.warn(f"relative residual {worst.max():.1e} after {max_rounds} rounds", stacklevel=2)
        if settled or n + 1 == max_rounds:
            drop_stored(image)
            break
        spread = axes[:, outside] / np.sqrt(sizes[outside])
        following = held(combine([*blocks, image], [*widths, new], np.vstack([-inside @ spread, spread])))
        if w + spread.shape[1] > max_width:
            kept = turn[:, : min(2 * width, w)]
            # Made while the earlier tables stand; they are not read after that.
            best = held(combine(blocks, widths, kept))
            best.count()
            blocks, widths = [best], [kept.shape[1]]
            lengths, products = kept.T @ lengths @ kept, kept.T @ products @ kept
        blocks, widths, fresh = [*blocks, following], [*widths, spread.shape[1]], following
        drop_stored(image)
    if not sum(widths):
        wanted, values, turn = [], np.zeros(0), np.zeros((0, 0))
    chosen = combine(blocks, widths, turn[:, wanted])
    keep = len(wanted)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ends, at), (q_ends, q) = _lists(batch.column(1)), _lists(batch.column(2))
            for n, s in enumerate(batch.column(0).to_pylist()):
                own = at[ends[n] : ends[n + 1]].astype(np.int64) + s * STRIPE
                part = pa.array(q[q_ends[n] : q_ends[n + 1]])
                offsets = np.arange(0, keep * len(own) + 1, keep, dtype=np.int32) if keep else np.zeros(len(own) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(offsets, part)], names=["j", "v"])

    vectors = store_table(chosen.mapInArrow(lines, "j bigint, v array<double>"))
    for done in (coo, by_column.pieces, by_column.hot, by_row.pieces, by_row.hot, *copies):
        done.unpersist()
    for done in tables:
        drop_stored(done)
    return Eigen(values[wanted], vectors)
