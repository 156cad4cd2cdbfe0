"""The upper triangle of AᵀA of a sparse matrix with many columns, in cells of a grid over it.

The columns are cut into blocks; a cell is a pair of blocks and is made by one task, from the entries of its two blocks,
so that no product is shuffled. An entry goes to one cell per block that its row has, packed with those of its row and block. A task reads
a cell row by row of the matrix and multiplies some rows at a time, so that a cell's memory does not grow with the rows.

A full triangle, as a covariance has, is accumulated in arrays of at most ``EDGE * EDGE`` cells. A triangle of stored
cells takes larger cells where entries are few, so that an entry is sent less often; those are made some lines at a time
and never held whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.runtime import shuffle_partitions

# Most columns of a block whose cells are held as arrays, most entries of a wider one, and products of the lines of its cells that are made at once.
EDGE = 4_096
BLOCK_ENTRIES = 2_000_000
PRODUCTS = 500_000
# Entries that a task reads before it multiplies, pairs of them at once, and cells of an array that leave together.
ENTRIES = 500_000
STEP = 4_000_000
SENT = 1_000_000
# Most partitions that cells are dealt to.
PARTITIONS = 2_000

FULL = "i bigint, first bigint, part array<double>"
STORED = "i bigint, first bigint, at array<int>, part array<double>"
CELLS = "i bigint, j bigint, v double"


class Grid(NamedTuple):
    cols: int
    edge: int
    parts: int

    def block(self, b: int) -> np.ndarray:
        return np.arange(b * self.edge, min(self.cols, (b + 1) * self.edge))


def grid(coo: DataFrame, n: int, full: bool) -> Grid:
    """Blocks for ``n`` columns: small enough for arrays, or of at most ``BLOCK_ENTRIES`` entries if that makes far larger ones."""
    least = min(n, math.ceil(math.sqrt(2 * shuffle_partitions(coo.sparkSession))))
    parts = -(-n // EDGE)
    if not full:
        line = F.lit(EDGE).cast("bigint")
        found = coo.groupBy(((F.col("j") - F.col("j") % line) / line).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("b IS NOT NULL").toArrow()
        held = np.zeros(max(parts, 1), dtype=np.int64)
        held[found["b"].to_numpy()] = found["n"].to_numpy()
        wide = next(t for t in range(max(parts, 1), 0, -1) if t == 1 or np.add.reduceat(held, np.arange(0, len(held), t)).max() <= BLOCK_ENTRIES)
        few = -(-parts // wide)
        parts = few if 2 * few < parts else parts
    edge = -(-n // max(parts, least))
    return Grid(n, edge, -(-n // edge))


def _sorted(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising places below ``size``, and their order; sorting numbers that hold both is faster than sorting an order."""
    bits = len(places).bit_length()
    if bits + size.bit_length() > 62:
        order = np.argsort(places)
        return places[order], order
    both = (places << bits) | np.arange(len(places))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


class Cell:
    """The sums of one cell: an array, or the entries of its blocks until it is made line by line where that would be too large."""

    def __init__(self, number: int, g: Grid):
        self.at = divmod(number, g.parts)
        self.number, self.rows, self.cols = number, g.block(self.at[0]), g.block(self.at[1])
        self.diagonal = self.at[0] == self.at[1]
        self.size = len(self.rows) * len(self.cols)
        self.value = np.zeros(self.size) if self.size <= EDGE * EDGE else None
        self.held, self.count = [], 0

    def take(self, k: np.ndarray, block: np.ndarray, o: np.ndarray, v: np.ndarray) -> None:
        """More entries by rising row ``k``: row, block of columns, place in the block, value."""
        self.held.append((k, block, o, v))
        self.count += len(k)
        if self.value is None or self.count < ENTRIES:
            return
        k, *rest = (np.concatenate(part) for part in zip(*self.held))
        # The last row may go on.
        cut = int(np.searchsorted(k, k[-1]))
        self._multiply(k[:cut], *(part[:cut] for part in rest))
        self.held, self.count = [(k[cut:], *(part[cut:] for part in rest))], 0 if cut else -len(k)

    def close(self) -> None:
        if self.value is None:
            return
        if self.held:
            self._multiply(*(np.concatenate(part) for part in zip(*self.held)))
        self.held = []

    def _multiply(self, k: np.ndarray, block: np.ndarray, o: np.ndarray, v: np.ndarray) -> None:
        (a_k, a_o, a_v), (b_k, b_o, b_v) = ([x[block == b] for x in (k, o, v)] for b in self.at)
        begin = np.searchsorted(b_k, a_k)
        many = np.searchsorted(b_k, a_k, "right") - begin
        ends = np.cumsum(many)
        if not len(ends) or not ends[-1]:
            return
        kinds = np.unique(a_k[many > 0])
        if self.size * len(kinds) <= 16 * int(ends[-1]):
            self._dense(kinds, (a_k, a_o, a_v), (b_k, b_o, b_v))
            return
        low = 0
        while low < len(a_k):
            done = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + STEP, "right")))
            n = many[low:high]
            at = np.arange(n.sum()) + np.repeat(begin[low:high] - (ends[low:high] - n - done), n)
            places = np.repeat(a_o[low:high].astype(np.int64) * len(self.cols), n) + b_o[at]
            products = np.repeat(a_v[low:high], n) * b_v[at]
            if self.diagonal:
                upper = np.repeat(a_o[low:high], n) <= b_o[at]
                places, products = places[upper], products[upper]
            self._add(places, products)
            low = high

    def _dense(self, kinds: np.ndarray, *sides: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        step = max(1, STEP // (len(self.rows) + len(self.cols)))
        for first in range(0, len(kinds), step):
            some = kinds[first : first + step]
            x, y = (np.zeros((len(some), len(side))) for side in (self.rows, self.cols))
            for dense, (k, o, v) in zip((x, y), sides):
                at = np.minimum(np.searchsorted(some, k), len(some) - 1)
                own = some[at] == k
                dense[at[own], o[own]] = v[own]
            product = x.T @ y
            self.value += (np.triu(product) if self.diagonal else product).ravel()

    def _add(self, places: np.ndarray, products: np.ndarray) -> None:
        if 8 * len(places) < self.size:
            np.add.at(self.value, places, products)
        else:
            self.value += np.bincount(places, products, self.size)

    def _sides(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The entries of both blocks by row and place, one per position."""
        k, block, o, v = (np.concatenate(part) for part in zip(*self.held))
        k = np.unique(k, return_inverse=True)[1]
        out = []
        for b in self.at[:1] if self.diagonal else self.at:
            own = np.flatnonzero(block == b)
            own = own[np.lexsort((o[own], k[own]))]
            sides = k[own], o[own].astype(np.int64), v[own]
            new = np.concatenate([[True], (sides[0][1:] != sides[0][:-1]) | (sides[1][1:] != sides[1][:-1])])[: len(own)]
            if not new.all():
                firsts = np.flatnonzero(new)
                sides = sides[0][firsts], sides[1][firsts], np.add.reduceat(sides[2], firsts)
            out.append(sides)
        return out

    def _sliced(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some lines after the other, from the entries of both blocks: about ``PRODUCTS`` at a time, or all of one line."""
        lines, width = len(self.rows), len(self.cols)
        none = np.zeros(0, dtype=np.int64)
        a_k, a_o, a_v = b_k, b_o, b_v = none, none, np.zeros(0)
        begin = many = none
        if self.held:
            sides = self._sides()
            (a_k, a_o, a_v), (b_k, b_o, b_v) = sides[0], sides[-1]
            # On the diagonal an entry meets itself and what follows in its row.
            begin = np.arange(len(a_k)) if self.diagonal else np.searchsorted(b_k, a_k)
            many = np.searchsorted(b_k, a_k, "right") - begin
            order = np.argsort(a_o, kind="stable")
            a_o, a_v, begin, many = a_o[order], a_v[order], begin[order], many[order]
        self.held = []
        ends = np.cumsum(np.bincount(a_o, many, lines).astype(np.int64))
        dense = lines * width <= 16 * int(ends[-1])
        most = max(1, STEP // width) if dense else lines
        low = 0
        while low < lines:
            done = int(ends[low - 1]) if low else 0
            high = min(max(low + 1, int(np.searchsorted(ends, done + PRODUCTS, "right"))), low + most, lines)
            some = slice(*np.searchsorted(a_o, [low, high]).tolist())
            n = many[some]
            at = np.arange(n.sum()) + np.repeat(begin[some] - (np.cumsum(n) - n), n)
            places = np.repeat((a_o[some] - low) * width, n) + b_o[at]
            products = np.repeat(a_v[some], n) * b_v[at]
            if dense:
                sums = np.bincount(places, products, (high - low) * width).astype(float)
                places = np.flatnonzero(sums)
                sums = sums[places]
            else:
                places, order = _sorted(places, (high - low) * width)
                products = products[order]
                firsts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])[: len(places)])
                places, sums = places[firsts], np.add.reduceat(products, firsts) if len(firsts) else products
            r, c = np.divmod(places, width)
            yield self.rows[low:high], r, c, sums
            low = high

    def lines(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some lines of the array at a time, with the numbers of their columns of the matrix."""
        value = self.value.reshape(len(self.rows), len(self.cols))
        step = max(1, SENT // len(self.cols))
        for a in range(0, len(self.rows), step):
            yield self.rows[a : a + step], value[a : a + step]

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The cells with a product: numbers of lines, the line of each cell, its place in the block, its value."""
        if self.value is not None:
            for i, block in self.lines():
                r, c = np.nonzero(block)
                yield i, r, c, block[r, c]
            return
        yield from self._sliced()


def _lists(sizes: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def to_cells(coo: DataFrame, g: Grid) -> DataFrame:
    """``cell, k, block, o, v``: the entries of each row and block, once per cell that they take part in."""
    edge, parts = F.lit(g.edge).cast("bigint"), F.lit(g.parts).cast("bigint")
    block = ((F.col("j") - F.col("j") % edge) / edge).cast("bigint")
    entry = F.struct((F.col("j") % edge).cast("int").alias("o"), F.col("v").cast("double").alias("v"))
    packed = coo.groupBy(F.col("i").alias("k"), block.alias("block")).agg(F.collect_list(entry).alias("e"))
    # Two blocks meet only in rows that have both.
    whole = packed.withColumn("others", F.collect_set("block").over(Window.partitionBy("k")))
    other = F.explode("others")
    return whole.select("k", "block", F.col("e.o").alias("o"), F.col("e.v").alias("v"), other.alias("other")).select(
        (F.least("block", "other") * parts + F.greatest("block", "other")).alias("cell"), "k", "block", "o", "v"
    )


def _triangle(coo: DataFrame, n: int, full: bool, finish: Callable[[Cell], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``finish`` makes of each cell, those without an entry included if ``full``, else those on the diagonal."""
    spark, g = coo.sparkSession, grid(coo, n, full)
    parts, sent = F.lit(g.parts).cast("bigint"), to_cells(coo, g)
    none = [F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("block"), F.array().cast("array<int>").alias("o"), F.array().cast("array<double>").alias("v")]
    if full:
        line = ((F.col("id") - F.col("id") % parts) / parts).cast("bigint")
        empty = spark.range(g.parts * g.parts).where(line <= F.col("id") % parts).select(F.col("id").alias("cell"), *none)
    else:
        empty = spark.range(g.parts).select((F.col("id") * (parts + 1)).alias("cell"), *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if made is None or made.number != number[low]:
                    if made is not None:
                        made.close()
                        yield from finish(made)
                    made = Cell(int(number[low]), g)
                rows = batch.slice(low, high - low)
                sizes = rows.column(3).value_lengths().to_numpy(zero_copy_only=False)
                k, own = (np.repeat(rows.column(c).to_numpy(), sizes) for c in (1, 2))
                if len(k):
                    made.take(k, own, _flat(rows.column(3)), _flat(rows.column(4)))
        if made is not None:
            made.close()
            yield from finish(made)

    width = min(PARTITIONS, g.parts * (g.parts + 1) // 2)
    cells = sent.unionByName(empty).repartition(width, "cell").sortWithinPartitions("cell", "k")
    return cells.select("cell", "k", "block", "o", "v").mapInArrow(run, schema)


def stored_upper(coo: DataFrame, n: int) -> DataFrame:
    """``i, first, at, part``: the cells of the upper triangle of AᵀA that are not zero, in columns ``first + at``.

    ``coo`` has one row per position, none NULL. Every column has a row, with empty arrays if need be.
    """

    def finish(cell: Cell) -> Iterator[pa.RecordBatch]:
        for i, r, c, v in cell.found():
            sizes = np.bincount(r, minlength=len(i))
            kept = np.flatnonzero((sizes > 0) | cell.diagonal)
            if len(kept):
                at = _lists(sizes[kept], pa.array(c, type=pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[kept]), pa.array(np.full(len(kept), cell.cols[0])), at, _lists(sizes[kept], v)], names=["i", "first", "at", "part"]
                )

    return _triangle(coo, n, False, finish, STORED)


def covariance_upper(coo: DataFrame, n: int, count: int, means: np.ndarray, cells: bool = False) -> DataFrame:
    """The upper triangle of the sample covariance of ``count`` rows, zeros included, as ``i, first, part``, or as ``i, j, v``.

    The product of the means is taken off the finished sums, so that zeros need no entry; means that are large
    against the deviations cost digits.
    """
    held = coo.sparkSession.sparkContext.broadcast(means)

    def finish(cell: Cell) -> Iterator[pa.RecordBatch]:
        at_i, at_j = held.value[cell.rows], held.value[cell.cols]
        for i, block in cell.lines():
            low = int(i[0] - cell.rows[0])
            v = (block - count * np.outer(at_i[low : low + len(i)], at_j)) / (count - 1)
            if cell.diagonal:
                upper = i[:, None] <= cell.cols
                sizes, first, v = upper.sum(1), i, v[upper]
            else:
                sizes, first, v = np.full(len(i), len(cell.cols)), np.full(len(i), cell.cols[0]), v.ravel()
            if cells:
                j = np.nonzero(upper)[1] + cell.cols[0] if cell.diagonal else np.tile(cell.cols, len(i))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, sizes)), pa.array(j), pa.array(v)], names=["i", "j", "v"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(first), _lists(sizes, v)], names=["i", "first", "part"])

    return _triangle(coo, n, True, finish, CELLS if cells else FULL)
