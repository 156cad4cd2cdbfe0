"""Matrices as coordinate tables ``i BIGINT, j BIGINT, v DOUBLE``, one row per stored position.

Positions without a row are zero; stored zeros are kept until :func:`drop_zeros`. Several rows of one
position add up wherever a cell is needed as one value; :func:`summed` does it beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.vectors import to_dense
from nodeloom.operators import squares
from nodeloom.operators.skew import hot_keys, join_hot, join_hot_both
from nodeloom.runtime import shuffle_partitions

# Most columns of a covariance made of joined tiles, those beyond which it is made in cells of a grid, most
# numbers, one per column, on the driver, and longest array that a row can hold.
MAX_COLUMNS = 65_535
GRID_COLUMNS = 4_096
MAX_SUMS = 16_777_216
MAX_ARRAY = 2**31 - 16
# Edge of the tiles that a task multiplies, and most tiles a side that meet in one part.
TILE = 32
TILES_PER_PART = 64
# Products a cell of the result from which a product is made in cells of a grid, cells of the result that a task
# holds at most and usually, and entries of both sides that it reads.
GRID_PRODUCTS = 4
GRID_CELLS = 4_194_304
GRID_CELLS_USUAL = 262_144
GRID_ENTRIES = 500_000
# Pairs of entries, or cells of dense pieces, that a task multiplies at once.
GRID_STEP = 4_000_000
# Edge of the tiles that a covariance is made of.
COVARIANCE_TILE = 128


class Shape(NamedTuple):
    rows: int
    cols: int


def coordinate_table(df: DataFrame, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    return df.select(
        F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), F.col(v).cast("double").alias("v")
    )


def from_rows(rows: DataFrame, i: str = "i", row: str = "row") -> DataFrame:
    """Indexed dense rows to coordinates; zeros are kept."""
    return coordinate_table(rows.select(F.col(i).alias("i"), F.posexplode(row).alias("j", "v")))


def dimensions(coo: DataFrame) -> DataFrame:
    """One row ``n_rows, n_cols``: the largest indices plus one."""
    return coo.agg(
        (F.coalesce(F.max("i"), F.lit(-1)) + 1).alias("n_rows"),
        (F.coalesce(F.max("j"), F.lit(-1)) + 1).alias("n_cols"),
    )


def shape(coo: DataFrame, rows: int | None = None, cols: int | None = None) -> Shape:
    """The dimensions as numbers; a given one wins over the computed one."""
    if rows is not None and cols is not None:
        return Shape(rows, cols)
    found = dimensions(coo).first()
    return Shape(rows if rows is not None else found.n_rows, cols if cols is not None else found.n_cols)


def summed(coo: DataFrame) -> DataFrame:
    """One row per stored position."""
    return coo.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _require_same(a: Shape | None, b: Shape | None) -> None:
    if a is not None and b is not None and a != b:
        raise ValueError(f"shapes differ: {tuple(a)} and {tuple(b)}")


def add(a: DataFrame, b: DataFrame, a_shape: Shape | None = None, b_shape: Shape | None = None) -> DataFrame:
    _require_same(a_shape, b_shape)
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def subtract(a: DataFrame, b: DataFrame, a_shape: Shape | None = None, b_shape: Shape | None = None) -> DataFrame:
    _require_same(a_shape, b_shape)
    return add(a, b.withColumn("v", -F.col("v")))


def multiply(
    a: DataFrame,
    b: DataFrame,
    a_shape: Shape | None = None,
    b_shape: Shape | None = None,
) -> DataFrame:
    """Matrix product: a row for every position that some pair of stored positions contributes to."""
    if a_shape is not None and b_shape is not None and a_shape.cols != b_shape.rows:
        raise ValueError(f"cannot multiply {tuple(a_shape)} by {tuple(b_shape)}")
    grid = _grid(a, b)
    if grid is not None:
        return _grid_products(summed(a), summed(b), grid)
    left = _tiles(a, "i", "j", "bi", "a")
    return _tile_products(left, _tiles(b, "j", "i", "bj", "b"), upper=False)


class Grid(NamedTuple):
    """A product in ``rows * cols * inner`` cells; ``height`` and ``width`` of the part of the result that a cell makes."""

    rows: int
    cols: int
    inner: int
    top: int
    side: int
    height: int
    width: int


def _grid(a: DataFrame, b: DataFrame) -> Grid | None:
    """The grid of a product whose cells of the result get many products each; None for others and for NULL positions."""
    per = a.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("na")).join(b.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("nb")), "k")
    met = per.agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products")).first().products or 0.0
    lo_hi = lambda x, c: x.agg(F.min(c), F.max(c), F.count(F.lit(1)), F.count_if(F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull())).first()
    (top, bottom, n_a, null_a), (side, end, n_b, null_b) = lo_hi(a, "i"), lo_hi(b, "j")
    if not met or null_a or null_b:
        return None
    height, width = bottom - top + 1, end - side + 1
    if met < GRID_PRODUCTS * height * width:
        return None
    few = shuffle_partitions(a.sparkSession)
    cells = max(-(-height * width // GRID_CELLS), min(few, -(-height * width // GRID_CELLS_USUAL)))
    # A goes to every part of the columns, B to every part of the rows: both as often as their entries allow.
    cols = min(width, max(1, round(math.sqrt(cells * n_b / n_a))))
    rows = min(height, -(-cells // cols))
    cols = min(width, -(-cells // rows))
    inner = max(1, (n_a * cols + n_b * rows) // (rows * cols * GRID_ENTRIES))
    return Grid(rows, cols, inner, top, side, -(-height // rows), -(-width // cols))


def _grid_products(a: DataFrame, b: DataFrame, grid: Grid) -> DataFrame:
    """Multiply entries of one row per position cell by cell of a grid; a cell of the result leaves its task once per inner part."""

    def dealt(x: DataFrame, outer: str, first: int, inner: str, own: int, other: int, is_a: bool) -> DataFrame:
        at = F.col(outer) - F.lit(first)
        mine, theirs = F.pmod(at, F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        placed = x.select(
            mine.alias("mine"), theirs.alias("theirs"), F.pmod(F.xxhash64(inner), F.lit(grid.inner)).alias("part"),
            ((at - mine) / F.lit(own)).cast("int").alias("o"), F.col(inner).alias("k"), "v",
        )
        r, c = ("mine", "theirs") if is_a else ("theirs", "mine")
        cell = ((F.col(r) * F.lit(grid.cols) + F.col(c)) * F.lit(grid.inner) + F.col("part")).cast("bigint")
        return placed.select(cell.alias("cell"), F.lit(not is_a).alias("right"), "k", "o", "v")

    def product(right: np.ndarray, k: np.ndarray, o: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a_k, a_o, a_v, b_k, b_o, b_v = (x[side] for side in (~right, right) for x in (k, o, v))
        common = np.intersect1d(a_k, b_k)
        value, hits = np.zeros(grid.height * grid.width), np.zeros(grid.height * grid.width, dtype=bool)
        in_a, in_b = np.isin(a_k, common), np.isin(b_k, common)
        a_k, a_o, a_v = np.searchsorted(common, a_k[in_a]), a_o[in_a], a_v[in_a]
        b_k, b_o, b_v = np.searchsorted(common, b_k[in_b]), b_o[in_b], b_v[in_b]
        begin = np.searchsorted(b_k, a_k)
        many = np.searchsorted(b_k, a_k, "right") - begin
        ends = np.cumsum(many)
        if not len(common):
            return value, hits
        if grid.height * grid.width * len(common) <= 16 * int(ends[-1]):
            step = max(1, GRID_STEP // (grid.height + grid.width))
            for first in range(0, len(common), step):
                (x, xs), (y, ys) = ((np.zeros((n, step)), np.zeros((n, step), np.float32)) for n in (grid.height, grid.width))
                for own_k, own_o, own_v, dense, stored in ((a_k, a_o, a_v, x, xs), (b_k, b_o, b_v, y, ys)):
                    some = slice(*np.searchsorted(own_k, [first, first + step]))
                    dense[own_o[some], own_k[some] - first] = own_v[some]
                    stored[own_o[some], own_k[some] - first] = 1.0
                value += (x @ y.T).ravel()
                hits |= (xs @ ys.T).ravel() > 0
            return value, hits
        low = 0
        while low < len(a_k):
            done = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + GRID_STEP, "right")))
            n = many[low:high]
            at = np.arange(n.sum()) + np.repeat(begin[low:high] - (ends[low:high] - n - done), n)
            places = np.repeat(a_o[low:high].astype(np.int64) * grid.width, n) + b_o[at]
            value += np.bincount(places, np.repeat(a_v[low:high], n) * b_v[at], len(value))
            hits[places] = True
            low = high
        return value, hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, parts in _cells_in_order(batches):
            value, hits = product(*parts)
            r, c = divmod(cell // grid.inner, grid.cols)
            found = np.flatnonzero(hits)
            for start in range(0, len(found), GRID_STEP // 4):
                at = found[start : start + GRID_STEP // 4]
                i, j = at // grid.width * grid.rows + r + grid.top, at % grid.width * grid.cols + c + grid.side
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(value[at])], names=["i", "j", "v"])

    both = dealt(a, "i", grid.top, "j", grid.rows, grid.cols, True).unionByName(dealt(b, "j", grid.side, "i", grid.cols, grid.rows, False))
    cells = both.repartition("cell").sortWithinPartitions("cell", "right", "k").mapInArrow(run, "i bigint, j bigint, v double")
    return summed(cells) if grid.inner > 1 else cells


def _cells_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The first column's values one after the other with the other columns, from rows in its order."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        cell, *rest = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(batch.num_columns))
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and cell[low] != last:
                yield int(last), tuple(np.concatenate(part) for part in zip(*held))
                held = []
            held.append([part[low:high] for part in rest])
            last = cell[low]
    if held:
        yield int(last), tuple(np.concatenate(part) for part in zip(*held))


def upper_gramian(coo: DataFrame) -> DataFrame:
    """The cells ``i <= j`` of AᵀA over stored positions."""
    left = _tiles(coo, "j", "i", "bi", "a")
    return _tile_products(left, _tiles(coo, "j", "i", "bj", "b"), upper=True).where("i <= j")


def gramian(coo: DataFrame) -> DataFrame:
    """AᵀA over stored positions. Only the upper triangle is formed, then mirrored."""
    return mirror_upper(upper_gramian(coo))


def join_columns(coo: DataFrame, facts: DataFrame) -> DataFrame:
    """Each entry with the row of ``facts`` of its column ``j``; columns of very many entries are split."""
    hot = hot_keys(coo.groupBy("j").agg(F.count(F.lit(1)).alias("n")), ["j"], "n")
    return join_hot(coo, facts, ["j"], hot, [F.col("i")])


def _tiles(coo: DataFrame, outer: str, inner: str, block: str, name: str) -> DataFrame:
    """Square tiles ``bk, <block>, <name>_at, <name>_v`` with the summed index laid out first."""
    edge = F.lit(TILE).cast("bigint")
    at = (F.col(inner) % edge * edge + F.col(outer) % edge).cast("int").alias("at")
    return (
        coo.select(
            F.floor(F.col(inner) / edge).cast("bigint").alias("bk"),
            F.floor(F.col(outer) / edge).cast("bigint").alias(block),
            F.struct(at, F.col("v")).alias("e"),
        )
        .groupBy("bk", block)
        .agg(F.collect_list("e").alias("e"))
        .select("bk", block, F.col("e.at").alias(f"{name}_at"), F.col("e.v").alias(f"{name}_v"))
    )


def _tile_products(left: DataFrame, right: DataFrame, upper: bool) -> DataFrame:
    """Multiply tiles of equal ``bk`` pair by pair in the tasks and sum the results.

    Many tiles of one ``bk`` are split into a grid of parts of at most ``TILES_PER_PART``
    tiles a side. A task adds the products of a batch per result tile before they are shuffled.
    """

    def hot(side: DataFrame) -> DataFrame:
        return hot_keys(side.groupBy("bk").agg(F.count(F.lit(1)).alias("n")), ["bk"], "n", TILES_PER_PART)

    pairs = join_hot_both(left, right, ["bk"], hot(left), hot(right), [F.col("bi")], [F.col("bj")])
    if upper:
        pairs = pairs.where("bi <= bj")

    def tile(at: np.ndarray, v) -> np.ndarray:
        # Several entries of one position add up.
        out = np.zeros(TILE * TILE)
        np.add.at(out, at, v)
        return out.reshape(TILE, TILE)

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy(zero_copy_only=False)

    def cells(sums: dict) -> pa.RecordBatch:
        found = []
        for (bi, bj), (value, hits) in sums.items():
            r, c = np.nonzero(hits)
            found.append((bi * TILE + r, bj * TILE + c, value[r, c]))
        i, j, v = (np.concatenate(part) for part in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bi, bj = (batch.column(k).to_numpy() for k in (0, 1))
            (a_ends, a_at), (_, a_v), (b_ends, b_at), (_, b_v) = (lists(batch.column(k)) for k in (2, 3, 4, 5))
            sums: dict = {}
            for n in range(batch.num_rows):
                in_a, in_b = slice(a_ends[n], a_ends[n + 1]), slice(b_ends[n], b_ends[n + 1])
                value = tile(a_at[in_a], a_v[in_a]).T @ tile(b_at[in_b], b_v[in_b])
                hits = tile(a_at[in_a], 1.0).T @ tile(b_at[in_b], 1.0)
                key = (int(bi[n]), int(bj[n]))
                if key in sums:
                    value, hits = value + sums[key][0], hits + sums[key][1]
                sums[key] = (value, hits)
            if sums:
                yield cells(sums)

    parts = pairs.select("bi", "bj", "a_at", "a_v", "b_at", "b_v").mapInArrow(products, "i bigint, j bigint, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def mirror_upper(upper: DataFrame) -> DataFrame:
    """The symmetric matrix whose upper triangle (diagonal included) is given."""
    own = F.struct("i", "j", "v")
    other = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    cells = F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, other))
    return upper.select(F.explode(cells).alias("c")).select("c.*")


def column_summary(coo: DataFrame, dims: Shape) -> DataFrame:
    """Per column ``j``: mean, sample variance, count, nnz, max, min, l1, l2 over all rows of the matrix.

    Every column of ``dims`` has a row, those without a stored position too.
    """
    n_rows = dims.rows
    n = F.lit(float(n_rows))
    found = summed(coo).groupBy("j").agg(
        F.sum("v").alias("total"),
        F.sum(F.col("v") * F.col("v")).alias("squares"),
        F.sum(F.abs("v")).alias("l1"),
        F.count_if(F.col("v") != 0).alias("nnz"),
        F.max("v").alias("top"),
        F.min("v").alias("bottom"),
        F.count(F.lit(1)).alias("stored"),
        F.var_samp("v").alias("var_stored"),
        F.avg("v").alias("avg_stored"),
    )
    columns = coo.sparkSession.range(dims.cols).select(F.col("id").alias("j"))
    zero = {"total": 0.0, "squares": 0.0, "l1": 0.0, "nnz": 0, "top": 0.0, "bottom": 0.0, "stored": 0, "avg_stored": 0.0}
    stored = columns.join(found, "j", "left").fillna(zero)
    mean = F.col("total") / n
    held, absent = F.col("stored"), n - F.col("stored")
    # Sum of squared deviations: those of the stored values, plus the shift to the common mean.
    within = F.coalesce("var_stored", F.lit(0.0)) * F.greatest(held - 1, F.lit(0))
    between = held * F.pow(F.col("avg_stored") - mean, 2) + absent * F.pow(mean, 2)
    return stored.select(
        "j",
        mean.alias("mean"),
        (F.lit(0.0) if n_rows < 2 else (within + between) / (n - 1)).alias("variance"),
        F.lit(n_rows).cast("bigint").alias("count"),
        "nnz",
        F.when(absent > 0, F.greatest("top", F.lit(0.0))).otherwise(F.col("top")).alias("max"),
        F.when(absent > 0, F.least("bottom", F.lit(0.0))).otherwise(F.col("bottom")).alias("min"),
        "l1",
        F.sqrt("squares").alias("l2"),
    )


def column_cosines(gram: DataFrame) -> DataFrame:
    """Cosine of each column pair ``i < j`` from a Gramian; a zero column has cosine 0."""
    norms = gram.where("i = j").select(F.col("i").alias("c"), F.sqrt("v").alias("norm"))
    upper = gram.where("i < j")
    paired = upper.join(norms.select(F.col("c").alias("i"), F.col("norm").alias("ni")), "i").join(
        norms.select(F.col("c").alias("j"), F.col("norm").alias("nj")), "j"
    )
    size = F.col("ni") * F.col("nj")
    return paired.select("i", "j", F.when(size == 0, 0.0).otherwise(F.col("v") / size).alias("v"))


def covariance(coo: DataFrame, dims: Shape) -> DataFrame:
    """Sample covariance of the columns; columns that share no row have one too, so all pairs are returned."""
    return mirror_upper(covariance_upper(coo, dims))


def has_gaps(coo: DataFrame) -> bool:
    """Whether a position or value is NULL, or a value no number."""
    gap = F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull() | F.isnan("v")
    return bool(coo.where(gap).limit(1).count())


def column_sums(coo: DataFrame, n: int, of) -> np.ndarray:
    """The sum of an expression per column, for all ``n`` columns on the driver."""
    if n > MAX_SUMS:
        raise ValueError(f"{n} columns exceed the limit of {MAX_SUMS} sums on the driver")
    found = coo.groupBy("j").agg(F.sum(of).alias("total")).toArrow()
    sums = np.zeros(n)
    sums[found["j"].to_numpy()] = found["total"].to_numpy()
    return sums


def covariance_upper(coo: DataFrame, dims: Shape) -> DataFrame:
    """The cells ``i <= j`` of the sample covariance.

    They are made tile by tile from the column means, at most ``MAX_COLUMNS`` numbers that go to the tasks, and
    from the stored products of the tile: only tiles are joined, never cells. With more than ``GRID_COLUMNS`` columns
    and no NULL a task makes larger squares from the entries of their columns, and no product is shuffled.
    """
    if dims.rows < 2:
        raise ValueError("covariance needs at least two rows")
    if dims.cols > GRID_COLUMNS and not has_gaps(coo):
        return squares.covariance_upper(summed(coo), dims.cols, dims.rows, column_sums(coo, dims.cols, F.col("v")) / dims.rows, cells=True)
    if dims.cols > MAX_COLUMNS:
        raise ValueError(f"{dims.cols} columns exceed the limit of {MAX_COLUMNS}")
    found = coo.groupBy("j").agg(F.sum("v").alias("total")).toArrow()
    means = np.zeros(dims.cols)
    means[found["j"].to_numpy()] = found["total"].to_numpy() / dims.rows
    n, cols, count = dims.rows, dims.cols, -(-dims.cols // COVARIANCE_TILE)
    edge = F.lit(COVARIANCE_TILE).cast("bigint")
    at = (F.col("i") % edge * edge + F.col("j") % edge).cast("int").alias("at")
    held = upper_gramian(coo).select((F.col("i") - F.col("i") % edge).alias("top"), (F.col("j") - F.col("j") % edge).alias("side"), F.struct(at, "v").alias("e"))
    tiles = held.groupBy("top", "side").agg(F.collect_list("e").alias("e")).select("top", "side", "e.at", "e.v")
    row = ((F.col("id") - F.col("id") % count) / count).cast("bigint")
    grid = coo.sparkSession.range(count * count).select((row * edge).alias("top"), (F.col("id") % count * edge).alias("side")).where("top <= side")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, sides = (batch.column(k).to_numpy() for k in (0, 1))
            for k in range(batch.num_rows):
                i = np.arange(tops[k], min(tops[k] + COVARIANCE_TILE, cols))
                j = np.arange(sides[k], min(sides[k] + COVARIANCE_TILE, cols))
                products = np.zeros(COVARIANCE_TILE * COVARIANCE_TILE)
                if batch.column(2)[k].is_valid:
                    products[batch.column(2)[k].values.to_numpy()] = batch.column(3)[k].values.to_numpy()
                cells = products.reshape(COVARIANCE_TILE, -1)[: len(i), : len(j)] - n * np.outer(means[i], means[j])
                keep = i[:, None] <= j
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(i[r]), pa.array(j[c]), pa.array(cells[keep] / (n - 1))], names=["i", "j", "v"])

    return grid.join(tiles, ["top", "side"], "left").select("top", "side", "at", "v").mapInArrow(expand, "i bigint, j bigint, v double")


def drop_zeros(coo: DataFrame) -> DataFrame:
    return coo.where(F.col("v") != 0)


def fill_zeros(coo: DataFrame, dims: Shape) -> DataFrame:
    """A row for every position of the matrix."""
    cells = dims.rows * dims.cols
    width = F.lit(dims.cols).cast("bigint")
    # Whole-number division: the quotient of two doubles is not exact for many cells.
    row = ((F.col("id") - F.col("id") % width) / width).cast("bigint")
    grid = coo.sparkSession.range(cells).select(row.alias("i"), (F.col("id") % width).alias("j"))
    return grid.join(summed(coo), ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def to_sparse_rows(coo: DataFrame, n_cols: int, piece: int | None = None) -> DataFrame:
    """``i, row`` with sparse vectors, for the rows that store a position.

    A row of the matrix becomes one value, so the width is limited by the longest array; use
    :func:`nodeloom.operators.blocks.to_blocks` beyond it. With ``piece`` a row comes in vectors of
    full size that each hold the positions of so many columns, which keeps long rows small.
    """
    if n_cols > MAX_ARRAY:
        raise ValueError(f"{n_cols} columns are too many for one vector per row (limit {MAX_ARRAY}); use blocks")
    entries = F.array_sort(F.collect_list(F.struct("j", "v")))
    keys = ["i"] if piece is None else ["i", F.floor(F.col("j") / F.lit(piece)).alias("piece")]
    return summed(coo).groupBy(*keys).agg(entries.alias("e")).select(
        "i",
        F.struct(
            F.lit(n_cols).cast("int").alias("size"),
            F.transform("e", lambda x: x["j"].cast("int")).alias("indices"),
            F.transform("e", lambda x: x["v"]).alias("values"),
        ).alias("row"),
    )


def to_dense_rows(coo: DataFrame, n_cols: int) -> DataFrame:
    """``i, row`` with dense vectors, for the rows that store a position; drop ``i`` for a plain row matrix."""
    return to_sparse_rows(coo, n_cols).select("i", to_dense(F.col("row")).alias("row"))


def from_sparse_rows(rows: DataFrame) -> DataFrame:
    """Sparse rows (``i, row``) to coordinates, stored zeros included."""
    entries = F.explode(F.arrays_zip("row.indices", "row.values"))
    return rows.select("i", entries.alias("e")).select(
        "i", F.col("e.indices").cast("bigint").alias("j"), F.col("e.values").alias("v")
    )


def store(coo: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    return coo.persist(level)


def to_local(coo: DataFrame, dims: Shape, max_cells: int = 4_000_000) -> np.ndarray:
    """The matrix as a numpy array, when it has at most ``max_cells`` positions."""
    if dims.rows * dims.cols > max_cells:
        raise ValueError(f"{dims.rows} x {dims.cols} positions exceed the limit of {max_cells}")
    out = np.zeros(dims)
    cells = coo.select("i", "j", "v").toArrow()
    np.add.at(out, (cells["i"].to_numpy(), cells["j"].to_numpy()), cells["v"].to_numpy())
    return out


def from_local(spark: SparkSession, matrix) -> DataFrame:
    """A small numpy matrix as a coordinate table, zeros included."""
    held = np.asarray(matrix, dtype=float)
    i, j = (at.ravel() for at in np.indices(held.shape))
    return spark.createDataFrame(pa.table({"i": i, "j": j, "v": held.ravel()}))
