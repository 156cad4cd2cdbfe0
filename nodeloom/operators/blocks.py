"""Matrices cut into rectangular blocks.

The sparse layout ``bi, bj, r, c, v`` keeps the coordinates inside each block. The dense layout
``bi, bj, n_rows, n_cols, cells`` keeps one column-major array per block; its size is bounded
by the block size, which is checked.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions import vectors
from nodeloom.operators.coo import Shape, summed
from nodeloom.operators.skew import HOT_ROWS, hot_keys, join_hot

# Fixed value: the block edge used when none is given.
BLOCK = 1024
MAX_CELLS = 4_194_304


def to_blocks(coo: DataFrame, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK) -> DataFrame:
    rpb, cpb = F.lit(rows_per_block).cast("bigint"), F.lit(cols_per_block).cast("bigint")
    return coo.select(
        F.floor(F.col("i") / rpb).cast("int").alias("bi"),
        F.floor(F.col("j") / cpb).cast("int").alias("bj"),
        (F.col("i") % rpb).cast("int").alias("r"),
        (F.col("j") % cpb).cast("int").alias("c"),
        "v",
    )


def from_blocks(blocks: DataFrame, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK) -> DataFrame:
    return blocks.select(
        (F.col("bi").cast("bigint") * rows_per_block + F.col("r")).alias("i"),
        (F.col("bj").cast("bigint") * cols_per_block + F.col("c")).alias("j"),
        "v",
    )


def block_counts(dims: Shape, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK) -> Shape:
    """Numbers of block rows and block columns."""
    return Shape(-(-dims.rows // rows_per_block), -(-dims.cols // cols_per_block))


def to_dense_blocks(coo: DataFrame, dims: Shape, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK) -> DataFrame:
    """One column-major array per block that stores a position; repeated positions add up."""
    if rows_per_block * cols_per_block > MAX_CELLS:
        raise ValueError(f"a block may hold at most {MAX_CELLS} cells")
    n_rows = F.least(F.lit(rows_per_block), F.lit(dims.rows) - F.col("bi") * F.lit(rows_per_block)).cast("int")
    n_cols = F.least(F.lit(cols_per_block), F.lit(dims.cols) - F.col("bj") * F.lit(cols_per_block)).cast("int")
    placed = to_blocks(summed(coo), rows_per_block, cols_per_block).withColumns({"n_rows": n_rows, "n_cols": n_cols})
    at = (F.col("c") * F.col("n_rows") + F.col("r")).alias("at")
    grouped = placed.groupBy("bi", "bj", "n_rows", "n_cols").agg(
        F.array_sort(F.collect_list(F.struct(at, "v"))).alias("e")
    )
    stored = F.struct(
        (F.col("n_rows") * F.col("n_cols")).alias("size"),
        F.transform("e", lambda x: x["at"]).alias("indices"),
        F.transform("e", lambda x: x["v"]).alias("values"),
    )
    return grouped.withColumn("s", stored).select(
        "bi", "bj", "n_rows", "n_cols", vectors.to_dense(F.col("s")).alias("cells")
    )


def from_dense_blocks(blocks: DataFrame, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK) -> DataFrame:
    """Dense blocks to coordinates, zeros included."""
    cells = blocks.select("bi", "bj", "n_rows", F.posexplode("cells").alias("at", "v"))
    return cells.select(
        (F.col("bi").cast("bigint") * rows_per_block + F.col("at") % F.col("n_rows")).alias("i"),
        (F.col("bj").cast("bigint") * cols_per_block + F.floor(F.col("at") / F.col("n_rows"))).alias("j"),
        "v",
    )


def violations(blocks: DataFrame, dims: Shape, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK) -> DataFrame:
    """``bi, bj, problem`` for dense blocks outside the matrix, given twice, or of the wrong size."""
    count = block_counts(dims, rows_per_block, cols_per_block)
    want_rows = F.least(F.lit(rows_per_block), F.lit(dims.rows) - F.col("bi") * F.lit(rows_per_block))
    want_cols = F.least(F.lit(cols_per_block), F.lit(dims.cols) - F.col("bj") * F.lit(cols_per_block))
    outside = (
        (F.col("bi") < 0) | (F.col("bj") < 0) | (F.col("bi") >= count.rows) | (F.col("bj") >= count.cols)
    )
    wrong = (
        (F.col("n_rows") != want_rows)
        | (F.col("n_cols") != want_cols)
        | (F.size("cells") != F.col("n_rows") * F.col("n_cols"))
    )
    per_block = blocks.groupBy("bi", "bj").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max(F.when(outside, 1).otherwise(0)).alias("outside"),
        F.max(F.when(wrong, 1).otherwise(0)).alias("wrong"),
    )
    problems = F.filter(
        F.array(
            F.when(F.col("outside") == 1, F.lit("outside the matrix")),
            F.when(F.col("copies") > 1, F.lit("duplicate block")),
            F.when((F.col("wrong") == 1) & (F.col("outside") == 0), F.lit("wrong block size")),
        ),
        lambda p: p.isNotNull(),
    )
    return per_block.select("bi", "bj", F.explode(problems).alias("problem"))


def validate(blocks: DataFrame, dims: Shape, rows_per_block: int = BLOCK, cols_per_block: int = BLOCK) -> None:
    """Raise for the first violation found."""
    found = violations(blocks, dims, rows_per_block, cols_per_block).first()
    if found is not None:
        raise ValueError(f"block ({found.bi}, {found.bj}): {found.problem}")


def multiply_dense(
    a: DataFrame, b: DataFrame, b_cols: int, strip: int = BLOCK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Product of coordinate tables for a dense right side; every column of a touched row is returned.

    The right side is cut into row strips of ``strip`` columns. Each stored position of the left
    side scales a strip, and strips are summed as vectors, before and after the shuffle.
    """
    width = F.least(F.lit(strip), F.lit(b_cols) - F.col("bj") * F.lit(strip)).cast("int")
    entries = F.array_sort(F.collect_list(F.struct("c", "v")))
    strips = (
        b.select(
            F.col("i").alias("k"),
            F.floor(F.col("j") / F.lit(strip)).cast("int").alias("bj"),
            (F.col("j") % strip).cast("int").alias("c"),
            "v",
        )
        .groupBy("k", "bj", "c")
        .agg(F.sum("v").alias("v"))
        .groupBy("k", "bj")
        .agg(entries.alias("e"))
        .withColumn(
            "s",
            F.struct(
                width.alias("size"),
                F.transform("e", lambda x: x["c"]).alias("indices"),
                F.transform("e", lambda x: x["v"]).alias("values"),
            ),
        )
        .select("k", "bj", vectors.to_dense(F.col("s")).alias("strip"))
    )
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("va"))
    hot = hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", hot_rows)
    scaled = join_hot(left, strips, ["k"], hot, [F.col("i")]).select(
        "i", "bj", array_to_vector(F.transform("strip", lambda x: x * F.col("va"))).alias("part")
    )
    return (
        scaled.groupBy("i", "bj")
        .agg(Summarizer.sum(F.col("part")).alias("part"))
        .select("i", "bj", F.posexplode(vector_to_array("part")).alias("c", "v"))
        .select("i", (F.col("bj").cast("bigint") * strip + F.col("c")).alias("j"), "v")
    )
