"""Equi-joins that stay balanced when a key holds a large share of all rows.

A key with more than ``limit`` rows is split into ``ceil(rows / limit)`` parts: its rows are
spread over the parts by a hash of other columns, and the rows of the other side are repeated
once per part. The table of split keys is broadcast. It holds at most ``total rows / limit`` keys
of a few bytes each, because every key in it owns more than ``limit`` rows, and the limit grows
with the total so that this is at most a million.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
PARTS = "_parts"
PART = "_part"


# Most split keys that a broadcast may hold when the limit follows from the row count.
MOST_KEYS = 1_000_000


def hot_keys(counts: DataFrame, keys: Sequence[str], rows: str, limit: int = HOT_ROWS) -> DataFrame:
    """Keys of ``counts`` with more than ``limit`` rows, and the number of parts of each.

    The limit is raised to ``total rows / MOST_KEYS`` where that is more, so that there are
    never more than ``MOST_KEYS`` such keys.
    """
    total = counts.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("total")).scalar()
    most = F.greatest(F.lit(limit), F.ceil(total / F.lit(MOST_KEYS)))
    return (
        counts.select(*keys, F.col(rows).alias("_rows"), most.alias("_most"))
        .where("_rows > _most")
        .select(*keys, F.ceil(F.col("_rows") / F.col("_most")).cast("int").alias(PARTS))
    )


def spread_rows(rows: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Sequence[Column]) -> DataFrame:
    """Number the part of each row; rows of ordinary keys are part 0."""
    part = F.when(F.col(PARTS).isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread), F.col(PARTS)).cast("int")
    )
    return rows.join(F.broadcast(hot), list(keys), "left").withColumn(PART, part).drop(PARTS)


def repeat_lookup(lookup: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Repeat the row of each hot key once per part."""
    parts = F.sequence(F.lit(0), F.coalesce(F.col(PARTS), F.lit(1)) - 1)
    return lookup.join(F.broadcast(hot), list(keys), "left").withColumn(PART, F.explode(parts)).drop(PARTS)


def join_hot(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None,
    spread: Sequence[Column],
) -> DataFrame:
    """Inner join on ``keys``; ``hot`` (from :func:`hot_keys`) lists the keys of ``rows`` to split."""
    if hot is None:
        return rows.join(lookup, list(keys))
    left = spread_rows(rows, keys, hot, spread)
    right = repeat_lookup(lookup, keys, hot)
    return left.join(right, [*keys, PART]).drop(PART)


def join_hot_both(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot_left: DataFrame,
    hot_right: DataFrame,
    spread_left: Sequence[Column],
    spread_right: Sequence[Column],
) -> DataFrame:
    """Inner join of two sides with many rows per key: a hot key becomes a grid of parts."""

    def place(rows, spread_hot, spread, repeat_hot, own, other):
        placed = spread_rows(rows, keys, spread_hot, spread).withColumnRenamed(PART, own)
        return repeat_lookup(placed, keys, repeat_hot).withColumnRenamed(PART, other)

    a = place(left, hot_left, spread_left, hot_right, "_part_a", "_part_b")
    b = place(right, hot_right, spread_right, hot_left, "_part_b", "_part_a")
    return a.join(b, [*keys, "_part_a", "_part_b"]).drop("_part_a", "_part_b")
