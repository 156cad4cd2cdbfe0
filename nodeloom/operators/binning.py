"""Equal-width bins over the range of a column.

Bin ``b`` of ``n`` covers ``[lo + b*(hi-lo)/n, lo + (b+1)*(hi-lo)/n)`` and the last one also
holds ``hi``. When all values are equal there is one bin, centred on that value. The range is
an uncorrelated scalar subquery, so nothing is collected to plan it; the input is read once
for the range and once for the bins, so hand in a stored table when it is costly to compute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _range(df: DataFrame, columns: Sequence[str]) -> Column:
    """Scalar struct with the fields ``lo_<column>`` and ``hi_<column>``."""
    fields = [
        f for c in columns for f in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))
    ]
    return df.agg(F.struct(*fields).alias("bin_range")).scalar()


def bin_index(value: Column, lo: Column, hi: Column, n: int) -> Column:
    raw = F.floor((value - lo) / ((hi - lo) / F.lit(n)))
    inside = F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1)).cast("int")
    return F.when(value.isNull(), F.lit(None).cast("int")).when(hi == lo, F.lit(0)).otherwise(inside)


def bin_center(index: Column, lo: Column, hi: Column, n: int) -> Column:
    return F.when(index.isNull(), F.lit(None).cast("double")).when(hi == lo, lo.cast("double")).otherwise(
        lo + (index + F.lit(0.5)) * (hi - lo) / F.lit(n)
    )


def add_bins(df: DataFrame, columns: Sequence[str], n: int = 1000) -> DataFrame:
    """Add ``<column>_bin`` (0-based index) and ``<column>_t`` (bin centre) for every column."""
    if not columns:
        return df
    ranged = df.withColumn("_range", _range(df, columns))

    def edge(kind: str, c: str) -> Column:
        return F.col(f"_range.{kind}_{c}")

    indexed = ranged.withColumns(
        {f"{c}_bin": bin_index(F.col(c), edge("lo", c), edge("hi", c), n) for c in columns}
    )
    centred = indexed.withColumns(
        {f"{c}_t": bin_center(F.col(f"{c}_bin"), edge("lo", c), edge("hi", c), n) for c in columns}
    )
    return centred.drop("_range")


def histogram(df: DataFrame, column: str, n: int = 1000) -> DataFrame:
    """``bin, center, count`` with a row for every bin, empty ones included."""
    lo, hi = (_range(df, [column]).getField(f"{side}_{column}") for side in ("lo", "hi"))
    counts = (
        add_bins(df.select(column), [column], n)
        .where(F.col(f"{column}_bin").isNotNull())
        .groupBy(F.col(f"{column}_bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    bins = (
        df.sparkSession.range(n)
        .select(F.col("id").cast("int").alias("bin"), lo.alias("lo"), hi.alias("hi"))
        .where(F.col("lo").isNotNull() & ((F.col("hi") > F.col("lo")) | (F.col("bin") == 0)))
        .select("bin", bin_center(F.col("bin"), F.col("lo"), F.col("hi"), n).alias("center"))
    )
    return bins.join(counts, "bin", "left").select(
        "bin", "center", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def with_bin_counts(binned: DataFrame, column: str, name: str) -> DataFrame:
    """Add to each row the number of rows in its bin of ``column``.

    The counts hold at most one row per bin, hence the broadcast.
    """
    index = f"{column}_bin"
    counts = binned.groupBy(index).agg(F.count(F.lit(1)).alias(name))
    return binned.join(F.broadcast(counts), index, "left")
