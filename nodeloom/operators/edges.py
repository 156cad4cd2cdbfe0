"""Edge tables: ``src BIGINT, dst BIGINT`` and, when weighted, ``weight DOUBLE``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame) -> DataFrame:
    """Keep edges whose source is positive and that are no self loop; ``dst`` is not checked."""
    return edges.where((F.col("src") > 0) & (F.col("src") != F.col("dst")))


def reverse_edges(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)


def simple_edges(edges: DataFrame) -> DataFrame:
    """The undirected simple graph, one row ``u < v`` per linked pair."""
    return edges.select(
        F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    ).distinct()


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """The undirected simple graph with both directions of each pair."""
    both = F.explode(
        F.array(
            F.struct(F.col("u").alias("src"), F.col("v").alias("dst")),
            F.struct(F.col("v").alias("src"), F.col("u").alias("dst")),
        )
    )
    return simple_edges(edges).select(both.alias("e")).select("e.src", "e.dst")


def unit_weights(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1).cast("bigint").alias("weight"))


def extremes(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the minimum and maximum of each column, from one pass."""
    return df.agg(
        *[f for c in columns for f in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    )


def needs_flip(max_src: int, max_dst: int) -> bool:
    return max_src > max_dst


def widest_side_as_columns(edges: DataFrame) -> DataFrame:
    """Transpose when the largest source id exceeds the largest destination id."""
    row = extremes(edges, "src", "dst").first()
    if row.max_src is None or not needs_flip(row.max_src, row.max_dst):
        return edges
    return reverse_edges(edges)


def simple_degrees(simple: DataFrame) -> DataFrame:
    """Number of distinct neighbours of each node of ``simple`` (``u, v``)."""
    return (
        simple.select(F.explode(F.array("u", "v")).alias("nodeid"))
        .groupBy("nodeid")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
