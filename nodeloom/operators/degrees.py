"""Degree statistics. Nodes without an edge of the asked kind are absent; copies of an edge count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("out", "in", "total", "weighted_out", "weighted_in", "weighted_total")


def degrees(edges: DataFrame, mode: str) -> DataFrame:
    """``nodeid, degree`` for one of :data:`MODES`; weighted modes sum ``weight``."""
    if mode not in MODES:
        raise ValueError(f"unknown degree mode {mode!r}; use one of {', '.join(MODES)}")
    weighted, _, side = mode.rpartition("_")
    measure = F.sum("weight") if weighted else F.count(F.lit(1))
    carried = ["weight"] if weighted else []
    node = {
        "out": F.col("src"),
        "in": F.col("dst"),
        "total": F.explode(F.array("src", "dst")),
    }[side]
    return (
        edges.select(node.alias("nodeid"), *carried)
        .groupBy("nodeid")
        .agg(measure.alias("degree"))
    )


def degree_distribution(degree_table: DataFrame) -> DataFrame:
    """``degree, count``: how many nodes have each degree."""
    return degree_table.groupBy("degree").agg(F.count(F.lit(1)).alias("count"))
