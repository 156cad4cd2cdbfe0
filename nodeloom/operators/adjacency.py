"""Adjacency and transposed rows. Long rows are cut into chunks, so no row of a hot node is one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536


def column_vectors(rows: DataFrame, i: str = "i", row: str = "row", chunk: int = CHUNK) -> DataFrame:
    """Transpose dense rows: ``j, chunk, cells`` with the values of column ``j`` in row order.

    Chunk ``c`` holds the rows ``c*chunk .. (c+1)*chunk - 1`` that exist.
    """
    cells = rows.select(F.col(i).alias("i"), F.posexplode(row).alias("j", "v")).select(
        F.col("j").cast("bigint").alias("j"),
        F.floor(F.col("i") / F.lit(chunk)).cast("bigint").alias("chunk"),
        F.struct("i", F.col("v").cast("double").alias("v")).alias("e"),
    )
    return (
        cells.groupBy("j", "chunk")
        .agg(F.array_sort(F.collect_list("e")).alias("e"))
        .select("j", "chunk", F.transform("e", lambda x: x["v"]).alias("cells"))
    )


def adjacency_rows(edges: DataFrame, chunk: int = CHUNK, pad: bool = False) -> DataFrame:
    """Binary sparse rows ``i, chunk, indices`` of the adjacency matrix, 0-based and sorted.

    Chunk ``c`` holds the columns ``c*chunk .. (c+1)*chunk - 1``, copies of an edge count once.
    ``pad`` adds an empty chunk 0 for the rows without an edge, up to the largest source.
    """
    places = edges.select(
        (F.col("src") - 1).alias("i"),
        F.floor((F.col("dst") - 1) / F.lit(chunk)).cast("bigint").alias("chunk"),
        (F.col("dst") - 1).alias("j"),
    )
    rows = places.groupBy("i", "chunk").agg(F.array_sort(F.collect_set("j")).alias("indices"))
    if not pad:
        return rows
    last = edges.agg(F.max("src").alias("m")).first().m or 0
    missing = edges.sparkSession.range(last).select(F.col("id").alias("i")).join(rows.select("i").distinct(), "i", "left_anti")
    return rows.unionByName(
        missing.select("i", F.lit(0).cast("bigint").alias("chunk"), F.array().cast("array<bigint>").alias("indices"))
    )
