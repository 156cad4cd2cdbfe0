"""The graph and matrix tables that the registered queries derive from the given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.edges import clean_edges


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_edges(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst, weight``: supplier to part, one row per order line; keys start at 0, hence + 1."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("src"),
        (F.col("l_partkey") + 1).alias("dst"),
        F.col("l_quantity").alias("weight"),
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return clean_edges(raw_edges(spark, folder))


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines as text: tabs and spaces, with comments, extra fields and broken lines among them."""
    e = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_suppkey") + 1).cast("string").alias("s"),
        (F.col("l_partkey") + 1).cast("string").alias("p"),
        F.col("l_quantity").cast("string").alias("q"),
    )
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    line = (
        F.when(kind == 0, F.concat(F.lit("# "), F.concat_ws("\t", "s", "p", "q")))
        .when(kind == 1, F.concat_ws(" ", "s", "p", "q"))
        .when(kind == 2, F.concat_ws("\t", "s", "p", "q", F.lit("more")))
        .when(kind == 3, F.concat(F.concat_ws("\t", "s", "p", "q"), F.lit("\r")))
        .when(kind == 4, F.concat_ws("  ", "s", "p", "q"))
        .otherwise(F.concat_ws("\t", "s", "p", "q"))
    )
    return e.select(line.alias("value"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``i, row``: the embedding vectors as doubles."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("row"), "label"
    )


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, a, b``: each vector with the following one; the last has none and is not in the table."""
    v = vectors(spark, folder)
    return v.select(F.col("i").alias("vec_id"), F.col("row").alias("a")).join(
        v.select((F.col("i") - 1).alias("vec_id"), F.col("row").alias("b")), "vec_id"
    )


def order_lines(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """``i, j, v``: a measure of each order line at its order and part group; positions can repeat, most have no row."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("i"), (F.col("l_partkey") % 50).alias("j"), F.col(column).alias("v")
    )


def measure(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """``i, j, v``: a measure of the order lines by supplier and part group."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 50).alias("j"))
        .agg(F.sum(column).alias("v"))
    )


def supplier_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``i, j, v``: the quantity of each part by supplier, for all parts."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def supplier_orders(spark: SparkSession, folder: str) -> DataFrame:
    """``i, j, v``: the quantity of each order by supplier."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("i"), F.col("l_orderkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def nation_orders(spark: SparkSession, folder: str) -> DataFrame:
    """``i, j, v``: the quantity of each order by the supplier's nation: few rows, and a column per order."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy(F.col("s_nationkey").cast("bigint").alias("i"), F.col("l_orderkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def line_places(spark: SparkSession, folder: str) -> DataFrame:
    """``i, j, v``: the quantity at each place of an order: many rows, and a column per line number."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j")).agg(F.sum("l_quantity").alias("v"))
