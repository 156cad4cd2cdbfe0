"""Every registered query: name to a function of the session and the data folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.functions import vectors as V
from nodeloom.operators import adjacency, binning, blocks, clustering, coo, cubes, degrees, edges, ego, embedding, factor, rotations, rowmatrix
from nodeloom.operators.pagerank import pagerank
from nodeloom.plans import report, tables
from nodeloom.runtime import cut_lineage, lifetime, work_path
from nodeloom.sources import edge_lists, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The digits that results are compared at, and the part groups of a measure.
RANK_DIGITS = 12
CC_DIGITS = 9
SUM_DIGITS = 6
# Share of a value that its own rounding can reach.
TIES = 1e-9
GROUPS = 50


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round, with negative zero turned into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# -- sources and sinks ---------------------------------------------------------------------


@query("s1_parse_edges")
def _(spark, d):
    return edge_lists.parse_edges(tables.edge_lines(spark, d))


@query("s1_rejected_lines")
def _(spark, d):
    return edge_lists.rejected_lines(tables.edge_lines(spark, d)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("s2_parse_weighted_edges")
def _(spark, d):
    return edge_lists.parse_edges(tables.edge_lines(spark, d), weighted=True)


def _edge_file(spark, d) -> str:
    """The order lines as text files below the shared folder."""
    path = work_path(spark, "edges")
    tables.edge_lines(spark, d).write.text(path)
    return path


@query("s1_read_edge_file")
def _(spark, d):
    return edge_lists.read_edges(spark, _edge_file(spark, d))


@query("s2_read_weighted_edge_file")
def _(spark, d):
    return edge_lists.read_edges(spark, _edge_file(spark, d), weighted=True)


@query("g19_report_by_flags")
def _(spark, d):
    """Degrees, their distribution and PageRank, chosen by flags, as the report writes them; all read back."""
    path = work_path(spark, "report")
    report.write_report(tables.edges(spark, d), path, report.ReportOptions(total_degree=True, degree_vs_count=True, svd=False, combined=False))
    degrees_ = spark.read.schema("a bigint, b bigint").option("sep", "\t").csv(f"{path}/total_degree").withColumn("part", F.lit("total_degree"))
    counts = spark.read.schema("a bigint, b bigint").option("sep", "\t").csv(f"{path}/degree_vs_count").withColumn("part", F.lit("degree_vs_count"))
    return degrees_.unionByName(counts)


@query("s5_tsv_round_trip")
def _(spark, d):
    path = work_path(spark, "total-degree")
    sinks.write_tsv(degrees.degrees(tables.edges(spark, d), "total"), path)
    return spark.read.schema("nodeid bigint, degree bigint").option("sep", "\t").csv(path)


@query("s6_csv_round_trip")
def _(spark, d):
    path = work_path(spark, "degree-counts")
    counts = report.degree_vs_count(tables.edges(spark, d))
    sinks.write_csv(counts, path)
    return spark.read.schema("degree bigint, `count` bigint").csv(path)


@query("s7_csv_line")
def _(spark, d):
    return degrees.degrees(tables.edges(spark, d), "out").select(sinks.csv_line("nodeid", "degree").alias("line"))


@query("s8_unit_weight_edges")
def _(spark, d):
    return edges.unit_weights(tables.edges(spark, d))


# -- projections and reshaping -------------------------------------------------------------


@query("p1_clean_edges")
def _(spark, d):
    return tables.edges(spark, d)


@query("p2_reverse_edges")
def _(spark, d):
    return edges.reverse_edges(tables.edges(spark, d))


@query("p3_simple_edges")
def _(spark, d):
    return edges.simple_edges(tables.edges(spark, d))


@query("p3_symmetric_edges")
def _(spark, d):
    return edges.symmetric_edges(tables.edges(spark, d))


@query("p7_column_vectors")
def _(spark, d):
    columns = adjacency.column_vectors(tables.vectors(spark, d), chunk=256)
    return columns.select("j", "chunk", F.posexplode("cells").alias("position", "v"))


@query("p8_adjacency_rows")
def _(spark, d):
    rows = adjacency.adjacency_rows(tables.edges(spark, d), chunk=512, pad=True)
    return rows.select("i", "chunk", F.size("indices").alias("n"), F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices"))


@query("p9_wide_orientation")
def _(spark, d):
    return edges.widest_side_as_columns(edges.reverse_edges(tables.edges(spark, d)))


# -- degrees -------------------------------------------------------------------------------

for _name, _mode in {
    "a1_out_degree": "out",
    "a2_in_degree": "in",
    "a3_total_degree": "total",
    "a4_weighted_out_degree": "weighted_out",
    "a5_weighted_in_degree": "weighted_in",
    "a6_weighted_total_degree": "weighted_total",
}.items():
    QUERIES[_name] = lambda spark, d, mode=_mode: degrees.degrees(tables.edges(spark, d), mode)


@query("a7_degree_distribution")
def _(spark, d):
    return report.degree_vs_count(tables.edges(spark, d))


@query("a9_extremes")
def _(spark, d):
    return edges.extremes(degrees.degrees(tables.edges(spark, d), "total"), "nodeid", "degree")


@query("a10_largest_ids")
def _(spark, d):
    return edges.extremes(tables.edges(spark, d), "src", "dst")


# -- bins ----------------------------------------------------------------------------------


@query("b1_degree_histogram")
def _(spark, d):
    return rounded(binning.histogram(degrees.degrees(tables.edges(spark, d), "total"), "degree", 100), 9, "center")


@query("b3_degree_bins")
def _(spark, d):
    binned = binning.add_bins(degrees.degrees(tables.edges(spark, d), "total"), ["degree"], 100)
    return rounded(binned, 9, "degree_t")


@query("b3_value_bins")
def _(spark, d):
    lines = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return rounded(binning.add_bins(lines, ["l_extendedprice", "l_discount"], 64), 6, "l_extendedprice_t", "l_discount_t")


# -- graph statistics ----------------------------------------------------------------------


def _ranks(spark, d, weighted=False):
    ranks = pagerank(tables.edges(spark, d), weighted=weighted)
    return rounded(ranks, RANK_DIGITS, "pagerank")


@query("g1_pagerank")
def _(spark, d):
    return _ranks(spark, d)


@query("g1_pagerank_node_count")
def _(spark, d):
    return rounded(pagerank(tables.edges(spark, d), n_mode="count"), RANK_DIGITS, "pagerank")


@query("g2_weighted_pagerank")
def _(spark, d):
    return _ranks(spark, d, weighted=True)


@query("g3_neighbour_degrees")
def _(spark, d):
    return clustering.neighbour_degrees(tables.edges(spark, d))


@query("g4_ordered_neighbours")
def _(spark, d):
    lists = clustering.ordered_neighbour_lists(tables.edges(spark, d))
    return lists.select("nodeid", "degree", F.concat_ws(",", F.col("later").cast("array<string>")).alias("later"))


@query("g5_wedge_candidates")
def _(spark, d):
    found = clustering.wedge_candidates(clustering.neighbours(edges.simple_edges(tables.edges(spark, d))).lists)
    return found.select("x", "y", F.size("rest").alias("n"), F.aggregate("rest", F.lit(0).cast("bigint"), lambda a, z: a + z).alias("id_sum"))


@query("g6_triangles")
def _(spark, d):
    return clustering.triangles(tables.edges(spark, d))


@query("g6_triangle_counts")
def _(spark, d):
    return clustering.triangle_counts(tables.edges(spark, d))


@query("g6_triangles_cells")
def _(spark, d):
    return cubes.triangles(tables.edges(spark, d))


@query("g6_triangle_counts_cells")
def _(spark, d):
    return cubes.triangle_counts(tables.edges(spark, d))


@query("g7_local_clustering")
def _(spark, d):
    return rounded(clustering.local_clustering(tables.edges(spark, d)), CC_DIGITS, "cc")


@query("g8_average_clustering")
def _(spark, d):
    average = clustering.average_clustering(clustering.local_clustering(tables.edges(spark, d)))
    return rounded(average, CC_DIGITS, "avg_cc", "mean_cc")


@query("g9_ego_nets")
def _(spark, d):
    return ego.ego_nets(tables.edges(spark, d))


@query("g10_weighted_degree_vs_count")
def _(spark, d):
    return rounded(report.degree_vs_count(tables.edges(spark, d), weighted=True), 9, "center")


@query("g11_pagerank_vs_count")
def _(spark, d):
    return rounded(binning.histogram(_ranks(spark, d), "pagerank", report.BINS), RANK_DIGITS, "center")


@query("g11_weighted_pagerank_vs_count")
def _(spark, d):
    return rounded(binning.histogram(_ranks(spark, d, weighted=True), "pagerank", report.BINS), RANK_DIGITS, "center")


@query("g12_degree_vs_pagerank")
def _(spark, d):
    return report.degree_vs_pagerank(tables.edges(spark, d), _ranks(spark, d))


@query("g12_weighted_degree_vs_pagerank")
def _(spark, d):
    return report.degree_vs_pagerank(tables.edges(spark, d), _ranks(spark, d, weighted=True), weighted=True)


@query("g13_svd_embedding")
def _(spark, d):
    return embedding.svd_embedding(tables.edges(spark, d))


@query("g13_embedding_gramian")
def _(spark, d):
    """VᵀV of the embedding: the identity."""
    vectors = embedding.svd_embedding(tables.edges(spark, d))
    block = vectors.select(F.array(*[f"v_{c}" for c in range(1, 11)]).alias("row"))
    return rounded(rowmatrix.gramian(block), SUM_DIGITS, "v")


def _falls(value: str, following):
    """Whether a value is not below the next one; equal values, as of parts of a graph that are alike, differ by rounding."""
    return F.col(value) * (1 + TIES) >= following


def _embedding_values(spark, d, **options):
    """Per component v of the embedding: the greatest entry of AᵀAv - s²v with s² = |Av|², the length of v, and whether s falls."""
    e = cut_lineage(tables.edges(spark, d).select("src", "dst").distinct())
    names = [f"v_{c}" for c in range(1, 11)]
    vectors = cut_lineage(embedding.svd_embedding(tables.edges(spark, d), **options))
    turned = e.join(vectors.withColumnRenamed("nodeid", "dst"), "dst").groupBy("src").agg(*[F.sum(n).alias(n) for n in names])
    turned = cut_lineage(turned)
    back = e.join(turned, "src").groupBy(F.col("dst").alias("nodeid")).agg(*[F.sum(n).alias(n) for n in names])

    def long(df, value):
        cells = [F.struct(F.lit(c).alias("component"), F.col(n).alias(value)) for c, n in enumerate(names, 1)]
        return df.select(*[c for c in df.columns if c == "nodeid"], F.explode(F.array(*cells)).alias("c")).select("*", "c.*").drop("c")

    s = long(turned, "u").groupBy("component").agg(F.sum(F.col("u") * F.col("u")).alias("s2"))
    s = s.withColumn("next", F.lead("s2", 1, 0.0).over(Window.orderBy("component")))
    both = long(vectors, "v").join(long(back, "image"), ["nodeid", "component"], "left").join(s, "component")
    off = F.abs(F.coalesce("image", F.lit(0.0)) - F.col("s2") * F.col("v"))
    per = both.groupBy("component", "s2", "next").agg(F.max(off).alias("residual"), F.sum(F.col("v") * F.col("v")).alias("length"))
    return rounded(per.select("component", "residual", "length", _falls("s2", F.col("next")).alias("falling")), SUM_DIGITS, "residual", "length")


@query("g13_embedding_values")
def _(spark, d):
    return _embedding_values(spark, d)


@query("g13_embedding_krylov")
def _(spark, d):
    """The same values of the way that is taken when both sides are long."""
    return _embedding_values(spark, d, dense_side=0)


@query("g13_all_components")
def _(spark, d):
    """All components of the adjacency matrix: (AV)ᵀ(AV) is diagonal, falls, and its trace is the number of linked pairs.

    Together with the lengths of V that leaves no room for a component that was passed over.
    """
    e = cut_lineage(tables.edges(spark, d).select((F.col("src") - 1).alias("i"), (F.col("dst") - 1).alias("j")).distinct().withColumn("v", F.lit(1.0)))
    dims = coo.shape(e)
    s, v = embedding.right_vectors(e, dims, min(dims))
    names = [f"c{n}" for n in range(len(s))]
    image = rowmatrix.gramian(cut_lineage(rotations.product(e, v, dims.rows, len(names))), n_cols=len(names))
    # A task sends its whole triangle, so there is one per core.
    whole = v.withColumnRenamed("v", "row").coalesce(spark.sparkContext.defaultParallelism)
    lengths = rowmatrix.gramian(whole, n_cols=len(names)).withColumnRenamed("v", "length")
    own = F.col("i") == F.col("j")
    after = image.where(own).select((F.col("i") - 1).alias("i"), F.col("v").alias("after"))
    per = image.join(lengths, ["i", "j"]).groupBy("i").agg(
        F.max(F.when(~own, F.greatest(F.abs("v"), F.abs("length"))).otherwise(0.0)).alias("off"),
        F.max(F.when(own, F.col("v"))).alias("square"), F.max(F.when(own, F.col("length"))).alias("length"),
    )
    falling = _falls("square", F.coalesce("after", F.lit(0.0)))
    whole = per.join(after, "i", "left").select((F.col("i") + 1).alias("component"), "off", "length", falling.alias("falling"), F.sum("square").over(Window.partitionBy()).alias("total"))
    return rounded(whole, 4, "off", "length", "total")


def combined_core(spark: SparkSession, d: str) -> DataFrame:
    """The combined table without the embedding, bins taken on rounded ranks."""
    options = report.ReportOptions(svd=False)
    return report.combined_table(tables.edges(spark, d), options, rank_digits=RANK_DIGITS)


def _combined_rounded(spark, d):
    core = rounded(combined_core(spark, d), RANK_DIGITS, "pagerank", "pagerank_t")
    return rounded(core, CC_DIGITS, "clusCoeff", "clusCoeff_t")


@query("g14_combined_core")
def _(spark, d):
    return _combined_rounded(spark, d)


@query("g14_combined")
def _(spark, d):
    return report.combined_table(tables.edges(spark, d))


@query("g15_plot_degree_vs_count")
def _(spark, d):
    return report.plot_degree_vs_count(_combined_rounded(spark, d))


@query("g16_plot_degree_vs_pagerank")
def _(spark, d):
    return report.plot_degree_vs_pagerank(_combined_rounded(spark, d))


@query("g17_plot_pagerank_vs_count")
def _(spark, d):
    return report.plot_pagerank_vs_count(_combined_rounded(spark, d))


@query("g18_plot_all_core")
def _(spark, d):
    return report.plot_all(_combined_rounded(spark, d))


@query("g18_plot_all")
def _(spark, d):
    return report.plot_all(report.combined_table(tables.edges(spark, d)))


# -- matrices ------------------------------------------------------------------------------


def _coo(spark, d):
    return coo.from_rows(tables.vectors(spark, d))


def _local_square() -> np.ndarray:
    """A fixed 64 x 8 matrix with the entry (3r + 5c) mod 7 - 3."""
    r, c = np.indices((64, 8))
    return ((3 * r + 5 * c) % 7 - 3).astype(float)


@query("m1_rows_to_coordinates")
def _(spark, d):
    return _coo(spark, d)


@query("m3_dimensions")
def _(spark, d):
    return coo.dimensions(_coo(spark, d))


@query("m4_column_summary")
def _(spark, d):
    return rounded(rowmatrix.column_summary(tables.vectors(spark, d)), SUM_DIGITS, "mean", "variance", "max", "min", "l1", "l2")


@query("m4_coordinate_column_summary")
def _(spark, d):
    """Three more columns than the table stores positions in."""
    m = tables.order_lines(spark, d, "l_quantity")
    return rounded(coo.column_summary(m, coo.Shape(coo.shape(m).rows, GROUPS + 3)), SUM_DIGITS, "mean", "variance", "max", "min", "l1", "l2")


@query("m5_covariance")
def _(spark, d):
    return rounded(rowmatrix.covariance(tables.vectors(spark, d)), SUM_DIGITS, "v")


@query("m5_coordinate_covariance")
def _(spark, d):
    m = tables.order_lines(spark, d, "l_quantity")
    return rounded(coo.covariance(m, coo.Shape(coo.shape(m).rows, GROUPS)), 4, "v")


@query("m6_gramian")
def _(spark, d):
    return rounded(rowmatrix.gramian(tables.vectors(spark, d)), SUM_DIGITS, "v")


@query("m6_coordinate_gramian")
def _(spark, d):
    return rounded(coo.gramian(tables.measure(spark, d, "l_quantity")), SUM_DIGITS, "v")


@query("m7_column_cosines")
def _(spark, d):
    return rounded(coo.column_cosines(rowmatrix.gramian(tables.vectors(spark, d))), SUM_DIGITS, "v")


def _wide_rows(coordinates: DataFrame) -> DataFrame:
    """Rows of a coordinate table, stored as several bands read them: sparse ones where they are wide and nothing is NULL."""
    n = coo.shape(coordinates).cols
    if n > rowmatrix.MAX_DENSE and not coo.has_gaps(coordinates):
        return _sparse_rows(coordinates)
    return cut_lineage(coo.to_dense_rows(coordinates, n))


# Columns whose positions a piece of a sparse row holds.
SPARSE_PIECE = 65_536


def _sparse_rows(coordinates: DataFrame) -> DataFrame:
    """Sparse rows of a coordinate table in pieces: a dense row of a column for every order has mostly zeros."""
    return cut_lineage(coo.to_sparse_rows(coordinates, coo.shape(coordinates).cols, SPARSE_PIECE))


def _upper_digest(upper: DataFrame, digits: int) -> DataFrame:
    """Per row ``i`` of a triangle, from the diagonal on: the sum of its cells and of their squares."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1)
            sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cells = part.flatten()
            line = np.repeat(np.arange(len(sizes)), sizes)
            # A list with a NULL has no sum.
            gaps = np.bincount(line, cells.is_null().to_numpy(zero_copy_only=False), len(sizes)) > 0 if cells.null_count else np.zeros(len(sizes), bool)
            gaps |= part.is_null().to_numpy(zero_copy_only=False)
            v = cells.to_numpy(zero_copy_only=False)
            sums = [pa.array(np.bincount(line, w, len(sizes)).astype(float), mask=gaps) for w in (v, v * v)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], names=["i", "total", "squares"])

    lines = upper.select("i", "part").mapInArrow(digest, "i bigint, total double, squares double")
    sums = lines.groupBy("i").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    return rounded(sums, digits, "total", "squares")


@query("m5_coordinate_wide_covariance")
def _(spark, d):
    """Supplier by part as coordinates, a column for every part: per column the sums of its cells up to the diagonal."""
    m = tables.supplier_parts(spark, d)
    upper = coo.covariance_upper(m, coo.shape(m))
    return rounded(upper.groupBy("i").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares")), 3, "total", "squares")


@query("m5_wide_covariance")
def _(spark, d):
    """Supplier by part, a column for every part."""
    return _upper_digest(rowmatrix.covariance_upper(_wide_rows(tables.supplier_parts(spark, d))), 3)


@query("m6_wide_gramian")
def _(spark, d):
    """Supplier by order, a column for every order."""
    return _upper_digest(rowmatrix.square_of_rows(_wide_rows(tables.supplier_orders(spark, d))), 3)


@query("m7_wide_cosines")
def _(spark, d):
    rows = _wide_rows(tables.supplier_parts(spark, d))
    square = rowmatrix.square_of_rows(rows)
    if rowmatrix.is_sparse(rows):
        return _upper_digest(rowmatrix.cosines_upper(square, rowmatrix.column_norms(rows)), SUM_DIGITS)
    return _upper_digest(rowmatrix.cosines_upper(cut_lineage(square)), SUM_DIGITS)


@query("m8_sampled_column_cosines")
def _(spark, d):
    """Line numbers by order: exact cosines above the threshold, and whether the sampled ones lie within a fifth of them."""
    entries = tables.line_places(spark, d)
    threshold, n = 0.1, coo.shape(entries).cols
    sampled = factor.similar_columns_of(entries, threshold, n).withColumnRenamed("v", "estimate")
    exact = coo.column_cosines(coo.gramian(entries)).where(F.col("v") >= threshold)
    within = F.abs(F.coalesce("estimate", F.lit(0.0)) - F.col("v")) <= F.col("v") / 5
    return rounded(exact.join(sampled, ["i", "j"], "left").select("i", "j", "v", within.alias("within")), SUM_DIGITS, "v")


@query("m8_sampled_share")
def _(spark, d):
    """Per column the entries, how many should take part, and whether as many do, within five standard deviations."""
    entries = tables.line_places(spark, d)
    threshold, n = 0.1, coo.shape(entries).cols
    root = float(np.sqrt(10 * np.log(n) / threshold))
    kept = factor.sampled_entries(entries, threshold, n).groupBy("j").agg(F.count(F.lit(1)).alias("kept"))
    per = entries.groupBy("j").agg(F.count(F.lit(1)).alias("entries"), (F.sqrt(F.sum(F.col("v") * F.col("v"))) / F.max("v")).alias("norm"))
    due = F.col("entries") * F.least(F.lit(1.0), F.lit(root) / F.col("norm"))
    near = F.abs(F.coalesce("kept", F.lit(0)) - F.col("expected")) <= 5 * F.sqrt("expected")
    both = per.withColumn("expected", due).join(kept, "j", "left")
    return rounded(both.select("j", "entries", "expected", near.alias("as_expected")), SUM_DIGITS, "expected")


@query("m8_zero_threshold_cosines")
def _(spark, d):
    """Without a threshold nothing is sampled."""
    return rounded(factor.similar_columns(tables.vectors(spark, d), 0.0), SUM_DIGITS, "v")


@query("m9_qr_r")
def _(spark, d):
    return factor.local_rows(spark, factor.qr(tables.vectors(spark, d)).r)


@query("m9_qr_square")
def _(spark, d):
    """RᵀR, which is the Gramian, with what R holds below its diagonal."""
    r = factor.qr(tables.vectors(spark, d)).r
    square, below = factor.local_rows(spark, r.T @ r), factor.local_rows(spark, np.tril(r, -1)).withColumnRenamed("v", "below")
    return rounded(square.join(below, ["i", "j"]), SUM_DIGITS, "v", "below")


@query("m9_qr_orthonormal")
def _(spark, d):
    """QᵀQ: the identity."""
    return rounded(rowmatrix.gramian(factor.qr(tables.vectors(spark, d), compute_q=True).q), SUM_DIGITS, "v")


@query("m9_qr_product")
def _(spark, d):
    found = factor.qr(tables.vectors(spark, d), compute_q=True)
    return rounded(coo.from_rows(rowmatrix.multiply_local(found.q, found.r)), SUM_DIGITS, "v")


def _dependent_rows(spark, d) -> DataFrame:
    """The vectors with four more columns: a sum of two, a multiple, zeros, and one that differs from the first in the eighth digit."""
    v = tables.vectors(spark, d)
    at = lambda n: F.get("row", F.lit(n))
    more = F.array(at(0) + at(1), at(2) * 2.0, F.lit(0.0), at(0) + at(5) * 1e-7)
    near = F.concat(F.slice("row", 1, 5), F.slice("row", 7, 58), more)
    return v.select("i", near.alias("row"))


@query("m9_qr_dependent")
def _(spark, d):
    """QᵀQ where three of 67 columns depend on earlier ones: the identity but for zeros there."""
    return rounded(rowmatrix.gramian(factor.qr(_dependent_rows(spark, d), compute_q=True).q), SUM_DIGITS, "v")


@query("m9_qr_dependent_product")
def _(spark, d):
    """Q times R beside the rows: the greatest difference per column, with what R holds below its diagonal."""
    rows = _dependent_rows(spark, d)
    found = factor.qr(rows, compute_q=True)
    product = coo.from_rows(rowmatrix.multiply_local(found.q, found.r)).withColumnRenamed("v", "product")
    below = factor.local_rows(spark, np.abs(np.tril(found.r, -1))).groupBy("j").agg(F.sum("v").alias("below"))
    off = coo.from_rows(rows).join(product, ["i", "j"]).groupBy("j").agg(F.max(F.abs(F.col("v") - F.col("product"))).alias("off"))
    return rounded(off.join(below, "j"), SUM_DIGITS, "off", "below")


@query("m10_singular_values")
def _(spark, d):
    return factor.triplets(factor.svd(tables.vectors(spark, d), 10), spark)


@query("m10_singular_triplets")
def _(spark, d):
    """Per component: whether AᵀAv = s²v, the length of v, whether values fall, and the sum of all s²."""
    rows = tables.vectors(spark, d)
    n = rowmatrix.width(rows)
    found = factor.svd(rows, n)
    image = coo.multiply(rowmatrix.gramian(rows), coo.from_local(spark, found.v)).withColumnRenamed("v", "image")
    cells = coo.from_local(spark, found.v).join(image, ["i", "j"]).withColumn("component", F.col("j") + 1)
    s = factor.triplets(found, spark).withColumn("next", F.lead("s", 1, 0.0).over(Window.orderBy("component")))
    total = s.agg(F.sum(F.col("s") * F.col("s"))).scalar()
    per = cells.join(s, "component").groupBy("component", "s", "next").agg(
        F.max(F.abs(F.col("image") - F.col("s") * F.col("s") * F.col("v"))).alias("residual"), F.sum(F.col("v") * F.col("v")).alias("length")
    )
    checked = per.select("component", "residual", "length", (F.col("s") >= F.col("next")).alias("falling"), total.alias("total"))
    return rounded(checked, 4, "residual", "length", "total")


def _checked_triplets(coordinates: DataFrame, found: factor.Svd, spark) -> DataFrame:
    """Per component: the greatest entry of Aᵀu - s v, the lengths of u and v, and whether s falls."""
    u = coo.from_rows(found.u).select("i", F.col("j").alias("c"), F.col("v").alias("u"))
    s = factor.triplets(found, spark).withColumn("next", F.lead("s", 1, 0.0).over(Window.orderBy("component")))
    # One row per column on both sides: a row per column and component would be shuffled twice.
    sums = [F.sum(F.col("v") * F.get("row", F.lit(c))) for c in range(len(found.s))]
    image = coordinates.join(found.u.select("i", "row"), "i").groupBy("j").agg(F.array(*sums).alias("images"))
    lines = found.v.join(image, "j", "left").select("images", F.posexplode("v").alias("c", "right"))
    both = lines.select(F.get("images", "c").alias("image"), "right", (F.col("c") + 1).alias("component")).join(F.broadcast(s), "component")
    off = F.abs(F.coalesce("image", F.lit(0.0)) - F.col("s") * F.col("right"))
    per = both.groupBy("component", "s", "next").agg(F.max(off).alias("residual"), F.sum(F.col("right") * F.col("right")).alias("right_length"))
    left = u.groupBy((F.col("c") + 1).alias("component")).agg(F.sum(F.col("u") * F.col("u")).alias("left_length"))
    return per.join(left, "component").select("component", "residual", "left_length", "right_length", (F.col("s") >= F.col("next")).alias("falling"), "s")


@query("m10_wide_triplets")
def _(spark, d):
    """All components of nation by order, a column for every order; the sum of all s² is that of all cells squared."""
    entries = tables.nation_orders(spark, d)
    rows = _sparse_rows(entries)
    found = factor.svd(rows, rows.select("i").distinct().count(), compute_u=True)
    per = _checked_triplets(entries, found, spark)
    total = F.sum(F.col("s") * F.col("s")).over(Window.partitionBy())
    return rounded(per.withColumn("total", total).drop("s"), 4, "residual", "left_length", "right_length", "total")


@query("m10_wide_leading")
def _(spark, d):
    """The ten leading components of supplier by order, a column for every order."""
    entries = tables.supplier_orders(spark, d)
    found = factor.svd(_sparse_rows(entries), 10, compute_u=True)
    return rounded(_checked_triplets(entries, found, spark).drop("s"), 4, "residual", "left_length", "right_length")


@query("m11_wide_components")
def _(spark, d):
    """Covariance of nation by order turned into all its components: zero off the diagonal, falling along it, and its total."""
    rows = _sparse_rows(tables.nation_orders(spark, d))
    found = factor.principal_components(rows, rows.select("i").distinct().count() - 1)
    turned = rowmatrix.covariance(rowmatrix.multiply_table(rows, found.vectors))
    after = turned.where("i = j").select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("v").alias("after"))
    own = F.when(F.col("i") == F.col("j"), F.col("v"))
    total = F.sum(own).over(Window.partitionBy())
    falling = F.coalesce(own >= F.coalesce("after", F.lit(0.0)), F.lit(True))
    off = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("v"))
    checked = turned.join(after, ["i", "j"], "left").select("i", "j", off.alias("off"), falling.alias("falling"), total.alias("total"))
    return rounded(checked, 4, "off", "total")


@query("m10_svd_product")
def _(spark, d):
    found = factor.svd(tables.vectors(spark, d), 64, compute_u=True)
    return rounded(coo.from_rows(rowmatrix.multiply_local(found.u, (found.v * found.s).T)), SUM_DIGITS, "v")


@query("m10_svd_left_gramian")
def _(spark, d):
    """UᵀU of the ten leading left vectors: the identity."""
    found = factor.svd(tables.vectors(spark, d), 10, compute_u=True)
    return rounded(rowmatrix.gramian(found.u, "row"), SUM_DIGITS, "v")


@query("m11_principal_components")
def _(spark, d):
    return factor.local_rows(spark, factor.principal_components(tables.vectors(spark, d), 10).vectors)


@query("m11_turned_covariance")
def _(spark, d):
    """Covariance of the rows turned into all components: zero off the diagonal, and falling along it."""
    rows = tables.vectors(spark, d)
    turned = rowmatrix.covariance(rowmatrix.multiply_local(rows, factor.principal_components(rows, rowmatrix.width(rows)).vectors))
    after = turned.where("i = j").select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("v").alias("after"))
    falling = F.when(F.col("i") == F.col("j"), F.col("v") >= F.coalesce("after", F.lit(0.0))).otherwise(F.lit(True))
    off = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("v")).alias("off")
    return rounded(turned.join(after, ["i", "j"], "left").select("i", "j", off, falling.alias("falling")), SUM_DIGITS, "off")


@query("m11_component_variance")
def _(spark, d):
    """Total variance, from the covariance of the rows turned into all components."""
    rows = tables.vectors(spark, d)
    turned = rowmatrix.multiply_local(rows, factor.principal_components(rows, 64).vectors)
    total = rowmatrix.covariance(turned).where("i = j").agg(F.sum("v").alias("variance"))
    return rounded(total, SUM_DIGITS, "variance")


@query("m12_multiply_local")
def _(spark, d):
    product = rowmatrix.multiply_local(tables.vectors(spark, d).select("i", "row"), _local_square())
    return rounded(coo.from_rows(product), SUM_DIGITS, "v")


@query("m13_transpose")
def _(spark, d):
    return coo.transpose(_coo(spark, d))


@query("m14_add")
def _(spark, d):
    return rounded(coo.add(tables.measure(spark, d, "l_quantity"), tables.measure(spark, d, "l_tax")), SUM_DIGITS, "v")


@query("m15_subtract")
def _(spark, d):
    return rounded(coo.subtract(tables.measure(spark, d, "l_quantity"), tables.measure(spark, d, "l_tax")), SUM_DIGITS, "v")


@query("m16_multiply")
def _(spark, d):
    a = tables.measure(spark, d, "l_quantity")
    return rounded(coo.multiply(a, coo.transpose(tables.measure(spark, d, "l_tax"))), 4, "v")


@query("m16_multiply_repeated")
def _(spark, d):
    """Supplier by part times part by line number, one row per order line on both sides."""
    lines = tables.table(spark, d, "lineitem")
    a = coo.coordinate_table(lines, "l_suppkey", "l_partkey", "l_quantity")
    return rounded(coo.multiply(a, coo.coordinate_table(lines, "l_partkey", "l_linenumber", "l_tax")), 4, "v")


@query("m16_multiply_dense")
def _(spark, d):
    a, b = coo.transpose(tables.measure(spark, d, "l_quantity")), tables.measure(spark, d, "l_tax")
    return rounded(blocks.multiply_dense(a, b, GROUPS, strip=32), 4, "v")


@query("m17_to_blocks")
def _(spark, d):
    return blocks.to_blocks(_coo(spark, d), 128, 16)


@query("m17_dense_blocks_round_trip")
def _(spark, d):
    m = _coo(spark, d)
    dense = blocks.to_dense_blocks(m, coo.shape(m), 100, 24)
    return blocks.from_dense_blocks(dense, 100, 24)


@query("m17_sparse_rows_round_trip")
def _(spark, d):
    return coo.from_sparse_rows(coo.to_sparse_rows(tables.measure(spark, d, "l_quantity"), GROUPS))


@query("m17_dense_rows")
def _(spark, d):
    return coo.from_rows(coo.to_dense_rows(tables.order_lines(spark, d, "l_quantity"), GROUPS))


@query("m17_blocks_repeated")
def _(spark, d):
    """Order lines through dense blocks, lines of one position added up."""
    lines = tables.order_lines(spark, d, "l_quantity")
    dense = blocks.to_dense_blocks(lines, coo.Shape(coo.shape(lines).rows, GROUPS), 100, 24)
    return rounded(coo.drop_zeros(blocks.from_dense_blocks(dense, 100, 24)), SUM_DIGITS, "v")


@query("m18_block_violations")
def _(spark, d):
    m = _coo(spark, d)
    dims = coo.shape(m)
    good = blocks.to_dense_blocks(m, dims, 100, 24)
    twice = good.where("bi = 1 and bj = 0")
    moved = good.where("bi = 0").withColumn("bi", F.lit(1_000_000))
    cut = good.where("bi = 2 and bj = 1").select("bi", "bj", "n_rows", "n_cols", F.slice("cells", 1, 5).alias("cells"))
    return blocks.violations(good.where("not (bi = 2 and bj = 1)").unionByName(twice).unionByName(moved).unionByName(cut), dims, 100, 24)


@query("m19_persist_levels")
def _(spark, d):
    """The sum and number of cells, read twice from a table kept at each level until the block ends."""
    found = []
    with lifetime(spark) as scope:
        for name in ("MEMORY_ONLY", "MEMORY_AND_DISK", "DISK_ONLY"):
            held = scope.persist(tables.supplier_parts(spark, d).withColumn("level", F.lit(name)), getattr(StorageLevel, name))
            twice = [held.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).first() for _ in range(2)]
            found.append((name, twice[0].n, twice[0].total, twice[0] == twice[1]))
    return spark.createDataFrame(found, "level string, n bigint, total double, same boolean")


@query("m20_to_local")
def _(spark, d):
    """A matrix through the driver and back, zeros included."""
    m = tables.measure(spark, d, "l_quantity")
    return coo.from_local(spark, coo.to_local(m, coo.Shape(coo.shape(m).rows, GROUPS)))


@query("m21_drop_zeros")
def _(spark, d):
    m = _coo(spark, d).withColumn("v", F.when(F.abs("v") < 0.05, 0.0).otherwise(F.col("v")))
    return coo.drop_zeros(m)


@query("m21_fill_zeros")
def _(spark, d):
    m = tables.order_lines(spark, d, "l_quantity")
    return coo.fill_zeros(m, coo.Shape(coo.shape(m).rows, GROUPS))


# -- vector columns ------------------------------------------------------------------------


def _thinned(column: str):
    """A vector with its small elements set to zero."""
    return F.transform(column, lambda x: F.when(F.abs(x) < 0.1, 0.0).otherwise(x))


def _pairs(spark, d):
    return tables.vector_pairs(spark, d)


@query("v1_dot")
def _(spark, d):
    return rounded(_pairs(spark, d).select("vec_id", V.dot(F.col("a"), F.col("b")).alias("v")), SUM_DIGITS, "v")


@query("v1_sparse_dot")
def _(spark, d):
    p = _pairs(spark, d).select("vec_id", V.to_sparse(_thinned("a")).alias("sa"), V.to_sparse(_thinned("b")).alias("sb"), "b")
    both = p.select("vec_id", V.sparse_dot(F.col("sa"), F.col("sb")).alias("sparse"), V.mixed_dot(F.col("sa"), F.col("b")).alias("mixed"))
    return rounded(both, SUM_DIGITS, "sparse", "mixed")


@query("v2_norms")
def _(spark, d):
    v = F.col("row")
    norms = tables.vectors(spark, d).select(
        F.col("i").alias("vec_id"),
        V.norm(v, 1).alias("l1"),
        V.norm(v, 2).alias("l2"),
        V.norm(v, 3).alias("l3"),
        V.norm(v, float("inf")).alias("largest"),
    )
    return rounded(norms, SUM_DIGITS, "l1", "l2", "l3", "largest")


@query("v3_squared_distance")
def _(spark, d):
    p = _pairs(spark, d).withColumns({"sa": V.to_sparse(_thinned("a")), "sb": V.to_sparse(_thinned("b"))})
    found = p.select(
        "vec_id",
        V.squared_distance(F.col("a"), F.col("b")).alias("dense"),
        V.sparse_squared_distance(F.col("sa"), F.col("sb")).alias("sparse"),
        V.mixed_squared_distance(F.col("sa"), F.col("b")).alias("mixed"),
    )
    return rounded(found, SUM_DIGITS, "dense", "sparse", "mixed")


@query("v4_nonzeros")
def _(spark, d):
    return tables.vectors(spark, d).select(F.col("i").alias("vec_id"), V.nonzeros(_thinned("row")).cast("bigint").alias("n"))


@query("v5_elementwise")
def _(spark, d):
    """Quotients by zero are NULL."""
    p = _pairs(spark, d)
    a, b = F.col("a"), F.col("b")
    parts = p.select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                V.elementwise(a, b, lambda x, y: x + y).alias("plus"),
                V.elementwise(a, b, lambda x, y: x - y).alias("minus"),
                V.elementwise(a, b, lambda x, y: x * y).alias("times"),
                V.elementwise(a, b, lambda x, y: F.try_divide(x, y)).alias("over"),
                V.scale_by(a, lambda x: F.lit(2.0) - x).alias("from_two"),
                V.negate(a).alias("negated"),
            )
        ).alias("position", "e"),
    ).select("vec_id", "position", "e.*")
    return rounded(parts, SUM_DIGITS, "plus", "minus", "times", "from_two", "negated").withColumn(
        "over", F.round("over", 3) + F.lit(0.0)
    )


@query("v5_remainder")
def _(spark, d):
    whole = tables.vectors(spark, d).select(F.col("i").alias("vec_id"), F.transform("row", lambda x: F.floor(x * 1000).cast("double")).alias("w"))
    return whole.select("vec_id", F.posexplode(V.scale_by(F.col("w"), lambda x: V.remainder(x, F.lit(7.0)))).alias("position", "v"))


@query("v6_element")
def _(spark, d):
    v = F.col("row")
    return tables.vectors(spark, d).select(
        F.col("i").alias("vec_id"), V.element(v, 0).alias("first"), V.element(v, 5).alias("sixth"), V.element(v, -1).alias("last")
    )


@query("v7_sparse_round_trip")
def _(spark, d):
    s = tables.vectors(spark, d).select(F.col("i").alias("vec_id"), V.to_sparse(_thinned("row")).alias("s"))
    return s.select("vec_id", F.size("s.indices").alias("stored"), F.posexplode(V.to_dense(F.col("s"))).alias("position", "v"))


@query("v7_sparse_from_map")
def _(spark, d):
    m = tables.vectors(spark, d).select(
        F.col("i").alias("vec_id"),
        F.map_from_arrays(F.array(F.lit(40), F.lit(3)), F.array(V.element(F.col("row"), 0), V.element(F.col("row"), 1))).alias("m"),
    )
    s = m.select("vec_id", V.sparse_from_map(F.lit(64), F.col("m")).alias("s"))
    return s.select("vec_id", "s.size", F.posexplode(F.arrays_zip("s.indices", "s.values")).alias("position", "e")).select(
        "vec_id", "size", "position", F.col("e.indices").alias("at"), F.col("e.values").alias("v")
    )


@query("v8_same_vector")
def _(spark, d):
    """Each thinned vector against itself with all zeros stored, and against the next vector."""
    p = _pairs(spark, d)
    n = F.lit(64)
    full = V.sparse(n, F.sequence(F.lit(0), F.lit(63)), _thinned("a"))
    return p.select(
        "vec_id",
        V.same_vector(V.to_sparse(_thinned("a")), full).alias("itself"),
        V.same_vector(V.to_sparse(_thinned("a")), V.to_sparse(_thinned("b"))).alias("next"),
    )


@query("v9_text_round_trip")
def _(spark, d):
    t = tables.vectors(spark, d).select(
        F.col("i").alias("vec_id"), V.format_dense(F.col("row")).alias("t"), V.format_sparse(V.to_sparse(_thinned("row"))).alias("u")
    )
    parsed = t.select("vec_id", V.parse_dense(F.col("t")).alias("a"), V.to_dense(V.parse_sparse(F.col("u"))).alias("b"))
    return parsed.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("position", "e")).select(
        "vec_id", "position", F.col("e.a").alias("dense"), F.col("e.b").alias("sparse")
    )


@query("v9_text")
def _(spark, d):
    whole = F.transform("row", lambda x: F.floor(x * 1000).cast("double"))
    return tables.vectors(spark, d).select(F.col("i").alias("vec_id"), V.format_dense(whole).alias("text"))


@query("v10_vector_columns")
def _(spark, d):
    rows = tables.vectors(spark, d).select(F.col("i").alias("vec_id"), "row")
    older = V.older_vectors(V.ml_vectors(rows, "row"), "row")
    back = V.arrays_from_ml(V.newer_vectors(older, "row"), "row")
    return back.select("vec_id", F.posexplode("row").alias("position", "v"))
