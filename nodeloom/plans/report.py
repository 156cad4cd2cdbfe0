"""The report: chosen statistics of one graph, the combined table, and its plot aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.binning import add_bins, histogram, with_bin_counts
from nodeloom.operators.clustering import local_clustering
from nodeloom.operators.degrees import degree_distribution, degrees
from nodeloom.operators.edges import unit_weights
from nodeloom.operators.embedding import COMPONENTS, svd_embedding
from nodeloom.operators.pagerank import pagerank
from nodeloom.operators.skew import hot_keys, join_hot
from nodeloom.runtime import cut_lineage
from nodeloom.sources.sinks import write_csv, write_tsv

# Bins of a histogram, PageRank rounds and damping when none are given.
BINS = 1000
ROUNDS = 10
DAMPING = 0.85


@dataclass(frozen=True)
class ReportOptions:
    """What to compute. The defaults are the embedding and the combined table."""

    weighted: bool = False
    out_degree: bool = False
    in_degree: bool = False
    total_degree: bool = False
    degree_vs_count: bool = False
    pagerank: bool = False
    pagerank_vs_count: bool = False
    degree_vs_pagerank: bool = False
    svd: bool = True
    combined: bool = True
    bins: int = BINS
    rounds: int = ROUNDS
    damping: float = DAMPING
    components: int = COMPONENTS


def degree_vs_count(edges: DataFrame, weighted: bool = False, bins: int = BINS) -> DataFrame:
    """Exact counts per degree; with weights, an equal-width histogram ``bin, center, count``."""
    if not weighted:
        return degree_distribution(degrees(edges, "total"))
    return histogram(degrees(edges, "weighted_total"), "degree", bins)


def degree_vs_pagerank(edges: DataFrame, ranks: DataFrame, weighted: bool = False) -> DataFrame:
    """``degree, pagerank``: one pair per node, without its id."""
    mode = "weighted_total" if weighted else "total"
    return degrees(edges, mode).join(ranks, "nodeid").select("degree", "pagerank")


def node_statistics(edges: DataFrame, options: ReportOptions = ReportOptions(), ranks: DataFrame | None = None) -> DataFrame:
    """``nodeid, degree, pagerank, clusCoeff``, stored."""
    if ranks is None:
        ranks = pagerank(edges, options.rounds, options.damping)
    clustered = local_clustering(edges).select("nodeid", F.col("cc").alias("clusCoeff"))
    joined = degrees(edges, "total").join(ranks, "nodeid").join(clustered, "nodeid")
    return cut_lineage(joined)


def combined_table(
    edges: DataFrame,
    options: ReportOptions = ReportOptions(),
    ranks: DataFrame | None = None,
    rank_digits: int | None = None,
) -> DataFrame:
    """One row per node with its statistics, their bin centres (``_t``) and bin counts.

    ``rank_digits`` rounds PageRank first, to make the bins of values on a bin edge
    independent of the order of summation.
    """
    stats = node_statistics(edges, options, ranks)
    if rank_digits is not None:
        stats = stats.withColumn("pagerank", F.round("pagerank", rank_digits))
    # Most nodes share a few small degrees, so those keys are split.
    counts = degree_distribution(stats)
    counted = join_hot(stats, counts, ["degree"], hot_keys(counts, ["degree"], "count"), [F.col("nodeid")])
    binned = add_bins(counted, ["pagerank", "clusCoeff"], options.bins)
    binned = with_bin_counts(binned, "pagerank", "pagerank_t_count")
    binned = with_bin_counts(binned, "clusCoeff", "cc_t_count")
    core = binned.select(
        "nodeid", "degree", "count", "pagerank", "pagerank_t", "pagerank_t_count", "clusCoeff", "clusCoeff_t", "cc_t_count"
    )
    if not options.svd:
        return core
    names = [f"v_{c}" for c in range(1, options.components + 1)]
    vectors = cut_lineage(svd_embedding(edges, options.components))
    placed = add_bins(vectors, names, options.bins).select("nodeid", *names, *[f"{n}_t" for n in names])
    return core.join(placed, "nodeid")


def plot_degree_vs_count(combined: DataFrame) -> DataFrame:
    return combined.select("degree", "count").distinct()


def plot_degree_vs_pagerank(combined: DataFrame) -> DataFrame:
    return combined.groupBy("degree", "pagerank_t").agg(F.count(F.lit(1)).alias("count"))


def plot_pagerank_vs_count(combined: DataFrame) -> DataFrame:
    return combined.select("pagerank_t", "pagerank_t_count").distinct()


def plot_all(combined: DataFrame) -> DataFrame:
    """The distinct degree and bin columns, embedding bins included when present."""
    vectors = [c for c in combined.columns if c.startswith("v_") and c.endswith("_t")]
    return combined.select(
        "degree", "count", "pagerank_t", "pagerank_t_count", "clusCoeff_t", "cc_t_count", *vectors
    ).distinct()


def run_report(edges: DataFrame, options: ReportOptions = ReportOptions()) -> dict[str, DataFrame]:
    """The chosen tables by name, from a cleaned edge table that is read often: store it first."""
    kind = "weighted_" if options.weighted else ""
    out: dict[str, DataFrame] = {}
    for side in ("out", "in", "total"):
        if getattr(options, f"{side}_degree"):
            out[f"{side}_degree"] = degrees(edges, kind + side)
    if options.degree_vs_count:
        out["degree_vs_count"] = degree_vs_count(edges, options.weighted, options.bins)

    combined = options.combined and not options.weighted
    ranks = None
    if options.pagerank or options.pagerank_vs_count or options.degree_vs_pagerank or combined:
        ranks = pagerank(edges, options.rounds, options.damping, options.weighted)
    if options.pagerank:
        out["pagerank"] = ranks
    if options.pagerank_vs_count:
        out["pagerank_vs_count"] = histogram(ranks, "pagerank", options.bins)
    if options.degree_vs_pagerank:
        out["degree_vs_pagerank"] = degree_vs_pagerank(edges, ranks, options.weighted)
    if combined:
        table = cut_lineage(combined_table(edges, options, ranks))
        out["edges"] = unit_weights(edges)
        out["combined"] = table
        out["plots/deg_vs_count"] = plot_degree_vs_count(table)
        out["plots/deg_vs_pr"] = plot_degree_vs_pagerank(table)
        out["plots/pr_vs_count"] = plot_pagerank_vs_count(table)
        out["plots/all"] = plot_all(table)
    return out


def write_report(edges: DataFrame, folder: str, options: ReportOptions = ReportOptions(), single_file: bool = False) -> list[str]:
    """Write the report below ``folder``: statistics as new TSV, combined and plots as CSV."""
    stored = edges.persist(StorageLevel.MEMORY_AND_DISK)
    written = []
    for name, table in run_report(stored, options).items():
        path = f"{folder.rstrip('/')}/{name}" + ("_weighted" if options.weighted else "")
        if name == "combined":
            write_csv(table.orderBy("nodeid"), path, single_file)
        elif name.startswith("plots/"):
            write_csv(table, path, single_file)
        elif name == "pagerank":
            write_tsv(table.orderBy("nodeid"), path, single_file)
        elif "center" in table.columns:
            write_tsv(table.orderBy("bin").select("center", "count"), path, single_file)
        else:
            write_tsv(table, path, single_file)
        written.append(path)
    stored.unpersist()
    return written
