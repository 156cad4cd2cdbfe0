"""PageRank by a fixed number of rounds over a stored link table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.skew import HOT_ROWS, PART, hot_keys, join_hot, repeat_lookup, spread_rows
from nodeloom.runtime import cut_lineage, shuffle_partitions

# Share of the edge rows that lead to sources, up to which the links among sources are kept apart.
APART = 0.5


def _node_totals(edges: DataFrame, weight) -> DataFrame:
    """Per node: outgoing weight and the numbers of outgoing and incoming rows."""
    per_end = F.explode(
        F.array(
            F.struct(F.col("src").alias("nodeid"), weight.alias("w"), F.lit(1).alias("out")),
            F.struct(F.col("dst").alias("nodeid"), F.lit(0.0).alias("w"), F.lit(0).alias("out")),
        )
    )
    return (
        edges.select(per_end.alias("e"))
        .groupBy(F.col("e.nodeid").alias("nodeid"))
        .agg(
            F.sum("e.w").alias("total"),
            F.sum("e.out").alias("out_rows"),
            F.sum(F.lit(1) - F.col("e.out")).alias("in_rows"),
        )
    )


def links_to_sources(links: DataFrame, nodes: DataFrame, widest: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The links whose destination has links of its own; ``widest`` is the largest number of rows into one of them."""
    sources = nodes.where("out_rows > 0").select(F.col("nodeid").alias("dst"), "in_rows")
    hot = hot_keys(sources, ["dst"], "in_rows", hot_rows) if widest > hot_rows else None
    return join_hot(links.withColumnRenamed(PART, "_own"), sources.drop("in_rows"), ["dst"], hot, [F.col("src")]).withColumnRenamed("_own", PART).select(*links.columns)


def pagerank(
    edges: DataFrame,
    iterations: int = 10,
    damping: float = 0.85,
    weighted: bool = False,
    n_mode: str = "max_id",
    hot_rows: int = HOT_ROWS,
    checkpoint_every: int = 3,
) -> DataFrame:
    """``nodeid, pagerank`` for every end of a cleaned edge table.

    Each round sends ``rank * share`` along each link, where the share is the link's part of
    its source's rows (or weight). A node without incoming links keeps the base rank. There is
    no redistribution from sinks and no convergence test. ``n_mode`` chooses the size used for
    the base rank: the largest node id, or with ``"count"`` the number of nodes.

    The link table is aggregated, laid out by source and stored once, so a round shuffles one
    row per node (only when hot sources are split) and the pre-summed contributions. What a node
    without outgoing links has received is read in the end only: where many links lead to such nodes,
    the rounds before the last take just the links among sources.
    """
    if n_mode not in ("max_id", "count"):
        raise ValueError("n_mode is 'max_id' or 'count'")
    width = shuffle_partitions(edges.sparkSession)
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)

    nodes = _node_totals(edges, weight).persist(StorageLevel.MEMORY_AND_DISK)
    facts = nodes.agg(
        F.max("nodeid").alias("max_id"),
        F.count(F.lit(1)).alias("nodes"),
        F.max("out_rows").alias("widest"),
        F.sum("in_rows").alias("rows"),
        F.sum(F.when(F.col("out_rows") > 0, F.col("in_rows"))).alias("onward"),
        F.max(F.when(F.col("out_rows") > 0, F.col("in_rows"))).alias("widest_onward"),
    ).first()
    if not facts.nodes:
        nodes.unpersist()
        return nodes.select("nodeid", F.lit(0.0).alias("pagerank"))
    size = float(facts.max_id if n_mode == "max_id" else facts.nodes)
    sources = nodes.where("out_rows > 0").select(F.col("nodeid").alias("src"), "total", "out_rows")

    # A source without incoming links gets a zero-share link to itself, so that the plain
    # sum over links yields its base rank and no outer join is needed in a round.
    unlinked = nodes.where("in_rows = 0").select(
        F.col("nodeid").alias("src"), F.col("nodeid").alias("dst"), F.lit(0.0).alias("amount")
    )
    links = (
        edges.groupBy("src", "dst").agg(F.sum(weight).alias("amount")).unionByName(unlinked)
    )
    keys, hot = ["src"], None
    if facts.widest > hot_rows:
        hot = hot_keys(sources, ["src"], "out_rows", hot_rows)
        links = spread_rows(links, ["src"], hot, [F.col("dst")])
        sources = repeat_lookup(sources, ["src"], hot)
        keys = ["src", PART]
    links = (
        links.repartition(width, *keys)
        .join(sources.drop("out_rows"), keys)
        .select(
            *keys,
            "dst",
            F.when(F.col("total") != 0, F.col("amount") / F.col("total")).otherwise(0.0).alias("share"),
        )
        .sortWithinPartitions(*keys)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )

    # Every source is a destination here, if only by its link to itself.
    inner = links
    if iterations > 1 and facts.onward <= APART * facts.rows:
        inner = links_to_sources(links, nodes, facts.widest_onward, hot_rows)
        inner = inner.repartition(width, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)

    ranks = nodes.select("nodeid", F.lit(1.0 / size).alias("pagerank"))
    base = (1.0 - damping) / size
    for done in range(1, iterations + 1):
        giving = ranks.withColumnRenamed("nodeid", "src")
        if hot is not None:
            giving = repeat_lookup(giving, ["src"], hot)
        received = F.sum(F.col("share") * F.col("pagerank"))
        ranks = (
            (inner if done < iterations else links)
            .join(giving, keys)
            .groupBy(F.col("dst").alias("nodeid"))
            .agg((received * F.lit(damping) + F.lit(base)).alias("pagerank"))
        )
        if done % checkpoint_every == 0 and done < iterations:
            ranks = cut_lineage(ranks)
    ranks = cut_lineage(ranks)
    inner.unpersist()
    links.unpersist()
    nodes.unpersist()
    return ranks
