"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. The rates of its documents are those closest to one
(in the relative entropy of rates between 0 and 2) that meet the target:
``2 / (1 + exp(-t * size / mean size))``, where the tilt ``t`` of the source is the root of the
dual's gradient. Newton steps run for all sources at once: the documents are reduced to counts per
(source, size), every step sums the gradient and curvature of that table per source, and a bracket
guards the step. Tilts are rounded, so that the order of a sum does not show. A target of twice the source is met by rates of two, one of zero by zero.

Rates become copies: every document gets the whole part of its rate, and the words still missing
are taken by documents in the order of a weighted hash, one more copy each, until the total is
nearest to the target. Where a long document ended that far from the target, later ones of at most twice the rest
go on in the same way, until the rest is small or nothing fits. Running totals are made from sums per bucket and then within
buckets. A bucket is a range of the logarithm of the hash's turn: whatever the rates, at most a share of 0.26 of a source's
documents is expected in an octave of turns, and octaves are cut finer the more documents there are. Documents that
wait for nothing are in no bucket, so that no task sees all of a source. The same table gives the same copies.

NULL and empty texts have size 0 and take nothing. NULL sources are one source, the last. Repeated
rows are mixed separately; rows alike in id and text share a hash and are taken one after another.
A source without words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.columns import words
from nodeloom.runtime import store_table

# The contract's weights, share and bound.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
STEPS = 70
NEWTON_STEPS = 25  # then the bracket is halved: 45 times from 2e4 is below the last digit of a tilt
TOLERANCE = 1e-6
BUCKET_ROWS = 5_000
TILT_DIGITS = 6
REST = 0.002  # of a target: a source nearer than that is not filled further


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, draw``: words of each text and a number in (0, 1] from id and text."""
    draw = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), draw.alias("draw"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, n, source_size, target``: shares by weight, at most ``most`` times a source's size.

    Water filling: a source is full when its size per weight is small enough. With sources in the
    order of that ratio, the full ones are a prefix, found by running sums over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    weighted = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ratio = F.col("source_size") / F.col("weight")
    rank = Window.orderBy(ratio, F.col("source").isNull(), F.col("source").cast("binary"))
    below, everything = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = weighted.withColumns(
        {
            "_all": F.sum("source_size").over(everything) * share,
            "_full": F.coalesce(F.sum("source_size").over(below), F.lit(0)) * most,
            "_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)),
        }
    )
    level = (F.col("_all") - F.col("_full")) / F.col("_weight")
    opened = filled.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") <= F.col("source_size") * most)
    # Past the first source that is not full, levels only fall, so the greatest is the one.
    first = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    return opened.select("source", "n", "source_size", F.coalesce(F.least(first * F.col("weight"), F.col("source_size") * most), F.col("source_size") * most).alias("target"))


def _rate(size: Column, mean: Column, tilt: Column, most: float) -> Column:
    return F.lit(most) / (1 + F.exp(-tilt * size / mean))


def tilts(sized: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """``goals`` with ``mean`` and ``tilt`` per source, by Newton steps on counts per (source, size)."""
    counts = store_table(sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("k")))
    state = goals.withColumns(
        {
            "mean": F.col("source_size") / F.col("n"),
            "tilt": F.lit(0.0),
            "low": F.lit(-1e4),
            "high": F.lit(1e4),
        }
    )
    state = store_table(state)
    size, k, tilt = F.col("size"), F.col("k"), F.col("tilt")
    for at in range(STEPS):
        rate = _rate(size, F.col("mean"), tilt, most)
        sums = (
            counts.join(state.select(F.col("source").alias("s"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(k * size * rate).alias("g"), F.sum(k * size * size / F.col("mean") * rate * (1 - rate / most)).alias("h"))
        )
        gap = F.col("g") - F.col("target")
        low, high = F.when(gap < 0, tilt).otherwise(F.col("low")), F.when(gap < 0, F.col("high")).otherwise(tilt)
        step = tilt - gap / F.col("h")
        edge = (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * most)  # no finite tilt
        narrow = F.col("high") - F.col("low") < 10.0 ** -(TILT_DIGITS + 1)
        done = edge | narrow | F.coalesce(F.abs(gap) <= TOLERANCE * F.col("source_size"), F.lit(True))
        inside = (F.col("_step") > F.col("_low")) & (F.col("_step") < F.col("_high")) & F.lit(at < NEWTON_STEPS)
        moved = (
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumns({"_low": low, "_high": high, "_step": step, "_done": done})
            .withColumn("_next", F.when(inside, F.col("_step")).otherwise((F.col("_low") + F.col("_high")) / 2))
        )
        state = store_table(
            moved.select(
                "source", "n", "source_size", "target", "mean",
                F.when(F.col("_done"), tilt).otherwise(F.col("_next")).alias("tilt"),
                F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_done").alias("done"),
            )
        )
        if not state.where("not done").limit(1).count():
            break
    else:
        raise RuntimeError(f"tilts did not settle in {STEPS} steps")
    return state.select("source", "n", "source_size", "target", "mean", F.round("tilt", TILT_DIGITS).alias("tilt"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, source, size, draw, source_size, target, rate, copies`` of every row of ``docs``."""
    sized = store_table(sizes(docs))
    state = tilts(sized, targets(sized, weights, share, most), most)
    return copies(sized, state, most)


def copies(sized: DataFrame, state: DataFrame, most: float = MOST) -> DataFrame:
    """Whole copies per document, one at a time by hash order until a source's target is nearest."""
    size, source = F.col("size"), F.col("source")
    rate = (
        F.when((size == 0) | (F.col("target") <= 0), F.lit(0.0))
        .when(F.col("target") >= F.col("source_size") * most, F.lit(float(most)))
        .otherwise(F.least(_rate(size, F.col("mean"), F.col("tilt"), most), F.lit(float(most))))
    )
    per_source = state.select(F.col("source").alias("s"), "n", "source_size", "target", "mean", "tilt")
    rated = sized.join(per_source, source.eqNullSafe(F.col("s")), "left").withColumn("rate", rate).drop("s", "mean", "tilt")
    part = F.col("rate") - F.floor("rate")
    # The smaller -log(draw) / part, the earlier: documents come in the order of a draw by part.
    turn = F.when((part > 0) & (size > 0), -F.log("draw") / part)
    # Row numbers are fixed by writing the table.
    placed = store_table(rated.withColumn("turn", turn).withColumn("row", F.monotonically_increasing_id()))
    octave = F.ceil(F.col("n") / (4 * BUCKET_ROWS))
    waiting = placed.where("turn is not null").select(
        "row", "doc_id", source.alias("s"), "size", "turn", F.coalesce(F.floor(F.log2("turn") * octave), F.lit(-(1 << 62))).alias("bucket")
    )
    room = store_table(
        placed.groupBy(source.alias("s")).agg((F.first("target") - F.sum(F.floor("rate") * size)).alias("room"), (F.first("target") * REST).alias("small"))
    )
    more = None
    while True:
        found = store_table(_filled(waiting, room))
        if found.isEmpty():
            break
        more = found if more is None else more.unionByName(found)
        words_taken = found.groupBy(F.col("s").alias("t")).agg(F.sum("size").alias("taken"))
        room = store_table(
            room.join(words_taken, F.col("s").eqNullSafe(F.col("t"))).select("s", (F.col("room") - F.col("taken")).alias("room"), "small").where("room > small")
        )
        if room.isEmpty():
            break
        waiting = waiting.join(more.select("row"), "row", "left_anti")
    whole = F.floor("rate").cast("long")
    if more is not None:
        placed = placed.join(more.select("row", F.lit(1).alias("one")), "row", "left")
        whole = whole + F.coalesce("one", F.lit(0))
    return placed.select("doc_id", "source", "size", "draw", "source_size", "target", "rate", whole.cast("long").alias("copies"))


def _filled(waiting: DataFrame, room: DataFrame) -> DataFrame:
    """``row, s, size`` of the waiting documents that bring a source's total nearer to its target, in their turn.

    A document of more than twice the room would lead further away and is passed over; the first of the others is always taken.
    """
    size, key = F.col("size"), F.col("s").eqNullSafe(F.col("t"))
    fitting = waiting.join(room.select(F.col("s").alias("t"), "room"), key).where("size <= 2 * room").drop("t")
    totals = fitting.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("s").alias("t"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    # Only buckets that begin within the room are read in order.
    reached = fitting.join(starts, key & (F.col("bucket") == F.col("b"))).where("start <= room")
    within = Window.partitionBy("s", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return reached.withColumn("end", F.col("start") + F.sum("size").over(within)).where(F.col("end") - size / 2 <= F.col("room")).select("row", "s", "size")
