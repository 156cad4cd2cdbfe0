"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds 64-bit hashes of its word shingles. Its signature is ``VALUES`` MinHash
values of 16 bits. Two sets of similarity J differ in a value with probability about 1 - J, so at
0.85 more than 23 of 60 values differ once in about 1e6 pairs, and at 0.80 more than 29. The signature is cut into
chunks; by the pigeonhole principle two signatures at most ``2 * chunks - 1`` apart have a chunk with at
most one difference. Every chunk is therefore indexed once per place that may differ, with the other
places as key: each pair under the distance meets in some bucket, without exception.

Texts with equal sets are one class, found by a 128-bit digest, so that copies never meet in pairs.
A bucket's hub, the member with the least share of shingles that no other candidate has, is tried
against all members. Two exact bounds then close members without pairs. A set of n shingles, u of them its own,
is similar to none if n - u < J n. And with D(x) the shingles in which x and the hub differ,
two members differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, of which the common ones are none of
u(x) and u(y); with t = (1 - J) / (1 + J) similar ones differ in at most t (n(x) + n(y)), so that x is open only while
|D(x)| - t n(x) is at most the greatest |D(y)| - 2 u(y) + t n(y) of its bucket. Members that stay open and are not in
the hub's component are a query set against all members met around that component, in blocks: a task
takes two blocks of ``BLOCK_MEMBERS`` sets, compares them in memory and puts out links only, so
that no row per pair is ever made. Links are confirmed on the full sets. Components are found without
collecting anything.

Fewer words than a shingle count as one shingle. Empty and NULL texts have an empty set and are linked with
nothing: they are their own component. Repeated rows share a class. Among NULL and other ids the
others are smaller; a component of NULL ids only has a NULL id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.columns import free_name, id_as_number, id_as_text, row_key
from nodeloom.llm.components import components
from nodeloom.runtime import store_table

VALUES = 60


class Rule(NamedTuple):
    """Words of a shingle, least similarity in percent, and the chunks that a signature is cut into."""

    size: int
    percent: int
    chunks: int

    @property
    def places(self) -> int:
        return VALUES // self.chunks

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


# Five words at 80 % where nothing else is asked for; three words at 85 % is the query contract.
NEAR = Rule(5, 80, 15)
CONTRACT = Rule(3, 85, 12)
BLOCK_MEMBERS = 1024
LARGER = 1.25

_RANDOM = np.random.Generator(np.random.PCG64(20240601))
_MULTIPLY = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for n in range(size):
        out = _scramble(out * _MIX[0] + h[n : n + len(out)])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, in blocks of the set so that memory stays small."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        block = found[at : at + 4096]
        for n in range(VALUES):
            least[n] = min(least[n], (block * _MULTIPLY[n] + _ADD[n]).min())
    return (_scramble(least) >> np.uint64(48)).astype(np.int64)


def bucket_keys(values: np.ndarray, rule: Rule) -> np.ndarray:
    """For each chunk and each place that may differ: a key of the chunk's other values."""
    chunks = values.reshape(rule.chunks, rule.places).astype(np.uint64)
    keys = []
    for skip in range(rule.places):
        key = np.arange(rule.chunks, dtype=np.uint64) * np.uint64(rule.places) + np.uint64(skip + 1)
        for n in range(rule.places):
            if n != skip:
                key = _scramble(key * _MIX[0] + chunks[:, n])
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def _signed(rule: Rule) -> Callable:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "row": batch["row"], "n": [], "class": [], "values": [], "keys": []}
            for text in batch["text"]:
                found = shingles(text, rule.size)
                values = signature(found) if len(found) else None
                out["n"].append(len(found))
                out["class"].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                out["values"].append(values)
                out["keys"].append(None if values is None else bucket_keys(values, rule))
            yield pd.DataFrame(out)

    return sign


def _sets(size: int) -> Callable:
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, size) for t in batch["text"]]
            yield pd.DataFrame({"class": [xxhash.xxh3_128_digest(x.tobytes()) for x in found], "found": [x.view(np.int64) for x in found]})

    return collect


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _common(pairs: DataFrame, classes: DataFrame, sets: DataFrame, rule: Rule, near_only: bool = True) -> DataFrame:
    """``a, b, n_a, n_b, common, linked`` of the pairs, or of those with near signatures only."""
    near_enough = (100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")) & (_distance(F.col("v_a"), F.col("v_b")) <= rule.distance)
    side = lambda n: classes.select(F.col("id").alias(n), F.col("n").alias(f"n_{n}"), F.col("values").alias(f"v_{n}"))
    near = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(near_enough if near_only else F.lit(True))
        .select("a", "b", "n_a", "n_b")
    )
    full = lambda n: sets.select(F.col("id").alias(n), F.col("found").alias(f"set_{n}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = near.join(full("b"), "b").join(full("a"), "a").select("a", "b", "n_a", "n_b", common.alias("common"))
    return both.withColumn("linked", 100 * F.col("common") >= rule.percent * (F.col("n_a") + F.col("n_b") - F.col("common")))


def find_components(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    return _components(docs, rule).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """The rows of ``docs``, with all columns, that have their component's id; repeated rows once.

    Of rows alike in id and text the one whose other columns come first, written as JSON, stays.
    """
    row = free_name(docs, "row")
    kept = _components(docs, rule).where("kept").select(F.col("row").alias(row)).distinct()
    left = docs.withColumn(row, row_key()).join(kept, row, "left_semi").drop(row)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return left.distinct()
    packed = left.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    first = packed.groupBy("doc_id", "text").agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
    return first.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns])


def _components(docs: DataFrame, rule: Rule) -> DataFrame:
    percent = rule.percent
    docs = docs.select("doc_id", "text", row_key().alias("row"))
    shape = "doc_id string, row string, n bigint, class binary, values array<bigint>, keys array<bigint>"
    signed = store_table(id_as_number(id_as_text(docs).mapInPandas(_signed(rule), shape)).withColumn("values", F.col("values").cast("array<int>")))
    first = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("values").alias("values"), F.first("keys").alias("keys"))
    classes = store_table(first.withColumn("id", F.monotonically_increasing_id()))

    # Only buckets of two or more matter, and of them only members that are not mostly their own.
    entries = classes.select(F.explode("keys").alias("key"), "id")
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    met = store_table(entries.join(shared, "key"))
    wanted = met.select("id").distinct().join(classes.select("id", "class", "least"), "id")
    texts = docs.join(wanted.select(F.col("least").alias("l")), F.col("doc_id").eqNullSafe(F.col("l")), "left_semi")
    sets = store_table(texts.mapInPandas(_sets(rule.size), "class binary, found array<bigint>").dropDuplicates(["class"]).join(wanted, "class").select("id", "found"))
    single = sets.select("id", F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1")
    own = single.groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    able = store_table(
        sets.select("id").join(own, "id", "left").join(classes.select("id", "n"), "id").select("id", "n", F.coalesce("u", F.lit(0)).alias("u")).where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n"))
    )
    members = store_table(met.join(able, "id").withColumn("order", F.struct((F.col("u") / F.col("n")).alias("share"), F.col("id").alias("i"))))

    hubs = members.groupBy("key").agg(F.min("order").alias("hub"), F.max("order").alias("last")).where("hub < last").select("key", F.col("hub.i").alias("hub"))
    around = store_table(members.join(hubs, "key").select("key", "hub", "id", "n", "u", "order"))
    tried = store_table(_common(around.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, sets, rule, near_only=False))
    roots = components(tried.where("linked"))
    open_ = _open(around, tried, percent)

    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_block_links(open_, roots, sets, percent)))

    rooted = classes.select("id", "class", "least").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    out = signed.select("doc_id", "row", F.col("n").alias("n_shingles"), "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _open(around: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Members that may be similar to another member than the hub, and all hubs.

    By the triangle inequality only partners y with |D(y)| - t n(y) <= |D(x)| + t n(x) count. In units of the
    hub's size that is a range of the bucket's members in the order of |D| - t n, for all x that
    are at most ``LARGER`` times the hub; larger ones stay open.
    """
    t = (100 - percent) / (100 + percent)
    sizes = F.col("a").alias("hub"), F.col("n_a").alias("n_hub"), F.col("b").alias("id"), (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("d")
    known = around.where("id <> hub").join(tried.select(*sizes), ["hub", "id"])
    least = (F.col("d") - t * F.col("n")) / F.col("n_hub")
    reach = (F.col("d") - 2 * F.col("u") + t * F.col("n")) / F.col("n_hub")
    within = Window.partitionBy("key").orderBy("scale").rangeBetween(Window.unboundedPreceding, int(2e6 * t * LARGER) + 2)
    widest = known.select("key", "hub", "id", "n", "n_hub", least.alias("least"), reach.alias("reach"), F.floor(least * 1_000_000).alias("scale")).withColumn("widest", F.max("reach").over(within))
    kept = (F.col("least") <= F.col("widest") + 1e-6) | (F.col("n") > LARGER * F.col("n_hub"))
    left = widest.where(kept).select("key", "hub", "id").unionByName(around.where("id = hub").select("key", "hub", "id"))
    # Two members are the hub and one that it was tried against.
    several = left.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 2").select("key")
    return left.join(several, "key").select("hub", "id").distinct()


def _block_links(open_: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between open members around a hub's component, one of them outside of it."""
    rooted = lambda df, name: df.join(roots.withColumnsRenamed({"node": name, "root": f"{name}_root"}), name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))
    met = rooted(rooted(open_, "hub"), "id").select(F.col("hub_root").alias("g"), "id", "id_root").distinct().withColumn("out", F.col("id_root") != F.col("g"))
    sizes = met.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.count_if("out").alias("k_out")).where("k_out > 0 and k > 2")
    blocks = lambda k: F.ceil(F.col(k) / BLOCK_MEMBERS).cast("int")
    placed = met.join(sizes, "g").select(
        "g", "id", "id_root", "out", blocks("k_out").alias("rows"), blocks("k").alias("columns"),
        F.pmod(F.xxhash64("id"), blocks("k_out")).cast("int").alias("row"), F.pmod(F.xxhash64("id"), blocks("k")).cast("int").alias("column"),
    )
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    asking = placed.where("out").select("g", "id", "id_root", "row", every("columns").alias("column"), F.lit(True).alias("asks"))
    asked = placed.select("g", "id", "id_root", every("rows").alias("row"), "column", F.lit(False).alias("asks"))
    filled = store_table(asking.unionByName(asked)).join(sets, "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ask, all_ = rows[rows["asks"]], rows[~rows["asks"]]
        pairs = _similar(ask["found"].tolist(), all_["found"].tolist(), percent)
        a, b = ask.iloc[pairs[:, 0]], all_.iloc[pairs[:, 1]]
        links = pd.DataFrame({"a": a["id"].to_numpy(), "b": b["id"].to_numpy()})
        return links[a["id_root"].to_numpy() != b["id_root"].to_numpy()]

    return filled.groupBy("g", "row", "column").applyInPandas(compare, "a bigint, b bigint")


def _similar(ask: list[np.ndarray], all_: list[np.ndarray], percent: int) -> np.ndarray:
    """Positions (in ``ask``, in ``all_``) of sets similar enough."""
    sizes = np.array([len(x) for x in all_], np.int64)
    flat = np.concatenate(all_) if all_ else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(all_)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = []
    for n, own in enumerate(ask):
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(all_))
        found += [(n, m) for m in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common))]
    return np.array(found, np.int64).reshape(-1, 2)
