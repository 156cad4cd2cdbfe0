"""Fill-in-middle: a text is cut at two token ranks and its parts are put into another order.

The cut ranks are numbers of tokens, the cuts are code points. An indexable skip list over the tokens answers
one from the other: every link of every lane carries how many tokens and how many code points it passes, and
the descent from the top lane adds both widths up until the rank is reached exactly.

Defined cases: NULL text counts as empty, and a NULL id as no digits after the seed. An empty text, and one
that holds a marker, stays plain. Repeated rows are treated alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers, the white space of tokens, and the percentages of the query contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 50, 80
SEED = 42
# One node in 2**LIFT of a lane is in the next lane too; a batch that is sent on holds about this many characters.
LIFT = 2
BATCH_CHARS = 8_000_000


class Cut(NamedTuple):
    """How documents are drawn and cut: the seed, and the percentages of cut texts and of suffix-first ones."""

    seed: int = SEED
    rate: int = PLAIN_FROM
    spm: int = SPM_BELOW


class Lane(NamedTuple):
    """The links of one lane in order: tokens and code points passed, and the place of a link's start one lane below."""

    units: np.ndarray
    points: np.ndarray
    below: np.ndarray


def heights(n: int) -> np.ndarray:
    """The topmost lane of the first ``n`` nodes: a mixed counter's trailing zero bits, the same in every run."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**64 - 1)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    low = x & (~x + np.uint64(1))
    return (np.log2(np.maximum(low, 1).astype(float)) // LIFT).astype(np.int64)


class SkipList:
    """Lanes over tokens of given code-point widths; the head of each lane is the start of the text."""

    def __init__(self, widths: np.ndarray, tall: np.ndarray | None = None):
        n = len(widths)
        tall = heights(n) if tall is None else tall[:n]
        # The node after token t starts the link to token t + 1; node 0 is the head and is in every lane.
        starts = np.arange(n)
        level = np.concatenate([[np.iinfo(np.int64).max], tall[: n - 1]]) if n else tall
        lane = Lane(np.ones(n, dtype=np.int64), np.asarray(widths, dtype=np.int64), starts)
        self.lanes = [lane]
        while len(lane.units) > 1:
            kept = np.flatnonzero(level >= len(self.lanes))
            if len(kept) == len(level):
                break
            lane = Lane(np.add.reduceat(lane.units, kept), np.add.reduceat(lane.points, kept), kept)
            self.lanes.append(lane)
            level = level[kept]

    def reach(self, rank: int) -> int:
        """Code points before the token of this rank; the number of tokens gives the length of the text."""
        at = points = 0
        for lane in reversed(self.lanes):
            while at < len(lane.units) and lane.units[at] <= rank:
                rank -= int(lane.units[at])
                points += int(lane.points[at])
                at += 1
            if at == len(lane.units):
                break
            at = int(lane.below[at])
        if rank:
            raise IndexError("rank beyond the last token")
        return points


def token_ends(text: str) -> np.ndarray:
    """Code-point ends of the tokens: white space and the word after it, or white space at the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    if not len(space):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(space)) if space[-1] else ends


def arranged(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def transform(docs: DataFrame, cut: Cut = Cut()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per document; ``output`` is the whole text."""
    drawn = F.sha2(F.concat(F.lit(f"{cut.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *group)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def one(text: str, h: list[int], tall: list[np.ndarray]) -> tuple:
        ends = token_ends(text)
        n = len(ends)
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= cut.rate:
            return n, "plain", None, None, text
        if n > len(tall[0]):
            tall[0] = heights(2 * n)
        tokens = SkipList(np.diff(ends, prepend=0), tall[0])
        first, last = (tokens.reach(rank) for rank in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        form = "spm" if h[3] % 100 < cut.spm else "psm"
        return n, form, first, last - first, arranged(form, text[:first], text[first:last], text[last:])

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tall = [heights(1 << 12)]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

        def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(values, type=kind) for values, kind in zip(zip(*rows), types)]
            columns[-1] = columns[-1].cast(pa.string())
            return pa.RecordBatch.from_arrays([ids, *columns], names=names)

        for batch in batches:
            h = np.stack([batch.column(k).to_numpy() for k in range(2, 6)]) if batch.num_rows else None
            rows, held, start = [], 0, 0
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                rows.append(one(text, [int(x) for x in h[:, at]], tall))
                held += len(text)
                if held >= BATCH_CHARS or at + 1 == batch.num_rows:
                    yield packed(batch.column(0).slice(start, at + 1 - start), rows)
                    rows, held, start = [], 0, at + 1

    kind = given.schema["doc_id"].dataType.simpleString()
    given = given.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return given.mapInArrow(cut_batches, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def restored(output: Column, form: Column) -> Column:
    """The text before the cut. The parts of a cut text hold no marker, so that each marker stands once."""
    part = F.split(output, "<[PSM]>", -1)
    at = lambda k: F.get(part, F.lit(k))
    return (
        F.when(form == "psm", F.concat(at(1), at(3), at(2)))
        .when(form == "spm", F.concat(at(2), at(3), at(1)))
        .otherwise(output)
    )
