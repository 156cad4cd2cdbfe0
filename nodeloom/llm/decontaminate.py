"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of documents in one task. Its words are numbered by the benchmark's vocabulary;
words outside it are zero, and an occurrence can't contain them. Stretches of numbered words that
are long enough for the shortest phrase form the shard's text, with a zero between them. The index is the
Burrows-Wheeler transform in a wavelet tree (one bit plane per bit of a word number, with prefix
ranks) plus every ``SAMPLE``-th suffix position. All phrases search backwards at once; occurrences
are located by stepping to sampled positions, and their words are marked in the documents.

A phrase is a window of ``window`` consecutive words of an item, or a whole shorter item. Phrases
are broadcast in blocks of a stated number of items, each block against all documents, so that the size of a
broadcast is bounded. NULL and empty texts have no words. Repeated rows get the same result, items
alike in text are all reported, and an item without id is reported as ``null``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.columns import id_as_text

WINDOW = 10
SAMPLE = 8
ITEMS_PER_BLOCK = 20_000
SHARD_WORDS = 2_000_000

# Bytes of words are digits, letters (in lower case) and all beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class FMIndex:
    """Backward search and location in an array of numbers below ``sigma``; 0 is never searched."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        self.n, self.bits = n + 1, max(1, int(sigma - 1).bit_length())
        order = self._suffixes(text)
        last = np.concatenate([text, [0]])[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=sigma))]).astype(np.int64)
        self.planes, self.zeros, row = [], [], last
        for bit in range(self.bits - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            self.planes.append(np.concatenate([[0], np.cumsum(~ones)]))
            self.zeros.append(int(self.planes[-1][-1]))
            row = np.concatenate([row[~ones], row[ones]])
        self.last = last
        # A row that follows a zero is kept too, because the way back does not lead across zeros.
        self.held = (order % SAMPLE == 0) | (last == 0)
        self.kept = np.cumsum(self.held) - 1
        self.sampled = order[self.held]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling until all suffixes are told apart. Zeros differ by their place."""
        n = len(text)
        gaps = np.cumsum(text == 0)
        rank = np.where(text == 0, gaps, text.astype(np.int64) + gaps[-1] if n else 0)
        rank = np.concatenate([rank, [0]])
        step = 1
        while True:
            second = np.zeros(n + 1, np.int64)
            second[: max(0, n + 1 - step)] = rank[step:] + 1
            order = np.lexsort((second, rank))
            a, b = rank[order], second[order]
            new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            rank = np.empty(n + 1, np.int64)
            rank[order] = new
            if new[-1] == n:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the transform."""
        low, high = np.zeros(len(at), np.int64), at
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            zl, zh = plane[low], plane[high]
            low = np.where(one, zeros + low - zl, zl)
            high = np.where(one, zeros + high - zh, zh)
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, the rows of ``phrases`` from column 0 on."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[on, lengths[on] - back]
            low[on] = self.first[symbol] + self.rank(symbol, low[on])
            high[on] = self.first[symbol] + self.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            there = self.held[here]
            found[open_[there]] = self.sampled[self.kept[here[there]]] + steps[open_[there]]
            open_, here = open_[~there], here[~there]
            symbol = self.last[here]
            rows[open_] = self.first[symbol] + self.rank(symbol, here)
            steps[open_] += 1
        return found


class Phrases:
    """The windows of a block of items: word numbers, lengths, and the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        known: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for at in range(max(1, len(numbers) - window + 1)) if numbers else ():
                known.setdefault(tuple(numbers[at : at + window]), set()).add(name)
        self.items = [sorted(x) for x in known.values()]
        self.lengths = np.array([len(k) for k in known], np.int64)
        self.rows = np.zeros((len(known), window), np.int64)
        for n, k in enumerate(known):
            self.rows[n, : len(k)] = k


def _shard_hits(numbers: list[np.ndarray], phrases: Phrases) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each document: marks of its words, and the items found in it."""
    marks, items = [np.zeros(len(x), bool) for x in numbers], [set() for _ in numbers]
    ends = np.cumsum([len(x) + 1 for x in numbers])
    flat = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    for x, end in zip(numbers, ends):
        flat[end - 1 - len(x) : end - 1] = x
    shortest = int(phrases.lengths.min()) if len(phrases.lengths) else 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat != 0, [0]]).astype(np.int8)))
    begin, stop = edge[::2], edge[1::2]
    long = stop - begin >= shortest
    begin, stop = begin[long], stop[long]
    if not shortest or not len(begin):
        return marks, items
    size = stop - begin + 1
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.repeat(begin - offset, size) + np.arange(size.sum())  # with the zero after each stretch
    index = FMIndex(flat[place], len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.rows, phrases.lengths)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    at = place[index.locate(rows)]
    change = np.bincount(at, minlength=len(flat) + 1) - np.bincount(at + phrases.lengths[which], minlength=len(flat) + 1)
    hit = np.cumsum(change) > 0
    doc = np.searchsorted(ends, at, "right")
    pairs = np.unique(doc * len(count) + which)
    for d in np.unique(doc):
        marks[d] = hit[ends[d] - 1 - len(numbers[d]) : ends[d] - 1]
    for d, w in zip(pairs // len(count), pairs % len(count)):
        items[d].update(phrases.items[w])
    return marks, items


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``doc_id, n_words, spans, items``: hit word ranges (start, end) and item ids found, sorted as text.

    With several blocks of items, documents are numbered once in a stored table and the blocks'
    results are joined by that number.
    """
    kind = docs.schema["doc_id"].dataType
    numbered = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text")
    blocks = max(1, -(-benchmark.count() // items_per_block))
    of = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    shape = "doc_id string, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"
    results = []
    if blocks > 1:
        from nodeloom.runtime import store_table

        docs = store_table(id_as_text(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id()))
        shape += ", row bigint"
    else:
        docs = id_as_text(docs.select("doc_id", "text"))
    for block in range(blocks):
        items = [(r.id, split_words(r.text)) for r in numbered.where(of == block).toLocalIterator()]
        held = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
        results.append(docs.mapInPandas(_searcher(held, blocks > 1), shape).withColumn("doc_id", F.col("doc_id").cast(kind)))
    if blocks == 1:
        return results[0]
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    joined = merged.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return joined.select("doc_id", "n_words", merge_spans("spans").alias("spans"), "items")


def merge_spans(spans: str):
    """Sorted spans as disjoint ones."""
    kind = "array<struct<start:int,end:int>>"

    def step(a, s):
        last = F.element_at(a, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(a) == 0) | (F.try_element_at(a, F.lit(-1))["end"] < s["start"]), F.concat(a, F.array(s))).otherwise(
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown))
        )

    return F.aggregate(F.col(spans), F.array().cast(kind), step)


def _searcher(held, with_row: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = held.value
        number = phrases.vocabulary.get

        def shard(rows: list[tuple], numbers: list[np.ndarray]) -> pd.DataFrame:
            marks, items = _shard_hits(numbers, phrases)
            out = {"doc_id": [r[0] for r in rows], "n_words": [len(x) for x in numbers], "spans": [], "items": [sorted(x) for x in items]}
            for m in marks:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], m, [0]]).astype(np.int8))) if m.any() else ()
                out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            frame = pd.DataFrame(out)
            return frame.assign(row=[r[1] for r in rows]) if with_row else frame

        rows, numbers, total = [], [], 0
        for batch in batches:
            ids = batch["doc_id"]
            for n, text in enumerate(batch["text"]):
                found = np.array([number(w, 0) for w in split_words(text)], np.int64)
                rows.append((ids.iloc[n], int(batch["row"].iloc[n]) if with_row else 0))
                numbers.append(found.astype(np.int32))
                total += len(found)
                if total >= SHARD_WORDS:
                    yield shard(rows, numbers)
                    rows, numbers, total = [], [], 0
        if rows:
            yield shard(rows, numbers)

    return run
