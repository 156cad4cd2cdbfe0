"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A start is a position from which ``LENGTH`` bytes fit. Its anchor is the least hash, leftmost first, among
the ``KMER``-byte strings inside those bytes; equal strings have their anchor at the same place, so
a start can be repeated only where its anchor's string occurs twice. Each anchor with its run of
starts is a context: the bytes left of the anchor and the suffix that begins there. Contexts whose
anchor string is unique in the corpus are dropped by a count; the others are sorted:

* a task sorts the suffixes it read into runs and front-codes them (common prefix with the one
  before, and the rest), one run per part, parts being chosen by the anchor string;
* a part merges its runs with a loser tree that compares known common prefixes first and bytes only
  beyond them, so that it puts out every suffix with the length of its prefix in common with the last;
* suffixes that share their anchor string are neighbours. A context equal to another is repeated as
  a whole. Another one asks its partners in turns by most bytes in common on the left and by longest common
  prefix, and stops when the partners not yet asked cannot cover more than is covered.

Both extents are exact, so is the result. Of equal contexts, told by the anchor string's and the context's hashes, one
is sorted with their count, and what it covers is joined back to all their places, so that copies
never gather in a task; a part holds distinct contexts only. Matches never cross documents.

An anchor string amid many different contexts, such as one in a common line, does not make one group. Two contexts with L
common bytes on the left and R on the right repeat a start only if L + R >= ``LENGTH``, and then there is a multiple l of ``GRAIN``
with L >= l and R >= ``LENGTH - GRAIN - l``. So a context of such a string is sorted once for each l, with the
others that have the same l bytes on the left and the same further bytes on the right; every pair that counts meets in one of these
cells, and a line of less than ``LENGTH - GRAIN`` bytes fills none. Joins by anchor string and by context split keys of many rows.

NULL and empty texts have no bytes; texts shorter than ``LENGTH`` keep all. Repeated rows repeat each
other. Long texts are scanned in steps with an overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.columns import id_as_number, id_as_text
from nodeloom.operators.skew import PARTS, hot_keys, join_hot
from nodeloom.runtime import shuffle_partitions, store_table

LENGTH = 400
KMER = 32
SPAN = LENGTH - KMER + 1
STEP = 1 << 22
RUN_BYTES = 48_000_000
CONTEXTS_PER_PART = 40_000
WIDE = 1_000  # different contexts of an anchor string, beyond which they are sorted by cell
GRAIN = 50
CELL = 8  # bytes before a suffix that name its cell
HOT = 1_000  # a join splits keys of more than a thousandth of its rows, of which there are fewer than a thousand

_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _kmers(data: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes from each position, by doubling."""
    h, size, odd = _BYTES[data], 1, _ODD
    while size < KMER:
        h = h[:-size] * np.uint64(odd) + h[size:]
        odd = odd * odd % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` values, by doubling."""
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == span else np.minimum(values[: len(values) - (span - size)], values[span - size :])


def contexts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, first, last, kmer``: anchors, the range of their starts, and the hash of their string."""
    found = []
    for base in range(0, max(0, len(text) - LENGTH + 1), STEP):
        data = np.frombuffer(text, np.uint8, min(STEP + LENGTH - 1, len(text) - base), base)
        kmer = _kmers(data)
        place = _least(kmer & ~_PLACE | np.arange(len(kmer), dtype=np.uint64), SPAN) & _PLACE
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        anchor = place[first].astype(np.int64)
        found.append((anchor + base, first + base, last + base, kmer[anchor]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    anchor, first, last, kmer = (np.concatenate(x) for x in zip(*found))
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])  # a run may go on in the next step
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
    return anchor[new], first[new], last[ends], kmer[new].view(np.int64)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are given."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:  # a[:low] is common, a[:high] is not
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class LoserTree:
    """Merge of front-coded sorted runs. A run is a list of (common prefix with the last, rest, payload)."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.text: list[bytes | None] = [None] * self.leaves
        self.known = [0] * self.leaves  # bytes in common with the last suffix put out
        self.payload: list = [None] * self.leaves
        for n in range(len(runs)):
            self._next(n, b"")
        self.losers = [0] * self.leaves
        self.top = self._play(1)

    def _next(self, n: int, last: bytes) -> None:
        common, rest, self.payload[n] = next(self.runs[n], (0, None, None))
        self.text[n], self.known[n] = None if rest is None else last[:common] + rest, common

    def _play(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        return self._match(node, self._play(2 * node), self._play(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """Leave the loser at ``node``, with its prefix in common with the winner."""
        if self.text[a] is None or self.text[b] is None:
            a, b = (a, b) if self.text[b] is None else (b, a)
        elif self.known[a] < self.known[b]:
            a, b = b, a
        elif self.known[a] == self.known[b]:
            common = common_prefix(self.text[a], self.text[b], self.known[a])
            if self.text[b][common : common + 1] < self.text[a][common : common + 1]:
                a, b = b, a
            self.known[b] = common
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.text[self.top] is not None:
            winner, text = self.top, self.text[self.top]
            yield self.known[winner], text, self.payload[winner]
            self._next(winner, text)
            node = (winner + self.leaves) >> 1
            while node:
                winner = self._match(node, winner, self.losers[node])
                node >>= 1
            self.top = winner


def front_code(suffixes: list[bytes]) -> list[tuple[int, bytes]]:
    """Common prefix with the one before, and the rest, of sorted suffixes."""
    last, out = b"", []
    for s in suffixes:
        common = common_prefix(last, s)
        out.append((common, s[common:]))
        last = s
    return out


class RangeLeast:
    """Least value of any range of a list, by a table of powers of two for long lists."""

    def __init__(self, values: list[int]):
        self.values, self.table = values, []
        if len(values) > 64:
            row, size = np.array(values), 1
            while len(row):
                self.table.append(row)
                row = np.minimum(row[:-size], row[size:]) if len(row) > size else row[:0]
                size *= 2

    def __call__(self, low: int, high: int) -> int:
        """Of ``values[low:high]``, which is not empty."""
        if not self.table:
            return min(self.values[low:high])
        level = (high - low).bit_length() - 1
        row = self.table[level]
        return int(min(row[low], row[high - (1 << level)]))


def _outward(at: int, shared: list[int]) -> Iterator[tuple[int, int]]:
    """Places around ``at`` in the order of falling bytes in common, with these bytes."""
    up, down = at, at + 1
    above, below = shared[up], shared[down]
    while up > 0 or down < len(shared) - 1:
        if up > 0 and (above >= below or down >= len(shared) - 1):
            up -= 1
            yield up, above
            above = min(above, shared[up])
        else:
            yield down, below
            down += 1
            below = min(below, shared[down])


def _covers(group: list[tuple[bytes, bytes, int, object]], common: list[int]) -> Iterator[tuple[object, int, int]]:
    """For contexts (suffix, left, count, name) in suffix order: ranges of starts that occur elsewhere.

    ``common[n]`` bytes are shared by suffixes n - 1 and n. A range is (name, least, most) bytes
    that its starts lie before the anchor: a partner with L bytes in common on the left and R on the
    right covers the starts from LENGTH - R to L.
    """
    for suffix, left, count, name in group:
        if count > 1:
            yield name, LENGTH - len(suffix), len(left)
    n = len(group)
    if n < 2:
        return
    order = sorted(range(n), key=lambda x: group[x][1][::-1])
    backwards = [group[x][1][::-1] for x in order]
    lefts = [0, *(common_prefix(backwards[i - 1], backwards[i]) for i in range(1, n)), 0]
    rights = [0, *common[1:], 0]
    left_least, right_least = RangeLeast(lefts), RangeLeast(rights)
    at = [0] * n
    for i, x in enumerate(order):
        at[x] = i
    for x, (suffix, left, count, name) in enumerate(group):
        if count > 1:
            continue
        least = LENGTH - len(suffix)
        by_left, by_right = _outward(at[x], lefts), _outward(x, rights)
        most_left, most_right = len(left), len(suffix)  # of partners not yet asked
        covered: list[tuple[int, int]] = []

        def ask(partner: int, l: int | None, r: int | None) -> None:
            if l is None:
                l = left_least(min(at[x], at[partner]) + 1, max(at[x], at[partner]) + 1)
            if r is None:
                r = right_least(min(x, partner) + 1, max(x, partner) + 1)
            low = max(least, LENGTH - r)
            if low <= l and not any(a <= low and l <= b for a, b in covered):
                covered[:] = [(a, b) for a, b in covered if not (low <= a and b <= l)]
                covered.append((low, l))

        def settled() -> bool:
            """Whether all that unasked partners could cover is covered."""
            low = max(least, LENGTH - most_right)
            for a, b in sorted(covered):
                if a <= low <= b:
                    low = b + 1
            return low > most_left

        while not settled():
            step = next(by_left, None)
            if step is None:
                break
            most_left = step[1]
            ask(order[step[0]], step[1], None)
            if settled():
                break
            step = next(by_right, None)
            if step is None:
                break
            most_right = step[1]
            ask(step[0], None, step[1])
        for low, high in covered:
            yield name, low, high


def merge_part(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one part and tell what each context covers."""
    names = zip(rows["kmer"], rows["context"])
    rows = rows.assign(payload=list(zip(rows["left"], rows["n"], names))).sort_values(["run", "seq"])
    runs = [list(zip(r["common"], r["rest"], r["payload"])) for _, r in rows.groupby("run", sort=False)]
    out: list[tuple] = []
    group: list[tuple] = []
    common: list[int] = []
    for shared, suffix, (left, n, name) in LoserTree(runs):
        if shared < CELL + KMER and group:
            out.extend(_covers(group, common))
            group, common = [], []
        common.append(shared - CELL)
        group.append((suffix[CELL:], left, n, name))
    out.extend(_covers(group, common))
    return pd.DataFrame([(*name, low, high) for name, low, high in out], columns=["kmer", "context", "least", "most"])


def _sorted_runs(parts: int):
    """Sort and front-code the wanted contexts of a task: one run per part and ``RUN_BYTES`` of contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            held.sort()
            coded, last = [], (None, b"")
            for seq, (part, suffix, left, kmer, context, n) in enumerate(held):
                shared = common_prefix(last[1], suffix) if last[0] == part else 0
                coded.append((part, number, seq, shared, suffix[shared:], left, kmer, context, n))
                last = part, suffix
            return pd.DataFrame(coded, columns=["part", "run", "seq", "common", "rest", "left", "kmer", "context", "n"])

        for batch in batches:
            for text, wanted in zip(batch["text"], batch["wanted"]):
                data = text.encode("utf-8", "surrogatepass")
                anchors = {w["anchor"]: (w["n"], w["wide"]) for w in wanted}
                for p, s, e, k in zip(*(x.tolist() for x in contexts(data))):
                    if p in anchors:
                        suffix, left, (n, wide) = data[p : e + LENGTH], data[s:p], anchors[p]
                        context = _context_hash(data, p, s, e)
                        for part, cell in _cells(suffix, left) if wide else [(k, bytes(CELL))]:
                            held.append((part % parts, cell + suffix, left, k, context, n))
                            size += e + LENGTH - s + 200
                if size > RUN_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        yield flush()

    return run


def _cells(suffix: bytes, left: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and name of the cells of a context."""
    for l in range(0, LENGTH, GRAIN):
        r = LENGTH - GRAIN - l
        if l <= len(left) and r <= len(suffix):
            name = xxhash.xxh3_64_digest(left[len(left) - l :] + suffix[: max(r, KMER)], l + 1)
            yield int.from_bytes(name), name


def _context_hash(data: bytes, anchor: int, first: int, last: int) -> int:
    return xxhash.xxh3_64_intdigest(data[first : last + LENGTH], anchor - first) - (1 << 63)


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple] = []
        for row, text in zip(batch["row"], batch["text"]):
            data = text.encode("utf-8", "surrogatepass")
            for p, s, e, k in zip(*(x.tolist() for x in contexts(data))):
                out.append((row, p, k, _context_hash(data, p, s, e)))
        yield pd.DataFrame(out, columns=["row", "anchor", "kmer", "context"])


def _frequent(counts: DataFrame, keys: list[str], rows: str) -> DataFrame:
    total = counts.agg(F.sum(rows)).first()[0] or 0
    return hot_keys(counts, keys, rows, max(1, total // HOT))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``row, begin, end``: byte ranges of repeated strings; ``row`` is :func:`row_key`."""
    texts = docs.select(row_key().alias("row"), "text").where(F.octet_length("text") >= LENGTH)
    anchors = store_table(texts.mapInPandas(_anchor_rows, "row bigint, anchor bigint, kmer bigint, context bigint"))
    twice = store_table(anchors.groupBy("kmer").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    spread = F.col("row"), F.col("anchor")
    places = store_table(join_hot(anchors, twice.select("kmer"), ["kmer"], _frequent(twice, ["kmer"], "k"), spread))
    one = store_table(places.groupBy("kmer", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "anchor")).alias("first")))
    wide = hot_keys(one.groupBy("kmer").agg(F.count(F.lit(1)).alias("k")), ["kmer"], "k", WIDE)
    marked = one.join(F.broadcast(wide), "kmer", "left").withColumn("wide", F.col(PARTS).isNotNull())
    wanted = marked.groupBy("first.row").agg(F.collect_list(F.struct("first.anchor", "n", "wide")).alias("wanted"))
    total = marked.agg(F.sum(F.when(F.col("wide"), LENGTH // GRAIN).otherwise(1))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-total // CONTEXTS_PER_PART))
    shape = "part bigint, run bigint, seq bigint, common int, rest binary, left binary, kmer bigint, context bigint, n bigint"
    covered = (
        texts.join(wanted, "row")
        .mapInPandas(_sorted_runs(parts), shape)
        .repartition(parts, "part")
        .groupBy("part")
        .applyInPandas(merge_part, "kmer bigint, context bigint, least bigint, most bigint")
        .distinct()
    )
    joined = join_hot(places, covered, ["kmer", "context"], _frequent(one, ["kmer", "context"], "n"), spread)
    return joined.select(
        "row", (F.col("anchor") - F.col("most")).alias("begin"), (F.col("anchor") - F.col("least") + LENGTH).alias("end")
    )


def row_key():
    """Repeated rows share a key, and so their ranges, which are the same."""
    return F.xxhash64("doc_id", "text")


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {"doc_id": batch["doc_id"], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for text, ranges in zip(batch["text"], batch["ranges"]):
            data = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for begin, end in sorted((r["begin"], r["end"]) for r in (() if ranges is None else ranges)):
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([begin, end])
            edges = [0, *(x for s in spans for x in s), len(data)]
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(e - b for b, e in spans))
            out["spans"].append([{"begin": b, "end": e} for b, e in spans])
            out["kept"].append(b"".join(data[edges[n] : edges[n + 1]] for n in range(0, len(edges), 2)))
        yield pd.DataFrame(out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: removed byte spans and the bytes that stay.

    ``kept`` is binary, because a cut may fall within a character.
    """
    docs = docs.select("doc_id", "text")
    ranges = repeated_ranges(docs).groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    joined = docs.withColumn("row", row_key()).join(ranges, "row", "left").select("doc_id", "text", "ranges")
    shape = "doc_id string, n_bytes bigint, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    return id_as_number(id_as_text(joined).mapInPandas(_kept, shape))
