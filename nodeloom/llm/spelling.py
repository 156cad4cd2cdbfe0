"""Spelling variants: words at one inserted, deleted or replaced code point, by composing finite-state machines.

The vocabulary's minimised acceptor is composed with the transducer of exactly one edit and with the acceptor
again; accepted pairs are the near words. The composition is cut into partitions, each with an initial state of
its own: for a shorter word of ``size`` code points and a window of edit places, the words that agree before
and after the window. A pair's first difference lies in one window, so that the pair is accepted in exactly one
partition. Windows halve the word at first; a partition with more than ``limit`` words is cut into half windows,
down to windows of one place, where a partition holds at most as many words as the alphabet has pairs.

Defined cases: NULL texts have no words, a NULL id counts as no digits. Repeated rows count again. Words without
a near word have no form and are their own root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.columns import LOWER, UPPER
from nodeloom.runtime import drop_stored, store_table

# Fixed values of the query contract: letters, shortest word, least count, how often more a form has, misspelled share.
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, TIMES, ONE_IN = 7, 2, 10, 31
# Words of one partition that a task composes at once.
LIMIT = 2_000
# Rows of results that a batch holds.
BATCH_ROWS = 20_000


# -- words ---------------------------------------------------------------------------------


def misspelled(doc_id: Column, run: Column, one_in: int = ONE_IN) -> Column:
    """The lower-cased run, one of its code points deleted if the checksum of id and run is divisible by ``one_in``."""
    place = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(place.cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` code points that occur ``least`` times."""
    # A run of fewer letters gives no word, so that the expression asks for enough of them.
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = found.select(misspelled(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# -- machines ------------------------------------------------------------------------------


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words; each arc knows how many words precede those behind it."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        self._known: dict[tuple, int] = {}
        # The states of the last word that may still get arcs: whether final, and arcs without ranks.
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""
        for word in words:
            same = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            self._close(path, last, same)
            path.extend((False, {}) for _ in word[same:])
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])
        del self._known

    def _close(self, path: list, last: str, depth: int) -> None:
        while len(path) > depth + 1:
            target = self._state(*path.pop())
            path[-1][1][last[len(path) - 1]] = target

    def _state(self, final: bool, targets: dict[str, int]) -> int:
        """The state of this right language, new or known."""
        key = (final, *targets.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            count, arcs = int(final), {}
            for symbol, target in targets.items():
                arcs[symbol] = (target, count)
                count += self.words[target]
            self.arcs.append(arcs)
            self.final.append(final)
            self.words.append(count)
        return state


def compose(machine: Acceptor, open_end: bool) -> Iterator[tuple[int, int]]:
    """Ranks of the accepted pairs of ``machine``, one edit, ``machine``: each unordered pair once.

    Before the edit both sides stand in one state with one rank. An edit is a replacement, or a symbol that only
    the longer word has; as the edit stands at the first difference, the other word goes on with another symbol.
    A symbol too many at the very end counts only with an ``open_end``: otherwise what follows the window decides.
    """
    arcs, final = machine.arcs, machine.final

    def both(p: int, at_p: int, q: int, at_q: int, without: str | None) -> Iterator[tuple[int, int]]:
        """Words that both states accept; the second may not begin with ``without``."""
        stack = [(p, at_p, q, at_q, without)]
        while stack:
            p, at_p, q, at_q, without = stack.pop()
            if final[p] and final[q] and (without is None or open_end):
                yield at_p, at_q
            few, many = (arcs[p], arcs[q]) if len(arcs[p]) <= len(arcs[q]) else (arcs[q], arcs[p])
            for symbol in few:
                if symbol in many and symbol != without:
                    to_p, on_p = arcs[p][symbol]
                    to_q, on_q = arcs[q][symbol]
                    stack.append((to_p, at_p + on_p, to_q, at_q + on_q, None))

    waiting = [(machine.start, 0)]
    while waiting:
        state, at = waiting.pop()
        out = list(arcs[state].items())
        for n, (symbol, (to, on)) in enumerate(out):
            waiting.append((to, at + on))
            for _, (other, on_other) in out[n + 1 :]:
                yield from both(to, at + on, other, at + on_other, None)
            # A lone arc can only be a symbol too many at an end.
            if len(out) > 1 or final[state]:
                yield from both(to, at + on, state, at, symbol)


def near_in_partition(words: list[str], counts: list[int], shorter: int, open_end: bool) -> Iterator[tuple[int, int, int]]:
    """``place, number of near words, place of the best`` for each word (window contents, sorted) that has one.

    One of each pair has ``shorter`` code points; two words of one more meet in the partition of their own size.
    The best has the largest count; among equal counts it is the smallest word.
    """
    near, best = [0] * len(words), [-1] * len(words)
    short = [len(w) == shorter for w in words]
    if not any(short):
        return
    for pair in compose(Acceptor(words), open_end):
        if not (short[pair[0]] or short[pair[1]]):
            continue
        for one, other in (pair, pair[::-1]):
            near[one] += 1
            if best[one] < 0 or (counts[other], -other) > (counts[best[one]], -best[one]):
                best[one] = other
    yield from ((k, near[k], best[k]) for k in range(len(words)) if near[k])


# -- partitions ----------------------------------------------------------------------------

KEYS = ("size", "begin", "stop", "head", "tail")


def _windows(words: DataFrame, size: Column, begin: Column, stop: Column) -> DataFrame:
    """Place words into the partition of a window: what stands before and after it, as keys."""
    after = F.greatest(size - stop, F.lit(0))
    return words.select(
        "word", "n", size.alias("size"), begin.alias("begin"), stop.alias("stop"),
        F.substring(F.col("word"), F.lit(1), begin).alias("head"),
        F.substring(F.col("word"), F.length("word") - after + 1, after).alias("tail"),
    )


def _halves(words: DataFrame) -> DataFrame:
    """Split the window ``begin, stop`` of each row into two."""
    middle = F.floor((F.col("begin") + F.col("stop")) / 2).cast("int")
    parts = F.array(F.struct(F.col("begin").alias("b"), middle.alias("s")), F.struct(middle.alias("b"), F.col("stop").alias("s")))
    split = words.select("word", "n", "size", F.explode(parts).alias("w"))
    return _windows(split, F.col("size"), F.col("w.b"), F.col("w.s"))


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each partition: ``word, n_near, best_n, best``."""
    names = ["word", "n_near", "best_n", "best"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows: list[tuple] = []
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for at in range(batch.num_rows):
            size, begin, stop = (columns[k][at].as_py() for k in ("size", "begin", "stop"))
            members = sorted((m["word"], m["n"]) for m in columns["members"][at].as_py())
            after = max(size - stop, 0)
            inner = [w[begin : len(w) - after] for w, _ in members]
            order = sorted(range(len(inner)), key=inner.__getitem__)
            open_end = stop > size
            shorter = size - begin - after
            found = near_in_partition([inner[k] for k in order], [members[k][1] for k in order], shorter, open_end)
            for one, near, best in found:
                word, other = members[order[one]], members[order[best]]
                rows.append((word[0], near, other[1], other[0]))
            if len(rows) >= BATCH_ROWS:
                yield packed(rows)
                rows = []
    if rows:
        yield packed(rows)


def near_words(words: DataFrame, limit: int = LIMIT, shortest: int = SHORTEST) -> DataFrame:
    """``word, n_near, best_n, best`` for the words of ``word, n`` with a near word."""
    long = F.length("word")
    # A word is the shorter one of pairs with its own size, and the longer one of pairs with one less.
    sizes = words.select("word", "n", F.explode(F.array(long, long - 1)).alias("size")).where(F.col("size") >= shortest)
    whole = sizes.select("word", "n", "size", F.lit(0).alias("begin"), (F.col("size") + 1).alias("stop"))
    level, parts, held = _halves(whole), [], []
    while True:
        level = store_table(level)
        held.append(level)
        counts = level.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        wide = (F.col("members") > limit) & (F.col("stop") - F.col("begin") > 1)
        hot = store_table(counts.where(wide).drop("members"))
        held.append(hot)
        full = not hot.isEmpty()
        fitting = level.join(hot, list(KEYS), "left_anti") if full else level
        grouped = fitting.groupBy(*KEYS).agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1)
        found = grouped.select("size", "begin", "stop", "members").mapInArrow(_middles, "word string, n_near bigint, best_n bigint, best string")
        parts.append(store_table(found))
        if not full:
            break
        level = _halves(level.join(hot, list(KEYS), "left_semi"))
    for stored in held:
        drop_stored(stored)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    per_word = merged.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return per_word.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of the chain of forms.

    Each form is at least ``TIMES`` as frequent as its word, so chains are short; the length doubles per round.
    """
    ends = store_table(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        grown = ends.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        grown = store_table(grown)
        moved = not grown.where("moved").isEmpty()
        drop_stored(ends)
        ends = grown.drop("moved")
        if not moved:
            return ends


def group_variants(docs: DataFrame, limit: int = LIMIT, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the whole vocabulary."""
    words = store_table(vocabulary(docs))
    near = words.join(near_words(words, limit), "word", "left")
    frequent = F.col("best_n") >= times * F.col("n")
    facts = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"),
    )
    facts = store_table(facts)
    ends = roots(facts.where("form is not null"))
    return facts.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
