"""A hidden Markov language model over words, trained by Baum-Welch over all training documents.

Symbols are up to ``symbols`` most frequent training words, one class of all other words, and the end.
A word of that class is drawn from it in proportion to its count plus one, so that the model gives
every text a probability. Training starts from disturbed usual symbols and passes over all training
documents until their likelihood settles: every task computes expected counts with its own forward and backward
recursions, and counts are summed per symbol by a shuffle. The recursions run over whole texts, so that every move
is counted; texts are numbered once in a stored table, where those of like length lie together, so that a step of the
recursions serves many, and scoring can read that table again. Sums that a step is scaled by are taken every ``SCALED`` steps, and at every step again for texts
whose probabilities fall too fast for that. Updates are over-relaxed: a step of ``STRETCH`` times the one of Baum-Welch in the logarithms, which
converges for any factor below two near an optimum; should it lower the likelihood, the usual step is taken instead. Scoring is the scaled forward recursion over
whole texts, which needs one state vector per document.

Words of the large class need their counts: they are joined by word. Such a word is rarer than all
symbols, so that no key of that join holds a large share. Words are lower-cased in A-Z and cut at
ASCII white space; an end follows, also after a NULL or empty text. Repeated rows count and are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.columns import id_as_number, id_as_text
from nodeloom.runtime import drop_stored, store_table

STATES = 8
SYMBOLS = 32_768
SYMBOL_BYTES = 64
SETTLED = 1e-4
STRETCH = 1.8
FRESH = 32
SCALED = 8
FALLEN = 1e-20  # a sum over states below which scaling every few steps is not safe in 32 bits
TURNED = 131_072  # posteriors that are laid out by state at once
LEAST = 1e-30  # of an emission, so that 32-bit sums stay above 0
BATCH_TOKENS = 1_000_000
SERVED, LONG = 1_000, 2  # texts that a step should serve, and how much longer a batch may be for that
SCORED_TOKENS = 1_000_000
KIND_BYTES, TABLE_BYTES = 64, 33_554_432  # of a word besides its own in a table of counts, and of such a table
COUNTED_WORDS = 400_000
PRIOR = 0.1


def cut(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Model:
    """``symbols`` maps a frequent word to its number; then come the class of other words and the end."""

    symbols: dict[bytes, int]
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state

    @property
    def other(self) -> int:
        return len(self.symbols)

    @property
    def end(self) -> int:
        return len(self.symbols) + 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.symbols.get, words, repeat(self.other)), np.int32, len(words))
        out[-1] = self.end
        return out

    @property
    def stored(self) -> type:
        """The type that holds every number in stored texts."""
        return np.uint16 if len(self.emit) <= 1 << 16 else np.int32

    def updated(self, counts: Expected, usual: np.ndarray) -> Model:
        """The maximisation step, with a little of the usual distribution of symbols in every state."""
        start, move, emit = counts.start + PRIOR, counts.move + PRIOR, counts.emit + PRIOR * usual[:, None] * len(usual)
        return Model(self.symbols, start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def stretched(self, other: Model, by: float) -> Model:
        """``by`` times the way to ``other``, in the logarithms of all probabilities."""

        def far(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
            x = b * (b / a) ** (by - 1)
            return x / x.sum(axis, keepdims=True)

        return Model(self.symbols, far(self.start, other.start, 0), far(self.move, other.move, 1), far(self.emit, other.emit, 0))

    def parts(self) -> tuple:
        """What a broadcast carries, of types that every worker knows: ``Model(*parts)`` is the model again."""
        return self.symbols, self.start, self.move, self.emit

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log of the likelihood of each number sequence: forward, scaled every ``SCALED`` steps and at its end."""
        if not texts:
            return np.zeros(0)
        order, sizes, begin, x = _steps(texts)
        total, alpha = np.zeros(len(texts)), np.tile(self.start, (len(texts), 1))
        spare, scale = np.empty_like(alpha), np.empty_like(alpha)
        ones = np.ones_like(self.move)
        for t in range(sizes[0]):
            low, high = begin[t], begin[t + 1]
            n, going = high - low, (begin[t + 2] - high if t + 1 < sizes[0] else 0)
            now = spare[:n]
            if t:
                np.matmul(alpha[:n], self.move, out=now)
            else:
                now[:] = alpha
            now *= np.take(self.emit, x[low:high], axis=0)
            if going < n:
                total[going:n] += np.log(now[going:].sum(1))
            if t % SCALED == SCALED - 1 and going:
                now, sums = now[:going], scale[:going]
                np.matmul(now, ones, out=sums)
                now /= sums
                total[:going] += np.log(sums[:, 0])
            alpha, spare = spare, alpha
        out = np.empty(len(texts))
        out[order] = total
        return out


@dataclass
class Expected:
    """Expected counts of first states, of moves, and of symbols by state, and the log likelihood."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    likelihood: float = 0.0
    room: dict[str, np.ndarray] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def none(cls, symbols: int, states: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array of any content, in memory that the next texts take again."""
        size = int(np.prod(shape))
        if name not in self.room or len(self.room[name]) < size:
            self.room[name] = np.empty(size + size // 8, np.float32)
        return self.room[name][:size].reshape(shape)

    def add(self, model: Model, texts: list[np.ndarray], leads: list[bool] | None = None) -> None:
        """Forward and backward over whole sequences; those that do not lead a text go on within one.

        Sums over states are products with a square of ones, which keeps all arrays of one shape; the backward vectors
        are scaled by the forward sums, and anew every ``FRESH`` steps, so that rounding does not add up.
        """
        order, sizes, begin, x = _steps(texts)
        steps = sizes, begin, x.astype(np.intp)
        lead = np.ones(len(texts), bool) if leads is None else np.array(leads, bool)[order]
        if not self._add(model, lead, *steps, SCALED):
            self._add(model, lead, *steps, 1)

    def _add(self, model: Model, lead: np.ndarray, sizes: np.ndarray, begin: list[int], x: np.ndarray, scaled: int) -> bool:
        """With sums every ``scaled`` steps and at the ends; nothing is added if they fall below ``FALLEN`` on the way, unless at every step.

        Emissions are taken as shares of the symbol's greatest, so that a sum falls by what the moves lose alone.
        """
        width, many, states = int(sizes[0]), len(sizes), len(model.start)
        move = model.move.astype(np.float32)
        back, ones = np.ascontiguousarray(move.T), np.ones_like(move)
        given = np.maximum(model.emit, LEAST)
        most = given.max(1)
        emit, alpha = self._space("emit", len(x), states), self._space("alpha", len(x), states)
        np.take((given / most[:, None]).astype(np.float32), x, axis=0, out=emit, mode="clip")
        sums, likelihood = np.empty((many, states), np.float32), 0.0
        for t in range(width):
            low, high = begin[t], begin[t + 1]
            now, seen = alpha[low:high], emit[low:high]
            if t:
                np.matmul(alpha[begin[t - 1] : begin[t - 1] + high - low], move, out=now)
            else:
                now[:] = np.where(lead[:, None], model.start, model.move.mean(0))
            now *= seen
            if t % scaled == scaled - 1:
                total = sums[: high - low]
                np.matmul(now, ones, out=total)
                if scaled > 1 and not total[:, 0].min() > FALLEN:
                    return False
                now /= total
                seen /= total
                likelihood += float(np.log(total[:, 0], dtype=np.float64).sum())
        ends = alpha[np.array(begin)[sizes - 1] + np.arange(many)].sum(1, dtype=np.float64)
        if scaled > 1 and not ends.min() > FALLEN:
            return False
        self.likelihood += likelihood + float(np.log(ends).sum() + np.bincount(x, minlength=len(most)) @ np.log(most))
        beta = np.ones((many, states), np.float32)
        beta /= ends[:, None].astype(np.float32)
        moved = np.zeros((states, states))
        for t in range(width - 1, -1, -1):
            low, high = begin[t], begin[t + 1]
            n = high - low
            now, behind, after = alpha[low:high], emit[low:high], beta[:n]
            if t % FRESH == 0:
                after /= np.matmul(now * after, ones)
            behind *= after
            now *= after  # from here on the posterior
            if t:
                moved += alpha[begin[t - 1] : begin[t - 1] + n].T @ behind
                np.matmul(behind, back, out=after)
        self.move += moved * model.move
        self.start += alpha[:many][lead].sum(0)
        for low in range(0, len(x), TURNED):
            by_state = np.array(alpha[low : low + TURNED].T, np.float64, order="C")
            for k in range(states):
                self.emit[:, k] += np.bincount(x[low : low + TURNED], by_state[k], len(self.emit))
        return True


def _steps(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """``order, sizes, begin, x``: texts by falling size, and all symbols by step.

    Step t of all texts is ``x[begin[t] : begin[t + 1]]``, longest text first, so that nothing is padded.
    """
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[n]) for n in order])
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    begin = np.concatenate([[0], np.cumsum(active)])
    x = np.empty(begin[-1], texts[0].dtype)
    for n, at in enumerate(order):
        x[begin[: sizes[n]] + n] = texts[at]
    return order, sizes, begin.tolist(), x


def _gathered(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Whole texts of like length together, of about ``BATCH_TOKENS`` numbers, and of up to ``LONG`` times that while they are few.

    Lengths are alike within a power of two; what is left of each at the end goes together, shortest first.
    """
    held: dict[int, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    for text in texts:
        kind = len(text).bit_length()
        some = held.setdefault(kind, [])
        some.append(text)
        sizes[kind] += len(text)
        if sizes[kind] >= BATCH_TOKENS and (len(some) >= SERVED or sizes[kind] >= LONG * BATCH_TOKENS):
            yield held.pop(kind)
            sizes[kind] = 0
    some, size = [], 0
    for kind in sorted(held):
        if some and size + sizes[kind] > LONG * BATCH_TOKENS:
            yield some
            some, size = [], 0
        some, size = some + held.pop(kind), size + sizes[kind]
    if some:
        yield some


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: occurrences over all texts of ``docs``, without ends. Words are bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counted), pa.binary()), "c": pa.array(list(counted.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                counted.update(cut(text.as_py()))
                if len(counted) > COUNTED_WORDS:
                    yield rows()
                    counted.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def first_model(symbols: dict[bytes, int], usual: np.ndarray, states: int) -> Model:
    """Sticky moves and disturbed usual symbols."""
    rng = np.random.default_rng(1)
    emit = usual[:, None] * rng.gamma(1.0, 1.0, (len(usual), states)) + 1e-12
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(symbols, np.full(states, 1 / states), move, emit / emit.sum(0))


def numbered(docs: DataFrame, model: Model) -> DataFrame:
    """Other columns and ``numbers``: every text of ``docs`` as numbers of the type ``model.stored``, stored for all passes, by length within each file.

    With other columns there are ``words, times`` too, the words of the class of all other words, and ``row``, a number of the row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.parts())
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)

        def rows(part: pa.RecordBatch, numbers: list[bytes], rare: list[Counter]) -> pa.RecordBatch:
            columns = {c: part.column(n) for n, c in enumerate(others)} | {"numbers": pa.array(numbers, pa.binary())}
            if others:
                begin = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
                columns["words"] = pa.ListArray.from_arrays(begin, pa.array([w for r in rare for w in r], pa.binary()))
                columns["times"] = pa.ListArray.from_arrays(begin, pa.array([n for r in rare for n in r.values()], pa.int64()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            first, numbers, rare, size = 0, [], [], 0
            for n, text in enumerate(batch.column(len(others))):
                words = cut(text.as_py())
                found = own.numbers(words)
                numbers.append(found.astype(own.stored).tobytes())
                if others:
                    rare.append(Counter([words[k] for k in np.flatnonzero(found == own.other).tolist()]))
                size += len(found)
                if size >= SCORED_TOKENS or n + 1 == batch.num_rows:
                    yield rows(batch.slice(first, n + 1 - first), numbers, rare)
                    first, numbers, rare, size = n + 1, [], [], 0

    placed = docs.select(*others, "text")
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in placed.schema if f.name != "text") + "numbers binary"
    found = placed.mapInArrow(run, shape + (", words array<binary>, times array<bigint>" if others else ""))
    found = found.sortWithinPartitions(F.octet_length("numbers"))
    # Row numbers are fixed by writing the table.
    stored = store_table(found.withColumn("row", F.monotonically_increasing_id()) if others else found)
    held.unpersist()
    return stored


def expected_counts(texts: DataFrame, model: Model) -> Expected:
    """Expected counts over all of :func:`numbered`: by task, then summed per symbol.

    What comes to the driver has one row per symbol, move source, start and likelihood, whatever the input.
    """
    held = texts.sparkSession.sparkContext.broadcast(model.parts())
    size, states = len(model.emit), len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        counts = Expected.none(size, states)
        for some in _gathered(np.frombuffer(t.as_buffer(), own.stored).copy() for batch in batches for t in batch.column(0)):
            counts.add(own, some)
        rows = np.concatenate([counts.emit, counts.move, counts.start[None], np.full((1, states), counts.likelihood)])
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, k]) for k in range(states))], names=["place", *columns])

    columns = [f"s{k}" for k in range(states)]
    # One sum per core, however many files the texts have, and so more texts of one length in a task.
    own_cores = texts.select("numbers").coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    parts = own_cores.mapInArrow(run, "place bigint, " + ", ".join(f"{c} double" for c in columns))
    rows = np.zeros((size + states + 2, states))
    found = parts.groupBy("place").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    rows[found["place"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in columns])
    held.unpersist()
    return Expected(rows[-2], rows[size:-2], rows[:size], float(rows[-1, 0]))


@dataclass
class Trained:
    """The model, the counts of all words, and what follows from them."""

    model: Model
    counts: DataFrame
    common: dict[bytes, int]
    tokens: int
    kinds: int
    docs: int
    other_tokens: int
    other_kinds: int
    counts_bytes: int
    texts: DataFrame | None = None


def frequent(counts: DataFrame, symbols: int) -> dict[bytes, int]:
    """The ``symbols`` words of most occurrences; of words alike in that, the first by bytes.

    Counts per bin, a sixteenth of a power of two, of which there are about a thousand for any corpus, tell the bin
    where the words run out, so that only words from there on are put in order.
    """
    short = counts.where(F.octet_length("word") <= SYMBOL_BYTES).withColumn("bin", F.floor(16 * F.log2("c")))
    least, seen = None, 0
    for r in short.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")).collect():
        if seen >= symbols:
            break
        seen, least = seen + r.k, r.bin
    found = [] if least is None else short.where(F.col("bin") >= least).orderBy(F.desc("c"), "word").limit(symbols).collect()
    return {bytes(r.word): r.c for r in found}


def train(docs: DataFrame, states: int = STATES, symbols: int = SYMBOLS, settled: float = SETTLED, stretch: float = STRETCH, learn: Column | None = None) -> Trained:
    """Passes over all of ``docs`` until one raises the log likelihood by at most ``settled`` of it.

    With ``learn`` over all rows for which it is true; then every row is numbered once, for the passes and for :func:`score`.
    """
    whole = None if learn is None else with_id(docs).withColumn("learn", F.coalesce(learn, F.lit(False)))
    docs = docs if whole is None else docs.where(learn)
    counts = store_table(word_counts(docs))
    n_docs = docs.count()
    held = F.sum(F.octet_length("word") + F.lit(KIND_BYTES))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("k"), F.coalesce(held, F.lit(0)).alias("b")).first()
    common = frequent(counts, symbols)
    seen = sum(common.values())
    usual = np.array([*common.values(), sums.c - seen, n_docs], float) + 1e-3
    usual /= usual.sum()
    model = first_model({w: n for n, w in enumerate(common)}, usual, states)
    texts = None if whole is None else numbered(whole, model)
    if n_docs:
        learned = numbered(docs.select("text"), model) if whole is None else texts.where("learn")
        best, usual_step = -np.inf, model
        while True:
            found = expected_counts(learned, model)
            if not found.likelihood >= best and model is not usual_step:
                model = usual_step
                continue
            settles = not found.likelihood - best > settled * abs(found.likelihood)
            best, usual_step = found.likelihood, model.updated(found, usual)
            if settles:
                break
            model = model.stretched(usual_step, stretch)
        model = usual_step
        if whole is None:
            drop_stored(learned)
    return Trained(model, counts, common, sums.c + n_docs, sums.k + bool(n_docs), n_docs, sums.c - seen, sums.k - len(common), sums.b, texts)


def with_id(docs: DataFrame) -> DataFrame:
    """``doc_id`` as bigint, and the text."""
    return id_as_number(id_as_text(docs.select("doc_id", "text")))


def score(docs: DataFrame | None, trained: Trained) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row's whole text, in log10.

    Without ``docs`` of the rows that :func:`train` was given, which it numbered where it got ``learn``.
    """
    texts = trained.texts if docs is None else numbered(with_id(docs), trained.model)
    common = [c for c in trained.common.values()]
    over = trained.tokens + trained.kinds + 1
    over_other = trained.other_tokens + trained.other_kinds + 1
    logs = np.log10((np.array([*common, 0, trained.docs], float) + 1) / over)
    logs[-2] = 0  # words of the large class are added after the join
    end_known = int(trained.docs > 0)
    held = texts.sparkSession.sparkContext.broadcast((trained.model.parts(), logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base = held.value
        model = Model(*parts)

        def rows(part: pa.RecordBatch, numbers: list[np.ndarray]) -> pa.RecordBatch:
            columns = {
                "row": part.column(0),
                "doc_id": part.column(1),
                "n_tokens": pa.array([len(x) for x in numbers], pa.int64()),
                "known": pa.array([int((x < model.other).sum()) + end_known for x in numbers], pa.int64()),
                "base": pa.array([float(base[x].sum()) for x in numbers], pa.float64()),
                "forward": pa.array(model.scores(numbers) / np.log(10)),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            first, numbers, size = 0, [], 0
            for n, text in enumerate(batch.column(2)):
                numbers.append(np.frombuffer(text.as_buffer(), model.stored))
                size += len(numbers[-1])
                if size >= SCORED_TOKENS or n + 1 == batch.num_rows:
                    yield rows(batch.slice(first, n + 1 - first), numbers)
                    first, numbers, size = n + 1, [], 0

    scored = texts.select("row", "doc_id", "numbers").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, forward double")
    pairs = F.arrays_zip("words", "times")
    rare = texts.select("row", F.explode(pairs).alias("r")).select("row", F.col("r.words").alias("word"), F.col("r.times").alias("n"))
    log = lambda of: F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(of)))
    # Counts are held by word in tables of a bounded size, so that neither side is sorted.
    parts = 1 + trained.counts_bytes // TABLE_BYTES
    known = trained.counts.repartition(parts, "word").hint("shuffle_hash")
    more = (
        rare.repartition(parts, "word").join(known, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * log(over)).alias("more_base"),
            F.sum(F.col("n") * log(over_other)).alias("more_score"),
        )
    )
    joined = scored.join(more, "row", "left")
    plus = lambda a, b, zero: (F.col(a) + F.coalesce(F.col(b), F.lit(zero)))
    return joined.select(
        "doc_id", "n_tokens", plus("known", "more_known", 0).alias("n_known"),
        plus("base", "more_base", 0.0).alias("base_score"), plus("forward", "more_score", 0.0).alias("score"),
    )
