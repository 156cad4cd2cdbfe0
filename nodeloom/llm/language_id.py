"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions, labels every byte with
probabilities of the languages, and a document's probabilities are the mean over all its bytes.
It is trained in numpy by backpropagation through time on a bounded sample: at most ``per_language``
different texts of each language, those of the least hashes, and ``windows`` windows at hashed places of each.
Copies of a text count once. The model is a few thousand numbers, broadcast to the tasks; prediction is one
pass without a shuffle.

Only ``text`` is read for a prediction. A NULL text or one without a letter is ``und`` with score 0,
and so is every text when no label can be learned. Empty windows do not occur; the last window of a text is
padded with zero bytes that are not counted. Repeated rows get the same label, and a very long
text is read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.columns import id_as_number, id_as_text

UNKNOWN = "und"
WINDOW = 96
HIDDEN = 8
PER_LANGUAGE = 500
WINDOWS = 2
EPOCHS = 14
BATCH = 160
RATE = 0.02
# Windows that go through the network together: few enough for a core's cache.
BLOCK = 2048
# Texts drawn at first, in multiples of those wanted.
SURPLUS = 4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Direction:
    """One reading direction: input weights per byte and recurrent weights of the gates and candidate."""

    table: np.ndarray  # 256 x 3H: update, reset, candidate
    recur: np.ndarray  # H x 3H

    def states(self, x: np.ndarray) -> np.ndarray:
        """Hidden states (time, row, H) of byte windows (time, row)."""
        size = len(self.recur)
        h = np.zeros((x.shape[1], size), np.float32)
        out = np.empty((*x.shape, size), np.float32)
        # The gates need the exponential of the negative sum.
        sign = np.repeat(np.array([-1, 1], np.float32), [2 * size, size])
        table, recur = self.table * sign, self.recur * sign
        for t in range(len(x)):
            a, u = table[x[t]], h @ recur
            gates = a[:, : 2 * size]
            gates += u[:, : 2 * size]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new = u[:, 2 * size :]
            new *= gates[:, size:]
            new += a[:, 2 * size :]
            np.tanh(new, out=new)
            h = new + gates[:, :size] * (h - new)
            out[t] = h
        return out

    def gradient(self, x: np.ndarray, states: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of both weights, from those of the states, through time."""
        size = len(self.recur)
        d_table, d_recur = np.zeros_like(self.table), np.zeros_like(self.recur)
        carry = np.zeros(states.shape[1:], np.float32)
        for t in range(len(x) - 1, -1, -1):
            before = states[t - 1] if t else np.zeros_like(carry)
            a, u = self.table[x[t]], before @ self.recur
            gates = _sigmoid(a[:, : 2 * size] + u[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            new = np.tanh(a[:, 2 * size :] + r * u[:, 2 * size :])
            d = back[t] + carry
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * u[:, 2 * size :] * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], 1)
            d_u = np.concatenate([d_z, d_r, d_new * r], 1)
            np.add.at(d_table, x[t], d_in)
            d_recur += before.T @ d_u
            carry = d * z + d_u @ self.recur.T
        return d_table, d_recur


@dataclass
class Network:
    labels: list[str]
    forward: Direction
    backward: Direction
    output: np.ndarray  # 2H x labels
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 17) -> Network:
        rng = np.random.default_rng(seed)
        weights = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        one = lambda: Direction(weights(256, 3 * hidden), weights(hidden, 3 * hidden))
        return cls(labels, one(), one(), weights(2 * hidden, len(labels)), np.zeros(len(labels), np.float32))

    def states(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward.states(x), self.backward.states(x[::-1])[::-1]], 2)

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Per window position and label (time, row, label)."""
        p = states @ self.output
        p += self.bias
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        return p

    def weights(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.recur, self.backward.table, self.backward.recur, self.output, self.bias]

    def gradient(self, x: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over positions that are not padding."""
        states = self.states(x)
        d = self.probabilities(states)
        d[:, np.arange(len(wanted)), wanted] -= 1
        real = (x != 0)[:, :, None]
        d *= real / max(1, real.sum())
        back = d @ self.output.T
        hidden = len(self.forward.recur)
        ahead = self.forward.gradient(x, states[:, :, :hidden], back[:, :, :hidden])
        behind = self.backward.gradient(x[::-1], states[::-1, :, hidden:], back[::-1, :, hidden:])
        flat = states.reshape(-1, states.shape[2])
        return [*ahead, *behind, flat.T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))]

    def fit(self, x: np.ndarray, wanted: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam over shuffled batches; ``x`` is (window, time)."""
        rng = np.random.default_rng(seed)
        mean, square = ([np.zeros_like(w) for w in self.weights()] for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                step += 1
                pick = order[at : at + BATCH]
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for w, g, m, s in zip(self.weights(), self.gradient(np.ascontiguousarray(x[pick].T), wanted[pick]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)

    def document(self, data: bytes) -> np.ndarray:
        return self.documents([data])[0]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text, computed in blocks of windows."""
        total = np.zeros((len(texts), len(self.labels)))
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        for at in range(0, len(owner), BLOCK):
            own, off = owner[at : at + BLOCK], offset[at : at + BLOCK] * WINDOW
            block = b"".join(texts[o][a : a + WINDOW].ljust(WINDOW, b"\0") for o, a in zip(own.tolist(), off.tolist()))
            x = np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(-1, WINDOW).T)
            p = self.probabilities(self.states(x))
            tail = np.minimum(sizes[own] - off, WINDOW)
            for n in np.flatnonzero(tail < WINDOW):
                p[tail[n] :, n] = 0
            pooled = p.sum(0, dtype=np.float64)
            for c in range(len(self.labels)):
                total[:, c] += np.bincount(own, pooled[:, c], len(texts))
        return total / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> list[tuple[str, str]]:
    """``lang, window`` of a bounded sample of ``docs`` with a label and a text.

    The different texts of each language are counted first, about; a few times more texts than wanted are drawn by
    their hash, and the wanted ones of them are those of the least hashes.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).collect()
    if not counts:
        return []
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(SURPLUS * per_language / r["texts"]))))
    draw = lambda *more: F.pmod(F.xxhash64("text", *map(F.lit, more)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.where(draw() < share[F.col("lang")]).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw(), "text"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= per_language)

    def window(n: int) -> Column:
        begin = F.floor(draw(n) * F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int") + 1
        return F.substring(F.col("text"), begin, F.lit(WINDOW))

    rows = chosen.select("lang", F.explode(F.array(*map(window, range(windows)))).alias("window")).collect()
    return sorted((r["lang"], r["window"]) for r in rows)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, epochs: int = EPOCHS) -> Network | None:
    """Learn from ``lang`` and ``text`` of ``docs``; None if nothing is labelled."""
    rows = training_windows(docs, per_language, windows)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    number = {lang: n for n, lang in enumerate(labels)}
    x = b"".join(w.encode("utf-8", "replace")[:WINDOW].ljust(WINDOW, b"\0") for _, w in rows)
    network = Network.fresh(labels)
    network.fit(np.frombuffer(x, np.uint8).reshape(-1, WINDOW), np.array([number[lang] for lang, _ in rows]), epochs)
    return network


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` from the whole text of every row."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast((network.labels, network.weights()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, (ahead, ahead_recur, behind, behind_recur, output, bias) = held.value
        model = Network(labels, Direction(ahead, ahead_recur), Direction(behind, behind_recur), output, bias)
        names = np.array(model.labels, object)
        for batch in batches:
            known = batch["letter"].to_numpy(bool)
            texts = [t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(batch["text"], known)]
            p = model.documents(texts)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": np.where(known, names[p.argmax(1)], UNKNOWN),
                    "score": np.where(known, np.minimum(p.max(1), 1.0), 0.0),
                }
            )

    read = id_as_text(docs.select("doc_id", "text", letter.alias("letter")))
    return id_as_number(read.mapInPandas(run, "doc_id string, lang_pred string, score double"))
