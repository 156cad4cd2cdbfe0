"""Token counts by a linear longest-match automaton.

The vocabulary's byte strings form a trie. Every node keeps a failure link and how many tokens are
popped on the way along it, so that a word is read once, byte by byte, and the number of tokens that
greedy longest match would cut is summed without building them. Transitions are completed for all
bytes beforehand (next node and popped tokens); leaving a node at the word's end pops its rest.

A word is a run of characters other than ASCII white space, read with a space before it. The vocabulary
must hold all single bytes, so that every text has a tokenization. Equal words of a batch are
counted once. NULL and empty texts have no words and no tokens. Repeated rows are counted alike; a
very long word is read to its end.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from nodeloom.llm.columns import id_as_number, id_as_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Tokens of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """``step[node, byte]`` and ``popped[node, byte]``; ``rest[node]`` tokens are left at a node."""

    def __init__(self, tokens: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            node = 0
            for byte in token:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            final[node] = node != 0
        if len(children[0]) < 256 or not all(final[c] for c in children[0].values()):
            raise ValueError("the vocabulary lacks single bytes")
        size = len(children)
        self.step, self.popped = np.zeros((size, 256), np.int32), np.zeros((size, 256), np.int16)
        self.rest = np.zeros(size, np.int32)
        link, pops = [0] * size, [0] * size
        level = [0]
        while level:
            for node in level:
                for byte, child in children[node].items():
                    self.step[node, byte], self.popped[node, byte] = child, 0
            below = []
            for node in level:
                for byte, child in children[node].items():
                    if final[child]:
                        link[child], pops[child] = 0, 1
                    elif node:  # the popped tokens of the parent, then on from its link with this byte
                        link[child] = int(self.step[link[node], byte])
                        pops[child] = pops[node] + int(self.popped[link[node], byte])
                    # Without a child of its own a node does what its link does, after popping.
                    self.step[child] = self.step[link[child]]
                    self.popped[child] = self.popped[link[child]] + pops[child]
                    self.rest[child] = self.rest[link[child]] + pops[child]
                    below.append(child)
            level = below

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each byte string, all of them advanced together by one byte at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(words) else sizes
        node, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        active = len(words)
        for at in range(int(sizes[0]) if len(words) else 0):
            active = int(np.searchsorted(-sizes[:active], -at, "left"))
            here, byte = node[:active], flat[starts[:active] + at]
            total[:active] += self.popped[here, byte]
            node[:active] = self.step[here, byte]
        out = np.empty(len(words), np.int64)
        out[order] = total + self.rest[node]
        return out


def count_tokens(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text.

    The automaton is broadcast; its size follows from the vocabulary, not from the documents.
    """
    held = docs.sparkSession.sparkContext.broadcast(sorted(set(tokens)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(held.value)
        for batch in batches:
            cut = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch["text"]]
            known = dict.fromkeys(w for words in cut for w in words)
            known = dict(zip(known, automaton.count([b" " + w for w in known]).tolist()))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_words": [len(words) for words in cut],
                    "n_tokens": [sum(map(known.__getitem__, words)) for words in cut],
                }
            )

    return id_as_number(id_as_text(docs.select("doc_id", "text")).mapInPandas(run, "doc_id string, n_words bigint, n_tokens bigint"))
