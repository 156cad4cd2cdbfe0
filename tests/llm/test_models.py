"""The two trained models: gradients, likelihoods, counts and held-out quality."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from nodeloom.llm import hidden_markov as hm
from nodeloom.llm import language_id
from nodeloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", "en"), (3, "123 ...", None), (None, "the of and", None), (4, "the " * 20_000, None), (4, "the of", "en"), (4, "the of", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.0) for r in rows], "doc_id bigint, text string, lang string, row int, score double")


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"], 3)
    for d in (net.forward, net.backward):
        d.table, d.recur = d.table.astype(float), d.recur.astype(float)
    x = rng.integers(0, 4, (7, 5)).astype(np.uint8)
    wanted = np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.probabilities(net.states(x))
        real = x != 0
        return -(np.log(p[:, np.arange(5), wanted]) * real).sum() / real.sum()

    for w, g in zip(net.weights(), net.gradient(x, wanted)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, near = w[at], []
        for e in (1e-2, -1e-2):
            w[at] = old + e
            near.append(loss())
        w[at] = old
        assert (near[0] - near[1]) / 2e-2 == pytest.approx(g[at], rel=2e-2, abs=1e-4)


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, FOLDER).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)


def test_language_edges(spark):
    docs = frame(spark, ODD)
    net = language_id.train(docs, 50, 2, 2)
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.predict(docs, net).collect())
    assert got == Counter([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en"), (4, "en"), (4, "en")])
    assert language_id.train(docs.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), net).count() == 0


def test_windows_pool_over_the_whole_text():
    net = language_id.Network.fresh(["a", "b"], 4)
    data = bytes(range(1, 250)) * 3
    p = []
    for at in range(0, len(data), language_id.WINDOW):
        part = np.frombuffer(data[at : at + language_id.WINDOW].ljust(language_id.WINDOW, b"\0"), np.uint8)[:, None]
        p.append(net.probabilities(net.states(part))[: len(data) - at, 0])
    assert np.allclose(net.documents([b"", data])[1], np.concatenate(p).mean(0), atol=1e-5)


def tiny(states=3, symbols=4):
    rng = np.random.default_rng(4)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hm.Model({b"a": 0, b"b": 1}, norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(m, x):
    for path in itertools.product(range(len(m.start)), repeat=len(x)):
        p = m.start[path[0]] * m.emit[x[0], path[0]]
        for a, b, s in zip(path, path[1:], x[1:]):
            p *= m.move[a, b] * m.emit[s, b]
        yield path, p


def test_forward_and_expected_counts_match_all_paths():
    m = tiny()
    texts = [np.array(x, np.int32) for x in ([0, 1, 2, 0, 3], [3], [2, 2, 3], [1, 3])]
    want = hm.Expected.none(4, 3)
    for x, s in zip(texts, m.scores(texts)):
        total = sum(p for _, p in paths(m, x))
        assert s == pytest.approx(math.log(total))
        for path, p in paths(m, x):
            want.start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want.move[a, b] += p / total
            for k, sym in zip(path, x):
                want.emit[sym, k] += p / total
    got = hm.Expected.none(4, 3)
    got.add(m, texts)
    for a, b in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)):
        assert np.allclose(a, b, atol=1e-4)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(9)
    texts = [np.array([*rng.integers(0, 2, 30), 3], np.int32) if n % 2 else np.array([*[2] * 30, 3], np.int32) for n in range(40)]
    m, last = tiny(), -np.inf
    for _ in range(6):
        now = m.scores(texts).sum()
        assert now >= last - 1e-3
        counts = hm.Expected.none(4, 3)
        counts.add(m, texts)
        m, last = m.updated(counts, np.full(4, 1e-9)), now


def test_base_scores_match_brute_force(spark):
    got = QUERIES["op5_lm_scoring"](spark, FOLDER).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    cut = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    count = Counter(w for i, words in cut.items() if not held[i] for w in words)
    n, v = sum(count.values()), len(count)
    better = []
    for r in got:
        words = cut[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(w in count for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        if r.held_out:
            better.append((r.score, r.base_score))
    assert len(got) == len(rows) and sum(s for s, _ in better) > sum(b for _, b in better)


def test_frequent_words(spark):
    counts = spark.createDataFrame([(bytearray(w.encode()), c) for w, c in {"a": 9, "b": 4, "c": 4, "d": 1, "x" * 70: 50}.items()], "word binary, c bigint")
    assert [list(hm.frequent(counts, n)) for n in (0, 1, 2, 3, 9)] == [[], [b"a"], [b"a", b"b"], [b"a", b"b", b"c"], [b"a", b"b", b"c", b"d"]]


def test_ties_fill_the_vocabulary(spark):
    counts = spark.createDataFrame([(bytearray(b"%03d" % n), 7) for n in range(50)], "word binary, c bigint")
    assert list(hm.frequent(counts, 40)) == [b"%03d" % n for n in range(40)]


def test_stretched_steps_reach_no_less_likelihood(spark):
    """Training with stretched steps settles, and its model is as good as that of usual steps."""
    rng = np.random.default_rng(4)
    kinds = [["a", "b", "c"], ["x", "y", "z"]]
    texts = [" ".join(rng.choice(kinds[n % 2], 40)) for n in range(60)]
    docs = frame(spark, [(n, t, None) for n, t in enumerate(texts)])
    totals = []
    for stretch in (1.0, hm.STRETCH):
        trained = hm.train(docs, states=2, stretch=stretch)
        totals.append(sum(r.score for r in hm.score(docs, trained).collect()))
    assert totals[1] >= totals[0] - 1e-3 * abs(totals[0])


def test_scores_are_probabilities_of_whole_texts(spark):
    """What the query adds up for words of the large class is the model's exact total over all paths."""
    docs = frame(spark, [(1, "a a b c", None), (2, "b d a", None), (3, "a e", None)])
    trained = hm.train(docs, states=2, symbols=2)
    counts = Counter(w for t in ("a a b c", "b d a", "a e") for w in t.split())
    rare = {w: c for w, c in counts.items() if w.encode() not in trained.common}
    over = sum(rare.values()) + len(rare) + 1
    for r in hm.score(docs, trained).collect():
        words = {1: "a a b c", 2: "b d a", 3: "a e"}[r.doc_id].split()
        x = trained.model.numbers([w.encode() for w in words])
        total = math.log10(sum(p for _, p in paths(trained.model, x)))
        total += sum(math.log10((rare[w] + 1) / over) for w in words if w in rare)
        assert r.score == pytest.approx(total)


def test_scores_of_odd_texts(spark):
    docs = frame(spark, ODD)
    trained = hm.train(docs, states=2, symbols=1)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in hm.score(docs, trained).collect())
    assert got == [(0, 4, 4), (1, 1, 1), (2, 1, 1), (3, 3, 3), (4, 3, 3), (4, 3, 3), (4, 20001, 20001)]
    none = hm.train(docs.limit(0), states=2)
    assert {(r.n_known, r.base_score) for r in hm.score(docs.where("doc_id = 1"), none).collect()} == {(0, 0.0)}
    assert hm.score(docs.limit(0), trained).count() == 0


def test_copies_do_not_crowd_out_a_language(spark):
    """Thousands of copies of one text are one text: its language is learned, and the sample keeps its bound."""
    same, rng = "the same words of one text again and again", np.random.default_rng(1)
    words = "une deux trois quatre cinq six sept huit neuf dix".split()
    rows = [(n, same, "en") for n in range(3_000)]
    rows += [(n, " ".join(rng.choice(words, 12)), "fr") for n in range(3_000)]
    sample = language_id.training_windows(frame(spark, rows), 40, 2)
    assert Counter(lang for lang, _ in sample) == {"en": 2, "fr": 80}
    again = language_id.training_windows(frame(spark, rows[::-1]).repartition(7), 40, 2)
    assert again == sample
