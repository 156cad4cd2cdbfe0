"""Baum-Welch passes of op5 read all training documents whole, until the likelihood settles."""

import random

import numpy as np
import pytest

from nodeloom.llm import hidden_markov as hm


def test_every_pass_counts_all_moves(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(None,), ("",)] + [(" ".join(rng.choices(("a b c", "x y z")[n % 2].split(), k=rng.randint(100, 700))),) for n in range(60)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    tokens = sum(len((t or "").split()) + 1 for (t,) in rows)
    found, whole = [], hm.expected_counts
    monkeypatch.setattr(hm, "expected_counts", lambda *a: found.append(whole(*a)) or found[-1])
    trained = hm.train(docs, states=2)
    for f in found:
        assert f.emit.sum() == pytest.approx(tokens, rel=1e-4)
        assert f.move.sum() == pytest.approx(tokens - len(rows), rel=1e-4)
        assert f.start.sum() == pytest.approx(len(rows), rel=1e-4)
    seen = [f.likelihood for f in found]
    assert seen == sorted(seen) and len(seen) > 2 and seen[-1] - seen[-2] <= hm.SETTLED * abs(seen[-1])
    numbers = [trained.model.numbers(hm.cut(t)) for (t,) in rows]
    assert trained.model.scores(numbers).sum() == pytest.approx(seen[-1], rel=10 * hm.SETTLED)


def test_long_text_keeps_its_posterior():
    rng = np.random.default_rng(5)
    draw = lambda *s: rng.dirichlet(np.ones(s[-1]), s[:-1])
    model = hm.Model({b"a": 0, b"b": 1}, draw(3), draw(3, 3), draw(3, 4).T)
    counts = hm.Expected.none(4, 3)
    counts.add(model, [rng.integers(0, 4, 50_000).astype(np.int32), np.array([3], np.int32)], [True, True])
    assert counts.emit.sum() == pytest.approx(50_001, rel=1e-5) and counts.move.sum() == pytest.approx(49_999, rel=1e-4)


def test_sums_every_few_steps_count_like_sums_at_every_step():
    rng = np.random.default_rng(6)
    draw = lambda *s: rng.dirichlet(np.ones(s[-1]), s[:-1])
    model = hm.Model({b"a": 0, b"b": 1}, draw(3), draw(3, 3), draw(3, 4).T)
    texts = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 7, 8, 9, 30, 31, 200)]
    order, sizes, begin, x = hm._steps(texts)
    few, every = hm.Expected.none(4, 3), hm.Expected.none(4, 3)
    for counts, scaled in ((few, hm.SCALED), (every, 1)):
        assert counts._add(model, np.ones(len(texts), bool), sizes, begin, x.astype(np.intp), scaled)
    for name in ("start", "move", "emit", "likelihood"):
        assert getattr(few, name) == pytest.approx(getattr(every, name), rel=1e-4, abs=1e-4)
    assert few.likelihood == pytest.approx(model.scores(texts).sum(), rel=1e-6)


def test_fast_falling_sums_are_taken_at_every_step():
    # Each symbol all but needs a state of its own, and states all but never change.
    move, emit = np.full((2, 2), 1e-9) + np.eye(2), np.array([[1, 1e-12], [1e-12, 1], [1e-12, 1e-12]])
    model = hm.Model({b"a": 0}, np.full(2, 0.5), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    texts = [np.tile(np.array([0, 1], np.int32), 20)]
    _, *steps = hm._steps(texts)
    counts = hm.Expected.none(3, 2)
    assert not counts._add(model, np.ones(1, bool), *steps, hm.SCALED) and not counts.emit.any()
    counts.add(model, texts)
    assert counts.emit.sum() == pytest.approx(40, rel=1e-4) and counts.likelihood == pytest.approx(model.scores(texts).sum(), rel=1e-4)


def test_texts_of_like_length_gather_whole(monkeypatch):
    monkeypatch.setattr(hm, "BATCH_TOKENS", 50)
    texts = [np.full(n, k) for k, n in enumerate((3, 90, 2, 3, 40, 300, 3, 60, 1, 5))]
    found = list(hm._gathered(iter(texts)))
    assert sorted(t[0] for some in found for t in some) == list(range(10)) and all(len(t) for some in found for t in some)
    assert [3, 3, 3] == [len(t) for some in found for t in some if len(t) == 3] and len(found) > 2


def test_score_reads_what_training_numbered(spark, monkeypatch):
    rows = [(n, t) for n, t in enumerate(["a b a", "B c", None, "", "a z z y", "q", "a b c d " * 30])] + [(None, "a a"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    learn = "coalesce(doc_id, 1) % 3 != 1"
    apart = hm.train(docs.where(learn), states=2, symbols=2)
    whole = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = whole(hm.score(docs, apart))
    cuts = []
    monkeypatch.setattr(hm, "numbered", lambda *a, keep=hm.numbered: cuts.append(1) or keep(*a))
    found = whole(hm.score(None, hm.train(docs, states=2, symbols=2, learn=hm.F.expr(learn))))
    assert cuts == [1] and len(found) == len(rows)
    for a, b in zip(found, want):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6)
