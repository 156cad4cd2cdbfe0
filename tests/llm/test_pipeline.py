"""Every stage of the pipeline against brute force on what the stage before kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from nodeloom.llm import secret_scan
from test_dedup import brute_components
from test_maps import overlaps, shares
from test_native import measured, spans_of

FOLDER = "/root/testdata/sf0.001"


def redacted(text):
    out, at = [], 0
    for s, _, e in spans_of(text):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def passes(text):
    words, chars, symbols, dup, repeated = measured(text)
    lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n"))
    return not (
        words < 50 or 100 * repeated > 50 * words or 100 * symbols > 20 * chars or chars < 2 * words or chars > 20 * words
        or (dup > 2 and 100 * dup > 40 * lines)
    )


@pytest.mark.parametrize("odd", [False, True])
def test_stages(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if odd:
        rows = [(1, "a " * 60, None, None, None), (None, " ".join(f"w{n}" for n in range(80)), None, None, 3), (3, None, "en", "s", 1)]
        docs = docs.unionByName(spark.createDataFrame(rows * 2, docs.schema)).unionByName(docs.limit(20))
    have = docs.collect()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, rows: stages[name](spark, spark.createDataFrame(rows, docs.schema), FOLDER)

    first = step("quality_rules", have)
    assert first.columns == columns
    kept = first.collect()
    assert Counter(kept) == Counter(r for r in have if passes(r.text))

    second = step("near_duplicates", kept)
    assert second.columns == columns
    left = second.collect()
    judged = list(brute_components([(r.doc_id, r.text) for r in kept], 5, 80))
    assert Counter(left) == Counter({r for r, j in zip(kept, judged) if j[3]}) and len(left) < len(kept)

    third = step("decontamination", left)
    assert third.columns == columns
    clean = third.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    hit = [bool(o[2]) for o in overlaps([(r.doc_id, r.text) for r in left], items)]
    assert Counter(clean) == Counter(r for r, h in zip(left, hit) if not h) and any(hit)

    fourth = step("secret_scans", clean)
    assert fourth.columns == columns
    blank = fourth.collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in blank) == Counter((r.doc_id, redacted(r.text), len(redacted(r.text))) for r in clean)
    assert any("[secret]" in r.text for r in blank) and len(secret_scan.RULES) == 7

    last = step("source_mixing", blank)
    mixed = last.collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in blank:
        size[r.source] += len(r.text.split())
    for r in mixed:
        assert r.copies in (1, 2)
        taken[r.source] += r.copies * len(r.text.split())
    largest = max(len(r.text.split()) for r in blank)
    for s, goal in shares(dict(size)).items():
        assert abs(taken[s] - goal) <= largest / 2 + 1


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"] and out.count() > 50


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0


def test_clashing_columns_and_near_copies(spark):
    """Columns named like the stages' own, and a copy with a fifth more text: similarity 0.8 or more goes."""
    text = " ".join(f"word{n}" for n in range(400))
    near, far = text + " " + " ".join(f"more{n}" for n in range(90)), text + " " + " ".join(f"extra{n}" for n in range(110))
    names = "row _row _hit _mixed key _key copies spans size kept".split()
    rows = [(n, t, "en", "s", len(t), *["x"] * len(names)) for n, t in enumerate((text, near, far, " ".join(f"other{n}" for n in range(300))))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in names)
    docs, stages = spark.createDataFrame(rows, schema), dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        want = {0, 2, 3} if name == "near_duplicates" else {0, 1, 2, 3}
        assert {r.doc_id for r in out.collect()} == want
    last = stages["source_mixing"](spark, docs, FOLDER)
    assert last.columns == [*[c for c in docs.columns if c != "copies"], "copies"] and {r.copies for r in last.collect()} <= {1, 2}
