"""Fill-in-middle against a direct cut by a regular expression, and its round trip."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import infill
from nodeloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LARGE = (1 << 62) + 1
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (None, "no id at all"), (LARGE, "a large id"), (5, "twice"), (5, "twice"),
    (6, "has <P> inside"), (7, "<M>"), (8, "almost <P < M> <S"), (9, "one"), (10, "tail  "), (11, "é 😀 x y 漢字 <"),
    (12, "w " * 60_000), (13, "x" * 100_000), (14, "\x00 \x1f a"),
]


def expected(i, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def order(rows):
    return sorted(map(repr, rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id bigint, text string, output string, h1 int")


def test_cuts_equal_a_direct_cut(spark):
    rows = ODD + [(i, f"{t} {i}") for i in range(100, 400) for t in ("some words\nto cut", "<é> b  c")]
    got = infill.transform(frame(spark, rows)).collect()
    assert order(tuple(r) for r in got) == order(expected(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    back = infill.transform(frame(spark, rows)).select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t"))
    assert order(tuple(r) for r in back.collect()) == order((i, t or "") for i, t in rows)
    assert infill.transform(frame(spark, [])).count() == 0


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs:
        *facts, output = expected(r.doc_id, r.text)
        want.append((*facts, digest(output), digest(r.text or "")))
    assert order(tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, SMALL).collect()) == order(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    tokens = infill.SkipList(widths)
    assert [tokens.reach(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
    with pytest.raises(IndexError):
        tokens.reach(n + 1)
    if n == 1000:
        sizes = [len(lane.units) for lane in tokens.lanes]
        assert len(sizes) > 3 and all(a > b for a, b in zip(sizes, sizes[1:]))
        assert all(lane.units.sum() == n and lane.points.sum() == widths.sum() for lane in tokens.lanes)
        # Even where all nodes are equally tall the widths hold.
        assert infill.SkipList(widths, np.zeros(n, dtype=np.int64)).reach(500) == widths[:500].sum()
