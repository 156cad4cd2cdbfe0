"""Spelling variants against brute force: words, machines, and the whole query."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from nodeloom.llm import spelling
from nodeloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    """By the longest common start and end."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    start = next((k for k in range(short) if a[k] != b[k]), short)
    end = next((k for k in range(short - start) if a[-1 - k] != b[-1 - k]), short - start)
    return start + end >= max(len(a), len(b)) - 1


def near_by_deletion(words):
    """All near pairs, from the texts with one place deleted; checked one by one."""
    meet = defaultdict(set)
    for w in words:
        meet[w].add(w)
        for k in range(len(w)):
            meet[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    return near


def expected(words):
    near, form = near_by_deletion(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


def as_found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")


def test_query_on_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(words_of(rows))
    assert len(want) > 500 and any(f[0] for f in want.values())
    assert as_found(QUERIES["op11_spelling_variants"](spark, SMALL)) == want


@pytest.mark.parametrize("limit", [1, 3, 2_000])
def test_dense_vocabulary_at_any_limit(spark, limit):
    """Few letters, so that most words are near, runs repeat, and partitions are cut again."""
    rng = random.Random(limit)
    known = ["".join(rng.choice("ab") for _ in range(rng.choice((7, 7, 8, 9)))) for _ in range(160)]
    known += ["é" * 7, "é" * 8, "aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa"]
    rows = [(n, f"{w} " * rng.choice((1, 2, 3, 30, 400))) for n, w in enumerate(known)]
    rows += [(None, "aaaaaaa Aaaaaaaa"), (None, None), (7, ""), (8, "÷×÷×÷×÷ " * 2), (9, "abc123 abcdefgh9abcdefgh")]
    rows += [(1, "Äaaaaaaa äaaaaaaa"), (1, "Äaaaaaaa äaaaaaaa")]
    want = expected(words_of(rows))
    assert max(f[3] for f in want.values()) > 5
    assert as_found(spelling.group_variants(frame(spark, rows), limit=limit)) == want


def test_long_words_chains_and_no_words(spark):
    long = "ab" * 10_000
    rows = [(1, f"{long} {long} {long}c {long}c"), (2, " ".join(["wordone"] * 400 + ["wordonee"] * 40 + ["wordoneee"] * 4))]
    # The checksum of one of the runs may delete a place: the brute force says.
    assert as_found(spelling.group_variants(frame(spark, rows))) == expected(words_of(rows))
    assert as_found(spelling.group_variants(frame(spark, []))) == {}
    chain = spark.createDataFrame([(f"w{n}", f"w{n + 1}") for n in range(11)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(chain).collect()} == {f"w{n}": "w11" for n in range(11)}


def test_machine_is_minimal_and_ranks_words():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 40))})
        machine = spelling.Acceptor(words)
        right = {}
        for state in range(len(machine.arcs)):
            language = [("", state)]
            held = set()
            while language:
                text, at = language.pop()
                if machine.final[at]:
                    held.add(text)
                language += [(text + c, to) for c, (to, _) in machine.arcs[at].items()]
            right[state] = frozenset(held)
        # No two states accept the same rest of words, and the start accepts the words.
        assert len(set(right.values())) == len(right) and right[machine.start] == set(words)
        for n, word in enumerate(words):
            state = machine.start
            rank = 0
            for c in word:
                state, on = machine.arcs[state][c]
                rank += on
            assert rank == n and machine.final[state]
        pairs = [tuple(sorted(p)) for p in spelling.compose(machine, open_end=True)]
        want = {(i, j) for i, a in enumerate(words) for j in range(i + 1, len(words)) if is_near(a, words[j])}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
