"""Token counts, decontamination and mixing against brute force over whole texts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from nodeloom.llm import decontaminate, mixing, token_counts

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (4, "x" * 40_000), (5, "a b c"), (5, "a b c"), (6, "😀é ü" * 500)]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id bigint, text string, n_words string, row int")


def greedy(word, tokens, longest):
    n = at = 0
    while at < len(word):
        at = next(at + k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in tokens)
        n += 1
    return n


def test_token_counts_match_greedy_cutting(spark, texts):
    tokens = token_counts.read_ranks()
    known, longest = set(tokens), max(map(len, tokens))
    memo = {}
    want = Counter()
    for i, t in texts:
        words = WORD.findall(t or "")
        for w in set(words) - memo.keys():
            memo[w] = greedy(b" " + w.encode(), known, longest)
        want[i, len(words), sum(memo[w] for w in words)] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(frame(spark, texts), tokens).collect()) == want
    assert token_counts.count_tokens(frame(spark, []), tokens).count() == 0


def test_automaton_pops_over_failure_links():
    letters = [bytes([b]) for b in range(256)]
    rng = random.Random(3)
    for _ in range(60):
        extra = {bytes(rng.choices(b"ab", k=rng.randint(2, 7))) for _ in range(rng.randint(1, 9))}
        tokens = set(letters) | extra
        words = [bytes(rng.choices(b"abc", k=rng.randint(0, 30))) for _ in range(80)]
        assert token_counts.Automaton(sorted(tokens)).count(words).tolist() == [greedy(w, tokens, 7) for w in words]
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a"])


def overlaps(docs, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for name, t in items:
        w = cut(t)
        for at in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[at : at + 10])].add("null" if name is None else str(name))
    lengths = sorted({len(k) for k in windows})
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        yield i, len(w), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("per_block", [20_000, 7])
def test_overlaps_match_brute_force(spark, texts, per_block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(900, None), (901, "..."), (902, "the of"), (903, "The, OF"), (None, "a b c"), (904, items[0][1]), (905, "le la é")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    docs = texts + [(70, items[3][1] + " and " + items[3][1].upper()), (71, (items[4][1] + " ") * 40)]
    got = decontaminate.find_overlaps(frame(spark, docs), bench, items_per_block=per_block).collect()
    have = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got)
    assert have == Counter(overlaps(docs, items))
    assert sum(1 for r in got if r.spans) > 10


def test_overlaps_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_overlaps(frame(spark, []), none).count() == 0
    assert [list(r.spans) for r in decontaminate.find_overlaps(frame(spark, [(1, "a b")]), none).collect()] == [[]]


def shares(size, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % 3] for n, s in enumerate(names)}
    target, full = {}, set()
    total = share * sum(size.values())
    while True:
        rest = total - sum(most * size[s] for s in full)
        target = {s: most * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        more = {s for s in names if s not in full and target[s] > most * size[s]}
        if not more:
            return target
        full |= more


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = [(n, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a"] * 30 + ["b", "é", "c", "d", None])) for n in range(4000)]
    rows += [(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (7, "x y", "b"), (7, "x y", "b"), (8, "", "empty")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, source string, size int")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in got) == Counter((r.doc_id, r.source, r.size, r.copies) for r in again)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    want = shares(dict(size))
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 31
    assert sum(r.copies * r.size for r in got) == pytest.approx(1.5 * sum(size.values()), rel=0.02)


def test_targets_fill_small_sources_first(spark):
    rng = random.Random(6)
    for n in range(4):
        size = {f"s{i:02d}": rng.choice([1, 5, 40, 300, 2000]) for i in range(rng.randint(1, 14))}
        sized = spark.createDataFrame([(s, x) for s, x in size.items()], "source string, size bigint")
        got = {r.source: r.target for r in mixing.targets(sized).collect()}
        assert got == pytest.approx(shares(size)), n


def test_mixing_of_few_rows(spark):
    shape = "doc_id bigint, text string, source string"
    assert mixing.mix(spark.createDataFrame([], shape)).count() == 0
    assert [r.copies for r in mixing.mix(spark.createDataFrame([(1, "", "a")], shape)).collect()] == [0]
    assert mixing.mix(spark.createDataFrame([(1, "a b", "a")], shape)).first().copies in (1, 2)


def test_mixing_passes_over_a_long_document(spark):
    """One document longer than what is missing does not end the filling; a full source has no waiting documents."""
    rng = random.Random(9)
    rows = [(n, "w " * (900 if n % 40 == 0 else rng.randint(1, 9)), "a") for n in range(1200)]
    rows += [(5000 + n, "w " * rng.randint(1, 9), "b") for n in range(600)] + [(9000, "w " * 30_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken, target, copies = defaultdict(int), {}, defaultdict(set)
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        copies[r.source].add(r.copies)
    for s in "ab":
        assert abs(taken[s] - target[s]) <= max(5, mixing.REST * target[s]), (s, taken[s], target[s])
    assert copies["b"] == {2}
