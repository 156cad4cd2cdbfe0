"""Near duplicates and repeated strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from nodeloom.llm import near_dedup, suffix_dedup
from nodeloom.llm.components import components
from nodeloom.llm.queries import QUERIES


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id bigint, text string, class string, id int, row int").repartition(parts)


def sets(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_components(rows, size=3, percent=85):
    found = [sets(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(found[a] & found[b])
            if both and 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
                root[top(a)] = top(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[top(n)].append(i)
    for n, (i, t) in enumerate(rows):
        c = i if not found[n] else min(least[top(n)], default=None)
        yield i, len(found[n]), c, i == c


def altered(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_match_brute_force(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A b"), (6, "b a"), (None, "a b"), (None, "q r s"), (7, "one"), (7, "one"), (8, "x " * 3000)]
    for _ in range(12):  # groups whose members lie around the threshold, with chains
        base = fresh(rng.randint(60, 240))
        rows += [(rng.randrange(10**6), altered(rng, base, rng.randint(0, max(1, len(base) // 40)))) for _ in range(rng.randint(2, 12))]
    chain = fresh(150)
    for n in range(25):
        chain = altered(rng, chain, 3).split()
        rows.append((5000 - n, " ".join(chain)))
    rng.shuffle(rows)
    for rule in (near_dedup.CONTRACT, near_dedup.NEAR):
        got = near_dedup.find_components(frame(spark, rows), rule).collect()
        assert Counter(tuple(r) for r in got) == Counter(brute_components(rows, rule.size, rule.percent))


def test_components_of_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in near_dedup.find_components(frame(spark, rows), near_dedup.CONTRACT).collect())
    assert got == Counter(brute_components(rows)) and any(not r[3] for r in got)
    assert near_dedup.find_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rule", [near_dedup.CONTRACT, near_dedup.NEAR])
def test_every_signature_pair_under_the_distance_meets(rule):
    rng = np.random.default_rng(2)
    assert rule.chunks * rule.places == near_dedup.VALUES
    for _ in range(300):
        a = rng.integers(0, 1 << 16, near_dedup.VALUES)
        b = a.copy()
        b[rng.choice(near_dedup.VALUES, rule.distance, replace=False)] ^= 1
        assert set(near_dedup.bucket_keys(a, rule)) & set(near_dedup.bucket_keys(b, rule))


def test_survivor_of_rows_alike_in_id_and_text(spark):
    """The row whose other columns come first stays, whatever the order of the input; names may clash."""
    text = " ".join(f"w{n}" for n in range(30))
    rows = [(1, text, s, k) for s, k in (("s3", 1), ("s1", 2), (None, 3))] + [(2, text, "s0", 1), (9, "x", "s", 1), (9, "x", "s", 1)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, row string, _row int").repartition(3)
        kept = near_dedup.keep_one(docs)
        assert kept.columns == docs.columns
        # A missing field is left out of the JSON, so that the next field comes first.
        assert sorted(tuple(r) for r in kept.collect()) == [(1, text, None, 3), (9, "x", "s", 1)]


def test_stars_settle_on_paths(spark):
    pairs = [(n, n + 1) for n in range(0, 60)] + [(100, 99), (99, 98), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: 0 for n in range(1, 61)} | {99: 98, 100: 98}


def brute_removed(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for (i, _), t in zip(rows, texts):
        cover = np.zeros(len(t) + 2, int)
        for at in range(len(t) - length + 1):
            if count[t[at : at + length]] > 1:
                cover[at + 1] += 1
                cover[at + length + 1] -= 1
        hit = np.cumsum(cover)[1:-1] > 0 if len(t) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        runs = int((np.diff(np.concatenate([[0], hit, [0]]).astype(int)) == 1).sum())
        yield i, len(t), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()


def digests(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("wide, hot", [(suffix_dedup.WIDE, suffix_dedup.HOT), (1, 10)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, wide, hot):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    text = lambda n, letters="abcdefgh éè\n": "".join(rng.choices(letters, k=n))
    shared = [text(n) for n in (390, 399, 400, 401, 430, 700, 1500)]
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "y" * 400), (5, "z" * 401), (6, "ab" * 900), (7, text(3000)), (None, shared[6]), (8, shared[6]), (8, shared[6])]
    for n in range(60):
        parts = [text(rng.randint(0, 500)) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[rng.choice([0, 0, 7, 200]) :])
        parts.insert(3, rng.choice(shared)[: rng.choice([400, 405, 2000])])
        rows.append((100 + n, "".join(parts)))
    for n in range(40):  # near copies
        copy = list(shared[6] + shared[5])
        for _ in range(3):
            copy[rng.randrange(len(copy))] = rng.choice("XYZ")
        rows.append((200 + n, "".join(copy)))
    assert digests(suffix_dedup.remove_repeats(frame(spark, rows))) == Counter(brute_removed(rows))


def test_cells_of_a_common_line_hold_one_context():
    """Every pair that repeats a start shares a cell; contexts around a shorter line share none."""
    rng = random.Random(8)
    line, far = rng.randbytes(340), lambda n: rng.randbytes(n)
    names = Counter(c for _ in range(200) for _, c in suffix_dedup._cells(line[150:] + far(201), far(200) + line[:150]))
    assert max(names.values()) == 1
    for _ in range(300):
        l = rng.randint(0, 368)
        r = rng.randint(max(400 - l, 32), 400)
        left, right = far(l), far(r)
        a, b = ({c for _, c in suffix_dedup._cells(right + far(400 - r), far(368 - l) + left)} for _ in range(2))
        assert a & b


def test_removed_bytes_of_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in QUERIES["op7_suffix_dedup"](spark, "/root/testdata/sf0.001").collect())
    assert got == Counter(brute_removed(rows))
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_long_texts_are_scanned_in_steps(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choices(b"abcd", k=9000))
    whole = suffix_dedup.contexts(data)
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.contexts(data)))


def test_loser_tree_merges_and_counts_prefixes():
    rng = random.Random(8)
    for runs in (1, 2, 3, 7, 16):
        lists = [sorted(bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 40))) for _ in range(runs)]
        coded = [[(c, r, None) for c, r in suffix_dedup.front_code(x)] for x in lists]
        out = list(suffix_dedup.LoserTree(coded))
        assert [s for _, s, _ in out] == sorted(s for x in lists for s in x)
        last = b""
        for known, s, _ in out:
            assert known == suffix_dedup.common_prefix(last, s)
            last = s
