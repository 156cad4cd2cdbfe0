import itertools
import random

import numpy as np
import pytest
from conftest import as_map
from pyspark.sql import functions as F

from nodeloom.operators import binning as B
from nodeloom.operators import clustering as C
from nodeloom.operators.ego import ego_nets
from nodeloom.operators.embedding import svd_embedding
from nodeloom.operators import pagerank as P
from nodeloom.operators.pagerank import pagerank

# Fixed values of the sample graph.
RANKS = {1: 0.058855032, 2: 0.063599679, 3: 0.071380334, 4: 0.045303785, 5: 0.038551248, 6: 0.058855032}
WEIGHTED = {1: 0.047245253, 2: 0.063489884, 3: 0.070963090, 4: 0.045195527, 5: 0.041246941, 6: 0.070224037}
CC = {1: 1.0, 2: 0.4, 3: 0.4, 4: 1.0, 5: 1.0, 6: 1.0}

# A limit of one or two rows makes nearly every key hot, so the split joins are exercised.
HOT = [1_000_000, 2, 1]


def brute_ranks(pairs, weights=None, rounds=10, d=0.85, n=None):
    weights = weights or [1.0] * len(pairs)
    nodes = {v for p in pairs for v in p}
    n = n or max(nodes)
    total = {}
    for (s, _), w in zip(pairs, weights):
        total[s] = total.get(s, 0.0) + w
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        got = dict.fromkeys(nodes, 0.0)
        for (s, t), w in zip(pairs, weights):
            if total[s]:
                got[t] += rank[s] * w / total[s]
        rank = {v: d * x + (1 - d) / n for v, x in got.items()}
    return rank


def random_pairs(seed, nodes, count):
    r = random.Random(seed)
    # A third of the rows belong to one source.
    out = [(1 if r.random() < 0.33 else r.randint(1, nodes), r.randint(1, nodes)) for _ in range(count)]
    return [(s, t) for s, t in out if s != t]


@pytest.mark.parametrize("hot", HOT)
def test_pagerank_of_sample(sample, hot):
    assert as_map(pagerank(sample, hot_rows=hot)) == pytest.approx(RANKS, abs=1e-9)
    assert as_map(pagerank(sample, weighted=True, hot_rows=hot)) == pytest.approx(WEIGHTED, abs=1e-9)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_pagerank_of_skewed_graph(graph, hot):
    pairs = random_pairs(3, 40, 300)
    got = as_map(pagerank(graph(pairs), hot_rows=hot))
    assert got == pytest.approx(brute_ranks(pairs), abs=1e-12)
    assert all(x >= 0.15 / 40 - 1e-12 for x in got.values())


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_rounds_before_the_last_send_nothing_to_nodes_without_links(graph, monkeypatch, hot):
    """Few sources and many sinks; the links kept for those rounds lead to sources, repeated rows and hot ends included."""
    pairs = [(s, t) for s in range(1, 6) for t in range(1, 60) if s != t] + [(1, 2)] * 9 + [(2, 61), (70, 1)]
    kept = []
    select = P.links_to_sources

    def seen(*args, **options):
        kept.append(select(*args, **options))
        return kept[-1]

    monkeypatch.setattr(P, "links_to_sources", seen)
    for rounds in (1, 2, 10):
        assert as_map(pagerank(graph(pairs), rounds, hot_rows=hot)) == pytest.approx(brute_ranks(pairs, rounds=rounds), abs=1e-12)
    sources = {s for s, _ in pairs}
    assert len(kept) == 2 and {(r.src, r.dst) for r in kept[-1].collect()} == {(s, t) for s, t in pairs if t in sources} | {(70, 70)}
    pagerank(graph([(1, 2), (2, 3), (3, 1), (3, 4)]), 3)
    assert len(kept) == 2


def test_pagerank_special_graphs(spark, graph):
    assert as_map(pagerank(graph([(1, 1000)]), 2)) == pytest.approx(brute_ranks([(1, 1000)], rounds=2))
    counted = as_map(pagerank(graph([(1, 1000)]), 2, n_mode="count"))
    assert counted == pytest.approx(brute_ranks([(1, 1000)], rounds=2, n=2))
    cycle = as_map(pagerank(graph([(1, 2), (2, 3), (3, 1)])))
    assert len({round(x, 12) for x in cycle.values()}) == 1
    zero = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.0), (2, 3, 2.0)], "src bigint, dst bigint, weight double")
    want = brute_ranks([(1, 2), (1, 3), (2, 3)], [0.0, 0.0, 2.0])
    assert as_map(pagerank(zero, weighted=True)) == pytest.approx(want)
    assert pagerank(graph([(1, 1)])).count() == 0


@pytest.mark.parametrize("hot", HOT)
def test_clustering_of_sample(sample, hot):
    found = C.local_clustering(sample, hot)
    assert as_map(found.select("nodeid", "cc")) == pytest.approx(CC)
    assert as_map(found.select("nodeid", "triangles")) == {1: 1, 2: 4, 3: 4, 4: 1, 5: 1, 6: 1}
    average = C.average_clustering(found).first()
    assert average.avg_cc == pytest.approx(0.8) and average.mean_cc == pytest.approx(0.8)
    assert as_map(ego_nets(sample, hot)) == {1: (3, 3), 2: (6, 9), 3: (6, 9), 4: (3, 3), 5: (3, 3), 6: (3, 3)}


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_triangles_and_ego_nets_against_brute_force(graph, hot):
    pairs = random_pairs(5, 25, 160) + [(2, 3)] * 20
    linked = {frozenset(p) for p in pairs}
    want = {
        t for t in itertools.combinations(range(1, 26), 3)
        if all(frozenset(p) in linked for p in itertools.combinations(t, 2))
    }
    g = graph(pairs)
    got = [tuple(sorted(r)) for r in C.triangles(g, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    egos = {}
    for v in {v for p in pairs for v in p}:
        inside = {v} | {w for p in linked if v in p for w in p}
        egos[v] = (len(inside), sum(s in inside and t in inside for s, t in pairs))
    assert as_map(ego_nets(g, hot)) == egos


def test_candidates_do_not_depend_on_the_piece_size(graph):
    pairs = [(a, b) for a in range(1, 12) for b in range(a + 1, 12)]
    lists = C.neighbours(C.simple_edges(graph(pairs))).lists
    one, many = (sorted((r.x, r.y, tuple(r.rest)) for r in C.wedge_candidates(lists, p).collect()) for p in (256, 2))
    assert one == many and len(one) == 45


def test_ordered_neighbours_include_empty_lists(sample):
    lists = {r.nodeid: (r.degree, list(r.later)) for r in C.ordered_neighbour_lists(sample).collect()}
    assert lists == {1: (2, [2, 3]), 2: (5, [3]), 3: (5, []), 4: (2, [2, 3]), 5: (2, [2, 3]), 6: (2, [2, 3])}


def test_bins_of_sample(spark):
    table = spark.createDataFrame(list(RANKS.items()), "nodeid bigint, pagerank double")
    h = B.histogram(table, "pagerank", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 0, 2, 2]
    assert [r.center for r in h] == pytest.approx([0.042655, 0.050862, 0.059069, 0.067277], abs=1e-6)
    assert as_map(B.add_bins(table, ["pagerank"], 4).select("nodeid", "pagerank_bin")) == {1: 2, 2: 3, 3: 3, 4: 0, 5: 0, 6: 2}


def test_equal_values_make_one_bin_and_floor_rule_holds(spark):
    same = spark.createDataFrame([(1, 2.5), (2, 2.5)], "nodeid bigint, x double")
    assert [tuple(r) for r in B.histogram(same, "x", 7).collect()] == [(0, 2.5, 2)]
    assert {(r.x_bin, r.x_t) for r in B.add_bins(same, ["x"], 7).collect()} == {(0, 2.5)}
    edge = spark.createDataFrame([(0.0,), (0.3,), (1.0,), (None,)], "x double")
    assert [r.x_bin for r in B.add_bins(edge, ["x"], 10).orderBy("x").collect()] == [None, 0, 2, 9]
    assert B.histogram(edge.where("x is null"), "x", 5).count() == 0
    counted = B.with_bin_counts(B.add_bins(edge.where("x is not null"), ["x"], 2), "x", "n")
    assert sorted((r.x, r.n) for r in counted.collect()) == [(0.0, 2), (0.3, 2), (1.0, 1)]


def reference_vectors(pairs, k):
    m, n = max(s for s, _ in pairs), max(t for _, t in pairs)
    if m > n:
        pairs, m, n = [(t, s) for s, t in pairs], n, m
    a = np.zeros((m, n))
    for s, t in pairs:
        a[s - 1, t - 1] = 1.0
    _, s, vt = np.linalg.svd(a)
    v = vt[: min(k, int((s > 1e-7 * s[0]).sum()))].T
    return v * np.sign(v[np.argmax(np.round(np.abs(v), 9), axis=0), np.arange(v.shape[1])])


@pytest.mark.parametrize("side", [4096, 2])
def test_embedding_of_sample(sample, side):
    rows = sorted(tuple(r) for r in svd_embedding(sample, dense_side=side).collect())
    got = np.array([r[1:4] for r in rows])
    want = [
        [0.577740, 0, 0.402334, 0.246036, 0.331704, 0.577740],
        [-0.223166, 0, 0.709266, -0.543112, 0.319946, -0.223166],
        [0, 1, 0, 0, 0, 0],
    ]
    assert np.allclose(got.T, want, atol=1e-6)
    assert all(r[4] is not None and r[5:] == (None,) * 6 for r in rows)


@pytest.mark.parametrize("side", [4096, 5])
def test_embedding_against_numpy_with_flip_and_gaps(graph, side):
    r = random.Random(11)
    pairs = [(s, t) for s in range(1, 31) for t in range(1, 13) if s != t and r.random() < 0.15 + 0.6 * (s % 3 == t % 3)]
    got = np.array([t[1:] for t in sorted(tuple(x) for x in svd_embedding(graph(pairs), 3, dense_side=side).collect())])
    assert got.shape == (30, 3)
    assert np.allclose(got, reference_vectors(pairs, 3), atol=1e-6)


def test_embedding_rejects_nonpositive_ids(graph):
    with pytest.raises(ValueError):
        svd_embedding(graph([(1, 0), (1, 2)]))


def test_triangle_free_graphs_have_one_clustering_bin(graph):
    star = C.local_clustering(graph([(1, t) for t in range(2, 9)]))
    assert {r.cc for r in star.collect()} == {0.0}
    assert B.histogram(star, "cc", 10).agg(F.sum("count")).first()[0] == 8
