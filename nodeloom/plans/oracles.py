"""SQL for DuckDB that states what each registered query returns."""

from __future__ import annotations

E = """e AS (SELECT l_suppkey + 1 AS src, l_partkey + 1 AS dst, l_quantity AS weight
  FROM lineitem WHERE l_suppkey + 1 > 0 AND l_suppkey <> l_partkey)"""
LINES = """t AS (SELECT CAST(l_suppkey + 1 AS VARCHAR) AS s, CAST(l_partkey + 1 AS VARCHAR) AS p,
  CAST(l_quantity AS VARCHAR) AS q, l_suppkey + 1 AS src, l_partkey + 1 AS dst, l_quantity AS weight,
  (l_orderkey + l_linenumber) % 7 AS kind FROM lineitem)"""
TOTAL = """deg AS (SELECT nodeid, CAST(count(*) AS BIGINT) AS degree
  FROM (SELECT src AS nodeid FROM e UNION ALL SELECT dst FROM e) GROUP BY nodeid)"""
WEIGHTED_TOTAL = """deg AS (SELECT nodeid, sum(weight) AS degree
  FROM (SELECT src AS nodeid, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY nodeid)"""
SIMPLE = """s AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e),
sd AS (SELECT nodeid, CAST(count(*) AS BIGINT) AS degree
  FROM (SELECT u AS nodeid FROM s UNION ALL SELECT v FROM s) GROUP BY nodeid)"""
ORIENTED = (
    SIMPLE
    + """,
o AS (SELECT CASE WHEN f THEN u ELSE v END AS x, CASE WHEN f THEN v ELSE u END AS y,
    CASE WHEN f THEN dv ELSE du END AS dy
  FROM (SELECT u, v, a.degree AS du, b.degree AS dv,
      a.degree < b.degree OR (a.degree = b.degree AND u < v) AS f
    FROM s JOIN sd a ON a.nodeid = u JOIN sd b ON b.nodeid = v))"""
)
TRIANGLES = (
    ORIENTED
    + """,
tri AS (SELECT p.x, p.y, q.y AS z FROM o p JOIN o q ON p.x = q.x AND (p.dy < q.dy OR (p.dy = q.dy AND p.y < q.y))
  JOIN o c ON c.x = p.y AND c.y = q.y),
tc AS (SELECT nodeid, CAST(count(*) AS BIGINT) AS triangles
  FROM (SELECT x AS nodeid FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY nodeid)"""
)
LCC = (
    TRIANGLES
    + """,
cc AS (SELECT sd.nodeid, degree, coalesce(triangles, 0) AS triangles,
    CASE WHEN degree < 2 THEN 0.0::DOUBLE
      ELSE coalesce(triangles, 0) / (0.5::DOUBLE * degree * (degree - 1)) END AS cc
  FROM sd LEFT JOIN tc ON tc.nodeid = sd.nodeid)"""
)
M = """m AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""
THIN = """th AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS position,
  CAST(unnest(embedding) AS DOUBLE) AS v,
  CASE WHEN abs(CAST(unnest(embedding) AS DOUBLE)) < 0.1::DOUBLE THEN 0.0::DOUBLE
    ELSE CAST(unnest(embedding) AS DOUBLE) END AS t FROM embeddings)"""
PAIRS = (
    THIN
    + """,
pr AS (SELECT a.vec_id, a.position, a.v AS a, b.v AS b, a.t AS ta, b.t AS tb
  FROM th a JOIN th b ON b.vec_id = a.vec_id + 1 AND b.position = a.position)"""
)


def _measure(name: str, column: str) -> str:
    return f"""{name} AS (SELECT l_suppkey AS i, l_partkey % 50 AS j, sum({column}) AS v
  FROM lineitem GROUP BY ALL)"""


QUANTITY, TAX = _measure("a", "l_quantity"), _measure("b", "l_tax")

CELLS = "k AS (SELECT l_orderkey AS i, l_partkey % 50 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _ranks(rounds: int = 10, weighted: bool = False, size: str = "max(nodeid)") -> str:
    """PageRank as one chained step per round; the last one is ``ranks``."""
    amount = "sum(weight)" if weighted else "CAST(count(*) AS DOUBLE)"
    steps = [
        f"links AS (SELECT src, dst, amount / sum(amount) OVER (PARTITION BY src) AS share FROM (SELECT src, dst, {amount} AS amount FROM e GROUP BY src, dst))",
        "nodes AS (SELECT src AS nodeid FROM e UNION SELECT dst FROM e)",
        f"n AS (SELECT CAST({size} AS DOUBLE) AS n FROM nodes)",
        "r0 AS (SELECT nodeid, 1 / n AS rank FROM nodes, n)",
    ]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS (SELECT nodeid, coalesce(s, 0) * 0.85::DOUBLE + (1 - 0.85::DOUBLE) / n AS rank FROM nodes LEFT JOIN "
            f"(SELECT dst, sum(share * rank) AS s FROM links JOIN r{k - 1} ON nodeid = src GROUP BY dst) ON dst = nodeid, n)"
        )
    steps.append(f"ranks AS (SELECT nodeid, round(rank, 12) AS pagerank FROM r{rounds})")
    return ",\n".join(steps)


def _bin(value: str, bins: int) -> str:
    return f"CASE WHEN hi = lo THEN 0 ELSE CAST(least(greatest(floor(({value} - lo) / ((hi - lo) / {bins})), 0), {bins - 1}) AS INTEGER) END"


def _center(index: str, bins: int) -> str:
    return f"CASE WHEN hi = lo THEN lo ELSE lo + ({index} + 0.5::DOUBLE) * (hi - lo) / {bins} END"


def _histogram(source: str, column: str, bins: int, digits: int) -> str:
    """The last steps of a histogram over ``source``."""
    return f"""lim AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
h AS (SELECT {_bin(column, bins)} AS bin, CAST(count(*) AS BIGINT) AS n FROM {source}, lim GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round({_center('r.bin', bins)}, {digits}) AS center, coalesce(n, 0) AS count
FROM (SELECT range AS bin FROM range({bins})) r CROSS JOIN lim LEFT JOIN h ON h.bin = r.bin"""


_COMBINED = f"""{E}, {TOTAL}, {_ranks()}, {LCC},
dc AS (SELECT degree, CAST(count(*) AS BIGINT) AS count FROM deg GROUP BY degree),
pl AS (SELECT min(pagerank) AS lo, max(pagerank) AS hi FROM ranks),
pb AS (SELECT nodeid, pagerank, {_bin('pagerank', 1000)} AS b, lo, hi FROM ranks, pl),
pt AS (SELECT nodeid, pagerank, {_center('b', 1000)} AS t, CAST(count(*) OVER (PARTITION BY b) AS BIGINT) AS n FROM pb),
cl AS (SELECT min(cc) AS lo, max(cc) AS hi FROM cc),
cb AS (SELECT nodeid, cc, {_bin('cc', 1000)} AS b, lo, hi FROM cc, cl),
ct AS (SELECT nodeid, cc, {_center('b', 1000)} AS t, CAST(count(*) OVER (PARTITION BY b) AS BIGINT) AS n FROM cb),
comb AS (SELECT deg.nodeid, deg.degree, dc.count, pt.pagerank, round(pt.t, 12) AS pagerank_t, pt.n AS pagerank_t_count,
    round(ct.cc, 9) AS "clusCoeff", round(ct.t, 9) AS "clusCoeff_t", ct.n AS cc_t_count
  FROM deg JOIN dc ON dc.degree = deg.degree JOIN pt ON pt.nodeid = deg.nodeid JOIN ct ON ct.nodeid = deg.nodeid)"""


def _degree(node: str, measure: str) -> str:
    return f"WITH {E} SELECT {node} AS nodeid, {measure} AS degree FROM e GROUP BY {node}"


_SUMMARY = """SELECT j, round(mean, 6) AS mean, round(variance, 6) AS variance, n AS count, nnz,
round(hi, 6) AS max, round(lo, 6) AS min, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM x"""

ORACLES: dict[str, str] = {
    "s1_parse_edges": f"WITH {LINES} SELECT src, dst FROM t WHERE kind NOT IN (0, 4)",
    "s1_rejected_lines": f"WITH {LINES} SELECT concat_ws('  ', s, p, q) AS value, CAST(count(*) AS BIGINT) AS n FROM t WHERE kind = 4 GROUP BY 1",
    "s2_parse_weighted_edges": f"WITH {LINES} SELECT src, dst, weight FROM t WHERE kind NOT IN (0, 4)",
    "s5_tsv_round_trip": f"WITH {E}, {TOTAL} SELECT nodeid, degree FROM deg",
    "s6_csv_round_trip": f"WITH {E}, {TOTAL} SELECT degree, CAST(count(*) AS BIGINT) AS count FROM deg GROUP BY degree",
    "s7_csv_line": f"WITH {E} SELECT concat_ws(',', src, count(*)) AS line FROM e GROUP BY src",
    "s8_unit_weight_edges": f"WITH {E} SELECT src, dst, CAST(1 AS BIGINT) AS weight FROM e",
    "p1_clean_edges": f"WITH {E} SELECT src, dst, weight FROM e",
    "p2_reverse_edges": f"WITH {E} SELECT dst AS src, src AS dst, weight FROM e",
    "p3_simple_edges": f"WITH {E} SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e",
    "p3_symmetric_edges": f"WITH {E} SELECT src, dst FROM e UNION SELECT dst, src FROM e",
    "p7_column_vectors": f"""WITH {M} SELECT j, i // 256 AS chunk,
CAST(row_number() OVER (PARTITION BY j, i // 256 ORDER BY i) - 1 AS INTEGER) AS position, v FROM m""",
    "p8_adjacency_rows": f"""WITH {E}, d AS (SELECT DISTINCT src - 1 AS i, dst - 1 AS j FROM e)
SELECT i, j // 512 AS chunk, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS indices
FROM d GROUP BY 1, 2
UNION ALL SELECT range AS i, CAST(0 AS BIGINT), CAST(0 AS INTEGER), ''
FROM range((SELECT max(src) FROM e)) WHERE range NOT IN (SELECT i FROM d)""",
    "p9_wide_orientation": f"WITH {E} SELECT src, dst, weight FROM e",
    "a1_out_degree": _degree("src", "CAST(count(*) AS BIGINT)"),
    "a2_in_degree": _degree("dst", "CAST(count(*) AS BIGINT)"),
    "a3_total_degree": f"WITH {E}, {TOTAL} SELECT nodeid, degree FROM deg",
    "a4_weighted_out_degree": _degree("src", "sum(weight)"),
    "a5_weighted_in_degree": _degree("dst", "sum(weight)"),
    "a6_weighted_total_degree": f"WITH {E}, {WEIGHTED_TOTAL} SELECT nodeid, degree FROM deg",
    "a7_degree_distribution": f"WITH {E}, {TOTAL} SELECT degree, CAST(count(*) AS BIGINT) AS count FROM deg GROUP BY degree",
    "a9_extremes": f"""WITH {E}, {TOTAL} SELECT min(nodeid) AS min_nodeid, max(nodeid) AS max_nodeid,
min(degree) AS min_degree, max(degree) AS max_degree FROM deg""",
    "a10_largest_ids": f"WITH {E} SELECT min(src) AS min_src, max(src) AS max_src, min(dst) AS min_dst, max(dst) AS max_dst FROM e",
    "b1_degree_histogram": f"WITH {E}, {TOTAL}, {_histogram('deg', 'degree', 100, 9)}",
    "b3_degree_bins": f"""WITH {E}, {TOTAL}, lim AS (SELECT min(degree) AS lo, max(degree) AS hi FROM deg),
x AS (SELECT nodeid, degree, {_bin('degree', 100)} AS b, lo, hi FROM deg, lim)
SELECT nodeid, degree, b AS degree_bin, round({_center('b', 100)}, 9) AS degree_t FROM x""",
    "g1_pagerank": f"WITH {E}, {_ranks()} SELECT nodeid, pagerank FROM ranks",
    "g1_pagerank_node_count": f"WITH {E}, {_ranks(size='count(*)')} SELECT nodeid, pagerank FROM ranks",
    "g2_weighted_pagerank": f"WITH {E}, {_ranks(weighted=True)} SELECT nodeid, pagerank FROM ranks",
    "g3_neighbour_degrees": f"""WITH {E}, {SIMPLE} SELECT u AS nodeid, v AS neighbour, degree AS neighbour_degree FROM s JOIN sd ON nodeid = v
UNION ALL SELECT v, u, degree FROM s JOIN sd ON nodeid = u""",
    "g4_ordered_neighbours": f"""WITH {E}, {ORIENTED}, l AS (SELECT x, string_agg(CAST(y AS VARCHAR), ',' ORDER BY dy, y) AS later FROM o GROUP BY x)
SELECT nodeid, degree, coalesce(later, '') AS later FROM sd LEFT JOIN l ON x = nodeid""",
    "g5_wedge_candidates": f"""WITH {E}, {ORIENTED} SELECT p.x, p.y, CAST(count(*) AS INTEGER) AS n, CAST(sum(q.y) AS BIGINT) AS id_sum
FROM o p JOIN o q ON p.x = q.x AND (p.dy < q.dy OR (p.dy = q.dy AND p.y < q.y)) GROUP BY p.x, p.y""",
    "g6_triangles": f"WITH {E}, {TRIANGLES} SELECT x, y, z FROM tri",
    "g6_triangles_cells": f"WITH {E}, {TRIANGLES} SELECT x, y, z FROM tri",
    "g6_triangle_counts": f"WITH {E}, {TRIANGLES} SELECT nodeid, triangles FROM tc",
    "g6_triangle_counts_cells": f"WITH {E}, {TRIANGLES} SELECT nodeid, triangles FROM tc",
    "g7_local_clustering": f"WITH {E}, {LCC} SELECT nodeid, degree, triangles, round(cc, 9) AS cc FROM cc",
    "g8_average_clustering": f"WITH {E}, {LCC} SELECT round(sum(cc) / max(nodeid), 9) AS avg_cc, round(avg(cc), 9) AS mean_cc FROM cc",
    "g9_ego_nets": f"""WITH {E}, {SIMPLE},
nb AS (SELECT u AS ego, v AS n FROM s UNION ALL SELECT v, u FROM s UNION ALL SELECT nodeid, nodeid FROM sd),
inside AS (SELECT a.ego, count(*) AS c FROM nb a JOIN e ON e.src = a.n JOIN nb b ON b.ego = a.ego AND b.n = e.dst GROUP BY a.ego)
SELECT nodeid, degree + 1 AS ego_size, CAST(c AS BIGINT) AS ego_edges FROM sd JOIN inside ON ego = nodeid""",
    "g10_weighted_degree_vs_count": f"WITH {E}, {WEIGHTED_TOTAL}, {_histogram('deg', 'degree', 1000, 9)}",
    "g11_pagerank_vs_count": f"WITH {E}, {_ranks()}, {_histogram('ranks', 'pagerank', 1000, 12)}",
    "g11_weighted_pagerank_vs_count": f"WITH {E}, {_ranks(weighted=True)}, {_histogram('ranks', 'pagerank', 1000, 12)}",
    "g12_degree_vs_pagerank": f"WITH {E}, {TOTAL}, {_ranks()} SELECT degree, pagerank FROM deg JOIN ranks ON ranks.nodeid = deg.nodeid",
    "g12_weighted_degree_vs_pagerank": f"WITH {E}, {WEIGHTED_TOTAL}, {_ranks(weighted=True)} SELECT degree, pagerank FROM deg JOIN ranks ON ranks.nodeid = deg.nodeid",
    "g14_combined_core": f"WITH {_COMBINED} SELECT * FROM comb",
    "g15_plot_degree_vs_count": f"WITH {_COMBINED} SELECT DISTINCT degree, count FROM comb",
    "g16_plot_degree_vs_pagerank": f"WITH {_COMBINED} SELECT degree, pagerank_t, CAST(count(*) AS BIGINT) AS count FROM comb GROUP BY degree, pagerank_t",
    "g17_plot_pagerank_vs_count": f"WITH {_COMBINED} SELECT DISTINCT pagerank_t, pagerank_t_count FROM comb",
    "g18_plot_all_core": f'WITH {_COMBINED} SELECT DISTINCT degree, count, pagerank_t, pagerank_t_count, "clusCoeff_t", cc_t_count FROM comb',
    "m1_rows_to_coordinates": f"WITH {M} SELECT i, j, v FROM m",
    "m3_dimensions": f"WITH {M} SELECT max(i) + 1 AS n_rows, max(j) + 1 AS n_cols FROM m",
    "m4_column_summary": f"""WITH {M}, x AS (SELECT j, avg(v) AS mean, var_samp(v) AS variance, CAST(count(*) AS BIGINT) AS n,
CAST(count(*) FILTER (v <> 0) AS BIGINT) AS nnz, max(v) AS hi, min(v) AS lo, sum(abs(v)) AS l1, sqrt(sum(v * v)) AS l2 FROM m GROUP BY j) {_SUMMARY}""",
    "m4_coordinate_column_summary": f"""WITH {CELLS},
g AS (SELECT r.range AS i, c.range AS j FROM range((SELECT max(i) + 1 FROM k)) r CROSS JOIN range(53) c),
f AS (SELECT g.j, coalesce(k.v, 0) AS v FROM g LEFT JOIN k ON k.i = g.i AND k.j = g.j),
x AS (SELECT j, avg(v) AS mean, var_samp(v) AS variance, CAST(count(*) AS BIGINT) AS n,
CAST(count(*) FILTER (v <> 0) AS BIGINT) AS nnz, max(v) AS hi, min(v) AS lo, sum(abs(v)) AS l1, sqrt(sum(v * v)) AS l2 FROM f GROUP BY j) {_SUMMARY}""",
    "m5_covariance": f"WITH {M} SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 6) + 0.0::DOUBLE AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j",
    "m5_coordinate_covariance": f"""WITH {CELLS},
g AS (SELECT r.range AS i, c.range AS j FROM range((SELECT max(i) + 1 FROM k)) r CROSS JOIN range(50) c),
f AS (SELECT g.i, g.j, coalesce(k.v, 0) AS v FROM g LEFT JOIN k ON k.i = g.i AND k.j = g.j)
SELECT p.j AS i, q.j AS j, round(covar_samp(p.v, q.v), 4) + 0.0::DOUBLE AS v FROM f p JOIN f q ON p.i = q.i GROUP BY p.j, q.j""",
    "m6_gramian": f"WITH {M} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0::DOUBLE AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j",
    "m6_coordinate_gramian": f"WITH {QUANTITY} SELECT p.j AS i, q.j AS j, round(sum(p.v * q.v), 6) AS v FROM a p JOIN a q ON p.i = q.i GROUP BY p.j, q.j",
    "m7_column_cosines": f"""WITH {M}, n AS (SELECT j, sqrt(sum(v * v)) AS n FROM m GROUP BY j)
SELECT g.i, g.j, round(g.v / (p.n * q.n), 6) + 0.0::DOUBLE AS v
FROM (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i AND a.j < b.j GROUP BY a.j, b.j) g
JOIN n p ON p.j = g.i JOIN n q ON q.j = g.j""",
    "m9_qr_product": f"WITH {M} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM m",
    "m9_qr_square": f"WITH {M} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0::DOUBLE AS v, 0.0::DOUBLE AS below FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j",
    "m9_qr_orthonormal": f"""WITH {M}, c AS (SELECT DISTINCT j FROM m)
SELECT a.j AS i, b.j AS j, CASE WHEN a.j = b.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM c a CROSS JOIN c b""",
    "m10_singular_triplets": f"""WITH {M} SELECT CAST(c.j + 1 AS BIGINT) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, true AS falling,
(SELECT round(sum(v * v), 4) FROM m) AS total FROM (SELECT DISTINCT j FROM m) c""",
    "m11_turned_covariance": f"""WITH {M}, c AS (SELECT DISTINCT j FROM m)
SELECT a.j AS i, b.j AS j, 0.0::DOUBLE AS off, true AS falling FROM c a CROSS JOIN c b""",
    "g13_embedding_values": f"""WITH {E} SELECT CAST(range AS INTEGER) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, true AS falling
FROM range(1, (SELECT least(count(DISTINCT src), 10) + 1 FROM e))""",
    "m10_svd_product": f"WITH {M} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM m",
    "m10_svd_left_gramian": "SELECT a.range AS i, b.range AS j, CASE WHEN a.range = b.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(10) a CROSS JOIN range(10) b",
    "m11_component_variance": f"WITH {M} SELECT round(sum(s), 6) AS variance FROM (SELECT var_samp(v) AS s FROM m GROUP BY j)",
    "m12_multiply_local": f"""WITH {M} SELECT i, c.range AS j, round(sum(v * ((3 * m.j + 5 * c.range) % 7 - 3)), 6) + 0.0::DOUBLE AS v
FROM m CROSS JOIN range(8) c GROUP BY i, c.range""",
    "m13_transpose": f"WITH {M} SELECT j AS i, i AS j, v FROM m",
    "m14_add": f"WITH {QUANTITY}, {TAX} SELECT i, j, round(sum(v), 6) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY i, j",
    "m15_subtract": f"WITH {QUANTITY}, {TAX} SELECT i, j, round(sum(v), 6) AS v FROM (SELECT * FROM a UNION ALL SELECT i, j, -v FROM b) GROUP BY i, j",
    "m16_multiply": f"WITH {QUANTITY}, {TAX} SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 4) AS v FROM a JOIN b ON a.j = b.j GROUP BY a.i, b.i",
    "m16_multiply_repeated": """SELECT a.l_suppkey AS i, CAST(b.l_linenumber AS BIGINT) AS j, round(sum(a.l_quantity * b.l_tax), 4) AS v
FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey GROUP BY 1, 2""",
    "m16_multiply_dense": f"WITH {QUANTITY}, {TAX} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) AS v FROM a JOIN b ON a.i = b.i GROUP BY a.j, b.j",
    "m17_to_blocks": f"""WITH {M} SELECT CAST(i // 128 AS INTEGER) AS bi, CAST(j // 16 AS INTEGER) AS bj,
CAST(i % 128 AS INTEGER) AS r, CAST(j % 16 AS INTEGER) AS c, v FROM m""",
    "m17_dense_blocks_round_trip": f"WITH {M} SELECT i, j, v FROM m",
    "m17_sparse_rows_round_trip": f"WITH {QUANTITY} SELECT i, j, v FROM a",
    "m17_blocks_repeated": f"WITH {CELLS} SELECT i, j, round(v, 6) AS v FROM k",
    "m17_dense_rows": f"""WITH {CELLS}
SELECT r.i, c.range AS j, coalesce(k.v, 0) AS v FROM (SELECT DISTINCT i FROM k) r CROSS JOIN range(50) c
LEFT JOIN k ON k.i = r.i AND k.j = c.range""",
    "m18_block_violations": f"""WITH {M}, b AS (SELECT DISTINCT CAST(i // 100 AS INTEGER) AS bi, CAST(j // 24 AS INTEGER) AS bj FROM m)
SELECT bi, bj, 'duplicate block' AS problem FROM b WHERE bi = 1 AND bj = 0
UNION ALL SELECT CAST(1000000 AS INTEGER), bj, 'outside the matrix' FROM b WHERE bi = 0
UNION ALL SELECT bi, bj, 'wrong block size' FROM b WHERE bi = 2 AND bj = 1""",
    "m21_drop_zeros": f"WITH {M} SELECT i, j, v FROM m WHERE abs(v) >= 0.05::DOUBLE",
    "m21_fill_zeros": f"""WITH {CELLS}
SELECT r.range AS i, c.range AS j, coalesce(k.v, 0) AS v FROM range((SELECT max(i) + 1 FROM k)) r CROSS JOIN range(50) c
LEFT JOIN k ON k.i = r.range AND k.j = c.range""",
    "v1_dot": f"WITH {PAIRS} SELECT vec_id, round(sum(a * b), 6) + 0.0::DOUBLE AS v FROM pr GROUP BY vec_id",
    "v1_sparse_dot": f"WITH {PAIRS} SELECT vec_id, round(sum(ta * tb), 6) + 0.0::DOUBLE AS sparse, round(sum(ta * b), 6) + 0.0::DOUBLE AS mixed FROM pr GROUP BY vec_id",
    "v2_norms": f"""WITH {THIN} SELECT vec_id, round(sum(abs(v)), 6) AS l1, round(sqrt(sum(v * v)), 6) AS l2,
round(pow(sum(pow(abs(v), 3)), 1.0::DOUBLE / 3), 6) AS l3, round(max(abs(v)), 6) AS largest FROM th GROUP BY vec_id""",
    "v3_squared_distance": f"""WITH {PAIRS} SELECT vec_id, round(sum((a - b) * (a - b)), 6) AS dense, round(sum((ta - tb) * (ta - tb)), 6) AS sparse,
round(sum((ta - b) * (ta - b)), 6) AS mixed FROM pr GROUP BY vec_id""",
    "v4_nonzeros": f"WITH {THIN} SELECT vec_id, CAST(count(*) FILTER (t <> 0) AS BIGINT) AS n FROM th GROUP BY vec_id",
    "v5_elementwise": f"""WITH {PAIRS} SELECT vec_id, position, round(a + b, 6) + 0.0::DOUBLE AS plus, round(a - b, 6) + 0.0::DOUBLE AS minus, round(a * b, 6) + 0.0::DOUBLE AS times,
round(a / nullif(b, 0), 3) + 0.0::DOUBLE AS over, round(2.0::DOUBLE - a, 6) + 0.0::DOUBLE AS from_two, round(-a, 6) + 0.0::DOUBLE AS negated
FROM pr""",
    "v5_remainder": f"WITH {THIN}, w AS (SELECT vec_id, position, CAST(floor(v * 1000) AS BIGINT) AS w FROM th) SELECT vec_id, position, CAST(((w % 7) + 7) % 7 AS DOUBLE) AS v FROM w",
    "v6_element": """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[6] AS DOUBLE) AS sixth,
CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings""",
    "v7_sparse_round_trip": f"""WITH {THIN} SELECT vec_id, CAST(count(*) FILTER (t <> 0) OVER (PARTITION BY vec_id) AS INTEGER) AS stored, position, t AS v FROM th""",
    "v7_sparse_from_map": """SELECT vec_id, CAST(64 AS INTEGER) AS size, CAST(0 AS INTEGER) AS position, CAST(3 AS INTEGER) AS at, CAST(embedding[2] AS DOUBLE) AS v FROM embeddings
UNION ALL SELECT vec_id, 64, 1, 40, CAST(embedding[1] AS DOUBLE) FROM embeddings""",
    "v8_same_vector": f"WITH {PAIRS} SELECT vec_id, true AS itself, bool_and(ta = tb) AS next FROM pr GROUP BY vec_id",
    "v9_text_round_trip": f"WITH {THIN} SELECT vec_id, position, v AS dense, t AS sparse FROM th",
    "v9_text": f"""WITH {THIN} SELECT vec_id, '[' || string_agg(CAST(CAST(CAST(floor(v * 1000) AS BIGINT) AS DOUBLE) AS VARCHAR), ',' ORDER BY position) || ']' AS text
FROM th GROUP BY vec_id""",
    "v10_vector_columns": f"WITH {THIN} SELECT vec_id, position, v FROM th",
}


def _bin_of(column: str) -> str:
    return f"""lim_{column} AS (SELECT min({column}) AS lo, max({column}) AS hi FROM lineitem),
bin_{column} AS (SELECT DISTINCT {column}, {_bin(column, 64)} AS b, lo, hi FROM lineitem, lim_{column}),
t_{column} AS (SELECT {column}, b AS {column}_bin, round({_center('b', 64)}, 6) AS {column}_t FROM bin_{column})"""


ORACLES["b3_value_bins"] = f"""WITH {_bin_of('l_extendedprice')}, {_bin_of('l_discount')}
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_extendedprice_bin, l_discount_bin, l_extendedprice_t, l_discount_t
FROM lineitem JOIN t_l_extendedprice USING (l_extendedprice) JOIN t_l_discount USING (l_discount)"""

ORACLES["m8_zero_threshold_cosines"] = ORACLES["m7_column_cosines"]
ORACLES["g13_embedding_gramian"] = ORACLES["m10_svd_left_gramian"]
ORACLES["g13_embedding_krylov"] = ORACLES["g13_embedding_values"]


def _quantities(row: str, column: str, source: str = "lineitem") -> str:
    """``a``: the summed quantities by two columns, and ``c``: the matrix columns up to the largest."""
    return f"""a AS MATERIALIZED (SELECT CAST({row} AS BIGINT) AS i, CAST({column} AS BIGINT) AS j, sum(l_quantity) AS v FROM {source} GROUP BY ALL),
c AS MATERIALIZED (SELECT n.range AS j, coalesce(sum(v), 0) AS total, coalesce(sqrt(sum(v * v)), 0) AS norm
  FROM range((SELECT max(j) + 1 FROM a)) n LEFT JOIN a ON a.j = n.range GROUP BY n.range),
g AS (SELECT p.j AS i, q.j AS j, sum(p.v * q.v) AS v FROM a p JOIN a q ON p.i = q.i AND p.j <= q.j GROUP BY p.j, q.j)"""


_NATIONS = _quantities("s_nationkey", "l_orderkey", "lineitem JOIN supplier ON l_suppkey = s_suppkey")

ORACLES |= {
    "m5_wide_covariance": f"""WITH {_quantities("l_suppkey", "l_partkey")},
held AS (SELECT CAST(count(DISTINCT i) AS DOUBLE) AS n FROM a),
v AS (SELECT p.j AS i, (coalesce(g.v, 0) - p.total * q.total / held.n) / (held.n - 1) AS v
  FROM c p JOIN c q ON p.j <= q.j CROSS JOIN held LEFT JOIN g ON g.i = p.j AND g.j = q.j)
SELECT i, round(sum(v), 3) + 0.0::DOUBLE AS total, round(sum(v * v), 3) AS squares FROM v GROUP BY i""",
    "m6_wide_gramian": f"""WITH {_quantities("l_suppkey", "l_orderkey")}
SELECT c.j AS i, coalesce(round(sum(g.v), 3), 0.0::DOUBLE) AS total, coalesce(round(sum(g.v * g.v), 3), 0.0::DOUBLE) AS squares
FROM c LEFT JOIN g ON g.i = c.j GROUP BY c.j""",
    "m7_wide_cosines": f"""WITH {_quantities("l_suppkey", "l_partkey")},
v AS (SELECT g.i, CASE WHEN p.norm * q.norm = 0 THEN 0 ELSE g.v / (p.norm * q.norm) END AS v FROM g JOIN c p ON p.j = g.i JOIN c q ON q.j = g.j)
SELECT c.j AS i, coalesce(round(sum(v), 6), 0.0::DOUBLE) AS total, coalesce(round(sum(v * v), 6), 0.0::DOUBLE) AS squares FROM c LEFT JOIN v ON v.i = c.j GROUP BY c.j""",
    "m8_sampled_column_cosines": f"""WITH {_quantities("l_orderkey", "l_linenumber")}
SELECT g.i, g.j, round(g.v / (p.norm * q.norm), 6) AS v, true AS within
FROM g JOIN c p ON p.j = g.i JOIN c q ON q.j = g.j WHERE g.i < g.j AND g.v / (p.norm * q.norm) >= 0.1""",
    "m8_sampled_share": f"""WITH {_quantities("l_orderkey", "l_linenumber")}
SELECT j, count(*) AS entries, round(count(*) * least(1.0::DOUBLE, sqrt(10 * ln((SELECT max(j) + 1 FROM a)) / 0.1::DOUBLE) / (sqrt(sum(v * v)) / max(v))), 6) AS expected,
  true AS as_expected FROM a GROUP BY j""",
    "m9_qr_dependent": f"""WITH {M}, c AS (SELECT unnest(range(count(DISTINCT j) + 3)) AS j, count(DISTINCT j) + 3 AS n FROM m)
SELECT a.j AS i, b.j AS j, CASE WHEN a.j = b.j AND a.j NOT IN (a.n - 4, a.n - 3, a.n - 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM c a CROSS JOIN c b""",
    "m9_qr_dependent_product": f"""WITH {M} SELECT unnest(range(count(DISTINCT j) + 3)) AS j, 0.0::DOUBLE AS off, 0.0::DOUBLE AS below FROM m""",
    "m10_wide_triplets": f"""WITH {_NATIONS}, r AS (SELECT count(DISTINCT i) AS n, round(sum(v * v), 4) AS total FROM a)
SELECT CAST(unnest(range(1, n + 1)) AS BIGINT) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS left_length, 1.0::DOUBLE AS right_length, true AS falling, total FROM r""",
    "m10_wide_leading": f"""WITH {_quantities("l_suppkey", "l_orderkey")}, r AS (SELECT least(count(DISTINCT i), 10) AS n FROM a)
SELECT CAST(unnest(range(1, n + 1)) AS BIGINT) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS left_length, 1.0::DOUBLE AS right_length, true AS falling FROM r""",
    "m11_wide_components": f"""WITH {_NATIONS}, r AS (SELECT count(DISTINCT i) AS n FROM a),
t AS (SELECT round(sum(squares - total * total / n) / (any_value(n) - 1), 4) AS total FROM (SELECT j, sum(v * v) AS squares, sum(v) AS total FROM a GROUP BY j) CROSS JOIN r),
k AS (SELECT unnest(range(n - 1)) AS j FROM r)
SELECT p.j AS i, q.j AS j, 0.0::DOUBLE AS off, true AS falling, total FROM k p CROSS JOIN k q CROSS JOIN t""",
}

ORACLES |= {
    "s1_read_edge_file": ORACLES["s1_parse_edges"],
    "s2_read_weighted_edge_file": ORACLES["s2_parse_weighted_edges"],
    "g19_report_by_flags": f"""WITH {E}, {TOTAL} SELECT nodeid AS a, degree AS b, 'total_degree' AS part FROM deg
UNION ALL SELECT degree, CAST(count(*) AS BIGINT), 'degree_vs_count' FROM deg GROUP BY degree""",
    "m5_coordinate_wide_covariance": ORACLES["m5_wide_covariance"].replace("(SELECT CAST(count(DISTINCT i) AS DOUBLE) AS n FROM a)", "(SELECT CAST(max(i) + 1 AS DOUBLE) AS n FROM a)"),
    "m19_persist_levels": f"""WITH {_quantities("l_suppkey", "l_partkey")} SELECT level, count(*) AS n, sum(v) AS total, true AS same
FROM a CROSS JOIN (SELECT unnest(['MEMORY_ONLY', 'MEMORY_AND_DISK', 'DISK_ONLY']) AS level) GROUP BY level""",
    "m20_to_local": f"""WITH {QUANTITY}
SELECT r.range AS i, c.range AS j, coalesce(a.v, 0) AS v FROM range((SELECT max(i) + 1 FROM a)) r CROSS JOIN range(50) c LEFT JOIN a ON a.i = r.range AND a.j = c.range""",
}

ORACLES["g13_all_components"] = f"""WITH {E}, n AS (SELECT count(DISTINCT (src, dst)) AS pairs, least(count(DISTINCT src), count(DISTINCT dst)) AS rank FROM e)
SELECT CAST(unnest(range(1, rank + 1)) AS BIGINT) AS component, 0.0::DOUBLE AS off, 1.0::DOUBLE AS length, true AS falling, round(CAST(pairs AS DOUBLE), 4) AS total FROM n"""
