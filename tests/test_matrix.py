import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.functions import vectors as V
from nodeloom.operators import adjacency, blocks, coo, embedding, factor, lanczos, leading, rotations, rowmatrix, squares
from nodeloom.plans import catalog


def rows_of(spark, *rows):
    data = [(n, [float(x) for x in r]) for n, r in enumerate(rows)]
    return spark.createDataFrame(data, "i bigint, row array<double>")


def entries(spark, *cells):
    return spark.createDataFrame([(i, j, float(v)) for i, j, v in cells], "i bigint, j bigint, v double")


def cells(df):
    return {(r.i, r.j): r.v for r in df.collect()}


def dense(df, m, n):
    return coo.to_local(df, coo.Shape(m, n))


def test_dimensions(spark):
    four = rows_of(spark, [1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12])
    assert rowmatrix.shape(four) == (4, 3)
    assert rowmatrix.shape(four, n_rows=7, n_cols=6) == (7, 6)
    gap = spark.createDataFrame([(0, [1.0, 0.0]), (6, [0.0, 5.0])], "i bigint, row array<double>")
    assert rowmatrix.shape(gap, index="i") == (7, 2)
    assert coo.shape(entries(spark, (0, 0, 1.2), (6, 4, 2.1))) == (7, 5)
    assert coo.shape(entries(spark, (0, 0, 1.2), (6, 4, 2.1)), rows=9) == (9, 5)
    assert blocks.block_counts(coo.Shape(7, 5), 3, 2) == (3, 3)


def test_indexed_rows_keep_explicit_zeros(spark):
    gap = spark.createDataFrame([(0, [1.0, 0.0]), (6, [0.0, 5.0])], "i bigint, row array<double>")
    assert cells(coo.from_rows(gap)) == {(0, 0): 1.0, (0, 1): 0.0, (6, 0): 0.0, (6, 1): 5.0}
    assert cells(coo.drop_zeros(coo.from_rows(gap))) == {(0, 0): 1.0, (6, 1): 5.0}


def test_summary_covariance_gramian_cosines(spark):
    m = rows_of(spark, [1, 2, 3], [4, 5, 6])
    assert [r["mean"] for r in rowmatrix.column_summary(m).orderBy("j").collect()] == [2.5, 3.5, 4.5]
    assert dense(rowmatrix.covariance(rows_of(spark, [1, 2], [2, 1])), 2, 2).ravel().tolist() == [0.5, -0.5, -0.5, 0.5]
    want = [17, 22, 27, 22, 29, 36, 27, 36, 45]
    assert dense(rowmatrix.gramian(m), 3, 3).ravel().tolist() == want
    assert dense(coo.gramian(coo.from_rows(m)), 3, 3).ravel().tolist() == want
    cosines = coo.column_cosines(rowmatrix.gramian(rows_of(spark, [1, 2], [1, 5])))
    assert cells(cosines) == pytest.approx({(0, 1): 0.91914503})
    assert cells(coo.column_cosines(rowmatrix.gramian(rows_of(spark, [0, 2], [0, 5])))) == {(0, 1): 0.0}


def test_coordinate_summary_counts_absent_positions(spark):
    a = np.array([[0, 2.0, 0], [1, -3, 0], [0, 4, 5], [0, 1, 0]])
    stored = entries(spark, *[(i, j, a[i, j]) for i in range(4) for j in range(3) if a[i, j]])
    got = coo.column_summary(stored, coo.Shape(4, 3)).orderBy("j").collect()
    assert [r["mean"] for r in got] == pytest.approx(a.mean(0).tolist())
    assert [r["variance"] for r in got] == pytest.approx(a.var(0, ddof=1).tolist())
    assert [r["max"] for r in got] == a.max(0).tolist() and [r["min"] for r in got] == a.min(0).tolist()
    assert np.allclose(dense(coo.covariance(stored, coo.Shape(4, 3)), 3, 3), np.cov(a.T))


def test_ragged_rows_are_an_error(spark):
    with pytest.raises(Exception):
        rowmatrix.gramian(rows_of(spark, [1, 2], [1, 2, 3]), n_cols=2).collect()


def test_qr_svd_pca(spark):
    m = rows_of(spark, [3, -6], [4, -8], [0, 1])
    q, r = factor.qr(m, compute_q=True)
    assert np.allclose(np.abs(r), [[5, 10], [0, 1]]) and r[0, 0] > 0
    got = {x.i: x.row for x in q.collect()}
    assert np.allclose(np.abs([got[0], got[1], got[2]]), [[0.6, 0], [0.8, 0], [0, 1]])
    a = np.array([[3.0, 1, 1], [-1, 3, 1]])
    found = factor.svd(rows_of(spark, *a), 2, compute_u=True)
    assert np.allclose(found.s, [3.4641, 3.1623], atol=1e-4)
    assert np.allclose(np.abs(found.v), np.abs([[-0.4082, 0.8944], [-0.8165, -0.4472], [-0.4082, 0]]), atol=1e-4)
    u = np.array([x.row for x in sorted(found.u.collect(), key=lambda x: x.i)])
    assert np.allclose(u * found.s @ found.v.T, a)
    assert len(factor.svd(rows_of(spark, [1, 1], [2, 2]), 2).s) == 1
    pc = factor.principal_components(rows_of(spark, [1, 2, 3], [2, 4, 5], [3, 6, 1]), 2).vectors
    assert np.allclose(np.abs(pc), np.abs([[-0.349, -0.2796], [-0.6981, -0.5592], [0.6252, -0.7805]]), atol=1e-4)


def test_sampled_cosines_agree_where_they_are_large(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 4))
    m = rows_of(spark, *np.column_stack([base, base[:, 0] + 0.01 * r.normal(size=300)]))
    exact = cells(coo.column_cosines(rowmatrix.gramian(m)))
    sampled = cells(factor.similar_columns(m, 0.1))
    assert sampled[(0, 4)] == pytest.approx(exact[(0, 4)], rel=0.2)


def test_multiply_local(spark):
    product = rowmatrix.multiply_local(rows_of(spark, [0, 1], [2, 3]), np.array([[0.0, 1.0], [2.0, 3.0]]))
    assert [r.row for r in product.orderBy("i").collect()] == [[2, 3], [6, 11]]
    with pytest.raises(TypeError):
        rowmatrix.multiply_local(product, [[1.0]])


def test_transpose_add_subtract(spark):
    a = entries(spark, (0, 0, 1.2), (1, 0, 2), (2, 1, 3.7))
    assert coo.shape(coo.transpose(a)) == (2, 3)
    assert cells(coo.add(a, a)) == {(0, 0): 2.4, (1, 0): 4.0, (2, 1): 7.4}
    assert set(cells(coo.subtract(a, a)).values()) == {0.0}
    with pytest.raises(ValueError):
        coo.add(a, a, coo.Shape(3, 2), coo.Shape(2, 3))
    with pytest.raises(ValueError):
        coo.multiply(a, a, coo.Shape(3, 2), coo.Shape(3, 2))


@pytest.mark.parametrize("tiles", [64, 1])
def test_products_against_numpy(spark, monkeypatch, tiles):
    monkeypatch.setattr(coo, "TILES_PER_PART", tiles)
    r = np.random.default_rng(7)
    a = r.integers(-3, 4, (70, 90)) * (r.random((70, 90)) < 0.1)
    b = r.integers(-3, 4, (90, 40)) * (r.random((90, 40)) < 0.1)
    b[33] = 1

    def stored(x):
        return entries(spark, *[(int(i), int(j), x[i, j]) for i, j in zip(*np.nonzero(x))])

    product = cells(coo.multiply(stored(a), stored(b)))
    support = (a != 0).astype(int) @ (b != 0).astype(int)
    assert set(product) == {(i, j) for i, j in zip(*np.nonzero(support))}
    assert all(v == (a @ b)[k] for k, v in product.items())
    assert np.allclose(dense(blocks.multiply_dense(stored(a), stored(b), 40, 16, hot_rows=tiles), 70, 40), a @ b)
    assert np.array_equal(dense(coo.gramian(stored(a)), 90, 90), a.T @ a)


def test_coordinate_svd(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(12, 9)) * (r.random((12, 9)) < 0.6)
    for x in (a, a.T):
        stored = entries(spark, *[(int(i), int(j), x[i, j]) for i, j in zip(*np.nonzero(x))])
        for side in (4096, 0):
            s, v = embedding.right_vectors(stored, coo.Shape(*x.shape), 3, side)
            assert np.allclose(s, np.linalg.svd(x)[1][:3], atol=1e-8)
            got = np.array([t.v for t in sorted(v.collect(), key=lambda t: t.j)])
            want = np.linalg.svd(x)[2][:3].T
            assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_blocks(spark):
    a = entries(spark, *[(i, j, 10 * i + j) for i in range(7) for j in range(5)])
    dims = coo.Shape(7, 5)
    assert cells(blocks.from_blocks(blocks.to_blocks(a, 3, 2), 3, 2)) == cells(a)
    full = blocks.to_dense_blocks(a, dims, 3, 2)
    first = full.where("bi = 0 and bj = 1").first()
    assert (first.n_rows, first.n_cols, first.cells) == (3, 2, [2, 12, 22, 3, 13, 23])
    assert cells(blocks.from_dense_blocks(full, 3, 2)) == cells(a)
    blocks.validate(full, dims, 3, 2)
    with pytest.raises(ValueError, match="duplicate"):
        blocks.validate(full.unionByName(full.where("bi = 0 and bj = 0")), dims, 3, 2)
    with pytest.raises(ValueError, match="outside"):
        blocks.validate(full, coo.Shape(7, 4), 3, 2)
    with pytest.raises(ValueError, match="size"):
        blocks.validate(full, coo.Shape(7, 5), 3, 3)
    assert blocks.to_dense_blocks(entries(spark, (0, 4, 2.0)), dims, 3, 2).first().cells == [2.0, 0.0, 0.0]


def test_block_arithmetic_of_fixed_values(spark):
    schema = "bi int, bj int, n_rows int, n_cols int, cells array<double>"

    def made(n_rows, n_cols, *parts):
        rows = [(bi, bj, n_rows, n_cols, [float(x) for x in range(start, start + n_rows * n_cols)]) for bi, bj, start in parts]
        return blocks.from_dense_blocks(spark.createDataFrame(rows, schema), n_rows, n_cols)

    tall = made(3, 2, (0, 0, 1), (1, 0, 7))
    wide = made(2, 3, (0, 0, 1), (0, 1, 7))
    doubled = dense(coo.add(tall, tall), 6, 2).ravel(order="F").tolist()
    assert doubled == [2, 4, 6, 14, 16, 18, 8, 10, 12, 20, 22, 24]
    turned = dense(coo.transpose(tall), 2, 6).ravel(order="F").tolist()
    assert turned == [1, 4, 2, 5, 3, 6, 7, 10, 8, 11, 9, 12]
    assert dense(coo.multiply(wide, tall), 2, 2).ravel(order="F").tolist() == [242, 272, 350, 398]
    assert np.allclose(dense(blocks.multiply_dense(wide, tall, 2), 2, 2).ravel(order="F"), [242, 272, 350, 398])


def test_sparse_rows_and_grids(spark):
    a = entries(spark, (0, 0, 1.2), (6, 4, 2.1), (6, 1, 0.0))
    rows = {r.i: (r.row.size, r.row.indices, r.row["values"]) for r in coo.to_sparse_rows(a, 5).collect()}
    assert rows == {0: (5, [0], [1.2]), 6: (5, [1, 4], [0.0, 2.1])}
    assert cells(coo.from_sparse_rows(coo.to_sparse_rows(a, 5))) == cells(a)
    full = {r.i: r.row for r in coo.to_dense_rows(a, 5).collect()}
    assert full == {0: [1.2, 0, 0, 0, 0], 6: [0, 0, 0, 0, 2.1]}
    assert coo.fill_zeros(a, coo.Shape(7, 5)).count() == 35
    assert {r.i: r.row.size for r in coo.to_sparse_rows(a, 70_000).collect()} == {0: 70_000, 6: 70_000}
    with pytest.raises(ValueError):
        coo.to_sparse_rows(a, coo.MAX_ARRAY + 1)
    with pytest.raises(ValueError):
        coo.to_local(a, coo.Shape(10**4, 10**4))


def test_column_vectors_and_adjacency_chunks(spark, sample, graph):
    m = rows_of(spark, [1, 2], [3, 4], [5, 6])
    assert {(r.j, r.chunk): r["cells"] for r in adjacency.column_vectors(m, chunk=2).collect()} == {
        (0, 0): [1, 3], (0, 1): [5], (1, 0): [2, 4], (1, 1): [6],
    }
    rows = {(r.i, r.chunk): r.indices for r in adjacency.adjacency_rows(sample, pad=True).collect()}
    assert rows == {(0, 0): [], (1, 0): [0, 2, 4, 5], (2, 0): [0, 3, 5], (3, 0): [1], (4, 0): [2]}
    cut = adjacency.adjacency_rows(graph([(1, 2), (1, 2), (1, 9)]), chunk=4)
    assert {(r.i, r.chunk): r.indices for r in cut.collect()} == {(0, 0): [1], (0, 2): [8]}


def one(spark, column, **arrays):
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<double>" for k in arrays))
    return df.select(column.alias("x")).first().x


def test_dense_vectors(spark):
    from pyspark.sql import functions as F

    u, v = F.col("u"), F.col("v")
    both = {"u": [3.0, 4.0], "v": [1.0, 2.0]}
    assert one(spark, V.elementwise(v, u, lambda x, y: x + y), **both) == [4, 6]
    assert one(spark, V.scale_by(v, lambda x: F.lit(2.0) - x), **both) == [1, 0]
    assert one(spark, V.scale_by(v, lambda x: x / 2), **both) == [0.5, 1]
    assert one(spark, V.elementwise(v, u, lambda x, y: x * y), **both) == [3, 8]
    assert one(spark, V.elementwise(u, v, lambda x, y: x / y), **both) == [3, 2]
    assert one(spark, V.scale_by(u, lambda x: V.remainder(x, F.lit(2.0))), **both) == [1, 0]
    assert one(spark, V.dot(v, v), **both) == 5
    assert one(spark, V.squared_distance(v, u), u=[2.0, 1.0], v=[1.0, 2.0]) == 2
    w = {"v": [0.0, -1.0, 2.0, -3.0]}
    assert one(spark, V.norm(v, 2), **w) == pytest.approx(3.7416573)
    assert one(spark, V.norm(v, 1), **w) == 6 and one(spark, V.norm(v, float("inf")), **w) == 3
    assert one(spark, V.nonzeros(v), **w) == 3
    assert one(spark, V.element(v, -1), **w) == -3 and one(spark, V.element(v, 2), **w) == 2
    for index in (4, -5):
        with pytest.raises(Exception, match="out of range"):
            one(spark, V.element(v, index), **w)
    with pytest.raises(Exception, match="differ in size"):
        one(spark, V.dot(u, v), u=[1.0], v=[1.0, 2.0])


def test_sparse_vectors(spark):
    df = spark.createDataFrame(
        [((4, [1, 3], [3.0, 4.0]), (4, [0, 1], [2.0, 1.0]), (4, [1, 2, 3], [3.0, 0.0, 4.0]), [1.0, 2.0, 3.0, 4.0])],
        f"a {V.SPARSE}, b {V.SPARSE}, c {V.SPARSE}, d array<double>",
    )
    a, b, c, d = (df[n] for n in "abcd")

    def value(column):
        return df.select(column.alias("x")).first().x

    assert value(V.sparse_dot(a, a)) == 25 and value(V.sparse_dot(a, b)) == 3
    assert value(V.mixed_dot(a, d)) == 22
    assert value(V.sparse_squared_distance(a, b)) == 4 + 4 + 16
    assert value(V.mixed_squared_distance(a, d)) == 1 + 1 + 9 + 0
    assert value(V.to_dense(a)) == [0, 3, 0, 4]
    assert value(V.same_vector(a, c)) and not value(V.same_vector(a, b))
    assert value(V.same_vector(V.to_sparse(V.to_dense(c)), a))
    assert value(V.format_sparse(a)) == "(4,[1,3],[3.0,4.0])"


def test_sparse_construction_and_text(spark):
    from pyspark.sql import functions as F

    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    def built(*indices):
        return V.to_dense(V.sparse(F.lit(4), F.array(*[F.lit(i) for i in indices]), F.array(F.lit(4.0), F.lit(5.0))))

    assert value(built(0, 1)) == [4, 5, 0, 0]
    for bad in ((1, 0), (1, 1), (0, 4)):
        with pytest.raises(Exception, match="rise strictly"):
            value(built(*bad))
    assert value(V.to_dense(V.sparse_from_map(F.lit(3), F.create_map(F.lit(2), F.lit(1.5), F.lit(0), F.lit(2.5))))) == [2.5, 0, 1.5]
    assert value(V.zeros(3)) == [0, 0, 0]
    assert value(V.parse_dense(F.lit("[ 0.0,1.0,2.0,  3.0]"))) == [0, 1, 2, 3]
    assert value(V.parse_dense(F.lit("[]"))) == []
    assert value(V.to_dense(V.parse_sparse(F.lit("(4, [0,1 ],[ 4.0,5.0] )")))) == [4, 5, 0, 0]
    assert value(V.to_dense(V.parse_sparse(F.lit("(2,[],[])")))) == [0, 0]
    for bad in ("1,2", "[1,x]"):
        with pytest.raises(Exception):
            value(V.parse_dense(F.lit(bad)))
    with pytest.raises(Exception):
        value(V.parse_sparse(F.lit("(4,[0,1],[1.0])")))


def test_repeated_positions_add_up_in_products(spark):
    twice = entries(spark, (0, 0, 1), (0, 0, 2), (1, 0, 4))
    assert cells(coo.multiply(twice, entries(spark, (0, 0, 10), (0, 1, 1), (0, 1, 1)))) == {(0, 0): 30, (0, 1): 6, (1, 0): 40, (1, 1): 8}


def test_repeated_positions_add_up(spark):
    m = entries(spark, (0, 0, 1), (0, 0, 2), (1, 1, 4), (0, 1, 5), (0, 1, -1))
    want = [[3.0, 4.0], [0.0, 4.0]]
    assert {r.i: r.row for r in coo.to_dense_rows(m, 2).collect()} == dict(enumerate(want))
    block = blocks.to_dense_blocks(m, coo.Shape(2, 2), 2, 2).collect()
    assert [list(b.cells) for b in block] == [[3.0, 0.0, 4.0, 4.0]]
    ten = entries(spark, (0, 0, 10), (1, 0, 1))
    assert cells(coo.multiply(m, ten)) == {(0, 0): 34.0, (1, 0): 4.0}
    assert cells(blocks.multiply_dense(ten.selectExpr("j i", "i j", "v"), m, 2)) == {(0, 0): 30.0, (0, 1): 44.0}
    assert cells(coo.fill_zeros(m, coo.Shape(2, 2))) == {(0, 0): 3.0, (0, 1): 4.0, (1, 0): 0.0, (1, 1): 4.0}


def test_summary_has_columns_without_entries(spark):
    got = {r.j: r for r in coo.column_summary(entries(spark, (0, 1, 2), (0, 1, 2)), coo.Shape(2, 3)).collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[0]["mean"], got[0]["variance"], got[0]["count"], got[0]["nnz"], got[0]["max"]) == (0.0, 0.0, 2, 0, 0.0)
    assert (got[1]["mean"], got[1]["variance"], got[1]["nnz"], got[1]["max"], got[1]["min"]) == (2.0, 8.0, 1, 4.0, 0.0)


def test_null_vectors_give_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], None, None)], "a array<double>, b array<double>, t string")
    a, b = F.col("a"), F.col("b")
    sa, sb = V.to_sparse(a), V.to_sparse(b)
    values = [
        V.dot(a, b), V.sparse_dot(sa, sb), V.mixed_dot(sa, b), V.mixed_dot(sb, a), V.squared_distance(a, b),
        V.sparse_squared_distance(sb, sa), V.mixed_squared_distance(sb, a), V.element(b, 0), sb, V.to_dense(sb),
        V.parse_dense(F.col("t")), V.parse_sparse(F.col("t")), V.format_dense(b), V.nonzeros(b), V.norm(b, 2),
    ]
    assert list(df.select(*[v.alias(f"c{n}") for n, v in enumerate(values)]).first()) == [None] * len(values)


def test_relative_condition_is_honoured(spark):
    m = rows_of(spark, [1, 0], [0, 0.01])
    assert len(factor.svd(m, 2).s) == 2
    assert len(factor.svd(m, 2, r_cond=0.1).s) == 1


def test_lanczos_states_its_residual_when_rounds_end(spark):
    m = entries(spark, *[(i, j, ((i * i * 7 + j * 3 + i * j) % 11) - 4) for i in range(30) for j in range(25)])
    with pytest.warns(UserWarning, match="relative residual"):
        found = lanczos.block_lanczos(m, 4, block=4, tolerance=0.0, max_rounds=2)
    assert found.vectors.count() == 25 and len(found.values) == 4


def test_lanczos_over_several_stripes_and_restarts(spark, monkeypatch):
    """Stripes of 16 places, pieces of 20 entries, and a basis that starts again from its best vectors."""
    monkeypatch.setattr(lanczos, "STRIPE", 16)
    rng = np.random.default_rng(8)
    a = rng.integers(1, 5, (90, 70)) * (rng.random((90, 70)) < 0.3)
    a[:, 40] = 0
    m = entries(spark, *[(int(i), int(j), a[i, j]) for i, j in zip(*np.nonzero(a))])
    want = np.linalg.svd(a.astype(float))
    for most in (500, 20):
        found = lanczos.block_lanczos(m, 3, block=5, max_width=most, piece_entries=20)
        assert np.sqrt(found.values) == pytest.approx(want[1][:3], rel=1e-9)
        got = np.zeros((70, 3))
        for r in found.vectors.collect():
            got[r.j] = r.v
        assert np.abs(np.sum(got * want[2][:3].T, axis=0)) == pytest.approx(np.ones(3), abs=1e-8)
    none = lanczos.block_lanczos(entries(spark, (0, 0, 0.0), (3, 2, 0.0)), 2)
    assert len(none.values) == 0


def test_bands_cover_the_triangle(spark, monkeypatch):
    monkeypatch.setattr(rowmatrix, "PIECE", 7)
    a = np.random.default_rng(1).standard_normal((40, 23)).round(2)
    rows = rows_of(spark, *a).repartition(3)
    for cells in (1, 60, 200, 10_000):
        found = rowmatrix.square_of_rows(rows, band_cells=cells)
        assert rowmatrix.local_square(found, 23) == pytest.approx(a.T @ a, abs=1e-9)
        assert max(len(r.part) for r in found.collect()) <= 7
        got = rowmatrix.covariance_upper(rows, band_cells=cells)
        assert rowmatrix.local_square(got, 23) == pytest.approx(np.cov(a.T), abs=1e-9)
    bands = rowmatrix.bands(65_535)
    assert bands[0][0] == 0 and bands[-1][1] == 65_535 and all(x[1] == y[0] for x, y in zip(bands, bands[1:]))
    assert max((stop - first) * (65_535 - first) for first, stop in bands) <= rowmatrix.BAND_CELLS


def test_wide_rows_need_no_square(spark):
    """5,000 columns, more than a square on the driver may have."""
    a = np.random.default_rng(2).standard_normal((30, 5_000))
    rows = rows_of(spark, *a).repartition(2)
    found = factor.svd(rows, 6, compute_u=True)
    s = np.linalg.svd(a, compute_uv=False)
    assert found.s == pytest.approx(s[:6], rel=1e-9)
    u = np.array([r.row for r in found.u.orderBy("i").collect()])
    assert u.T @ u == pytest.approx(np.eye(6), abs=1e-8) and (a @ found.v) == pytest.approx(u * found.s, abs=1e-7)
    parts = factor.principal_components(rows, 4)
    values, vectors = np.linalg.svd(a - a.mean(0), full_matrices=False)[1:]
    assert parts.explained == pytest.approx(values[:4] ** 2 / (values**2).sum(), rel=1e-9)
    assert np.abs(parts.vectors.T @ vectors[:4].T) == pytest.approx(np.eye(4), abs=1e-7)
    some = rowmatrix.square_of_rows(rows, band_cells=2_000_000).where("i in (0, 4999)").collect()
    assert len(some) == 2 and {r.i: r.part[0] for r in some} == pytest.approx({0: a[:, 0] @ a[:, 0], 4999: a[:, 4999] @ a[:, 4999]})


def test_range_finder_on_flat_values(spark, monkeypatch):
    """Values that hardly fall, with so few vectors that the blocks start again from the best."""
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((300, 120)))[0]
    values = np.linspace(1.0, 2.0, 120)[::-1]
    a = q * values
    monkeypatch.setattr(factor, "BASIS_CELLS", 120 * 50)
    found = factor.svd(rows_of(spark, *a), 3)
    assert found.s == pytest.approx(values[:3], rel=1e-9)
    with pytest.warns(UserWarning, match="after 1 passes"):
        factor.range_finder(rows_of(spark, *a), 3, max_passes=1)
    with pytest.raises(ValueError, match="cells on the driver"):
        factor.svd(rows_of(spark, *a), 60)


def test_qr_of_dependent_columns(spark):
    r"""Fixed values: (1,2),(2,4),(3,6), whose second column is twice the first."""
    found = factor.qr(rows_of(spark, [1, 2], [2, 4], [3, 6]), compute_q=True)
    q = np.array([r.row for r in found.q.orderBy("i").collect()])
    assert q[:, 0] == pytest.approx(np.array([1, 2, 3]) / np.sqrt(14)) and (q[:, 1] == 0).all()
    assert found.r == pytest.approx(np.array([[np.sqrt(14), 2 * np.sqrt(14)], [0, 0]]), abs=1e-12)
    rng = np.random.default_rng(4)
    a = rng.standard_normal((50, 6))
    a[:, 3] = a[:, 0] - 2 * a[:, 1]
    a[:, 4] = 0
    a[:, 5] = a[:, 2] + 1e-9 * a[:, 5]
    found = factor.qr(rows_of(spark, *a), compute_q=True)
    q = np.array([r.row for r in found.q.orderBy("i").collect()])
    assert q.T @ q == pytest.approx(np.diag([1.0, 1, 1, 0, 0, 1]), abs=1e-12)
    assert q @ found.r == pytest.approx(a, abs=1e-12) and (np.diag(found.r) >= 0).all() and np.tril(found.r, -1) == pytest.approx(0)


def test_sampled_cosines_draw_alike(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, (4_000, 4)) * rng.integers(1, 9, (4_000, 1)).astype(float)
    rows = rows_of(spark, *a)
    once, again = (cells(factor.similar_columns(df, 0.2)) for df in (rows.repartition(3), rows.repartition(5, "i")))
    assert once == pytest.approx(again, rel=1e-12) and len(once) == 6
    other = cells(factor.similar_columns(rows, 0.2, seed=1))
    assert any(abs(once[k] - other[k]) > 1e-6 for k in once)
    size = np.linalg.norm(a, axis=0)
    exact = (a.T @ a) / np.outer(size, size)
    assert all(abs(v - exact[k]) < 0.2 * exact[k] for k, v in once.items())
    without = cells(factor.similar_columns(rows, 0.0))
    assert without == pytest.approx({k: exact[k] for k in without}) and len(without) == 6


def test_coordinate_covariance_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(coo, "COVARIANCE_TILE", 4)
    rng = np.random.default_rng(6)
    a = rng.integers(0, 4, (13, 11)) * (rng.random((13, 11)) < 0.4)
    a[:, 5] = 0
    stored = entries(spark, *[(int(i), int(j), a[i, j]) for i, j in zip(*np.nonzero(a))])
    found = coo.covariance(stored, coo.Shape(13, 11))
    assert found.count() == 121 and dense(found, 11, 11) == pytest.approx(np.cov(a.T), abs=1e-12)


def test_lifetime_releases_what_it_stored(spark):
    import glob

    from nodeloom import runtime

    base = runtime.checkpoint_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/table-*"))
    with runtime.lifetime(spark) as scope:
        held = scope.persist(runtime.store_table(spark.range(10)))
        value = scope.broadcast({"a": 1})
        with runtime.lifetime(spark):
            runtime.store_table(spark.range(3))
        out = scope.keep(held.where("id > 6"))
        assert held.count() == 10 and value.value == {"a": 1}
    assert len(set(glob.glob(f"{base}/table-*")) - before) == 1
    assert sorted(r.id for r in out.collect()) == [7, 8, 9] and not held.is_cached
    runtime.drop_stored(out)
    with pytest.raises(ZeroDivisionError), runtime.lifetime(spark):
        runtime.store_table(spark.range(3))
        1 / 0
    assert set(glob.glob(f"{base}/table-*")) == before


def sparse_entries(rows, cols, n, seed=4):
    r = np.random.default_rng(seed)
    places = np.unique(np.stack([r.integers(0, rows, n), r.integers(0, cols, n)], 1), axis=0)
    return [(int(i), int(j), float(v)) for (i, j), v in zip(places, r.normal(size=len(places)))]


def test_sparse_rows_wider_than_vectors_on_the_driver(spark):
    """12 components of 800,000 columns: more cells than the driver holds over the columns."""
    found = sparse_entries(30, 800_000, 6_000)
    used, at = np.unique([j for _, j, _ in found], return_inverse=True)
    a = np.zeros((30, len(used)))
    a[[i for i, _, _ in found], at] = [v for _, _, v in found]
    rows = coo.to_sparse_rows(entries(spark, *found), 800_000, piece=50_000).cache()
    assert rows.count() > 30
    svd = factor.svd(rows, 12, compute_u=True)
    u = np.array([r.row for r in svd.u.orderBy("i").collect()])
    v = {r.j: r.v for r in svd.v.collect()}
    v = np.array([v[j] for j in used])
    want = np.linalg.svd(a, compute_uv=False)
    assert svd.s == pytest.approx(want[:12], rel=1e-9) and u.T @ u == pytest.approx(np.eye(12), abs=1e-8)
    assert a @ v == pytest.approx(u * svd.s, abs=1e-7) and a.T @ u == pytest.approx(v * svd.s, abs=1e-7)
    assert (np.take_along_axis(v, np.abs(v).argmax(0)[None], 0) > 0).all()
    parts = factor.principal_components(rows, 29)
    centred = np.linalg.svd(a - a.mean(0), compute_uv=False)
    assert parts.explained == pytest.approx(centred[:29] ** 2 / (centred**2).sum(), rel=1e-9)
    image = np.array([r.row for r in rowmatrix.multiply_table(rows, parts.vectors).orderBy("i").collect()])
    assert np.cov(image.T) * 29 == pytest.approx(np.diag(centred[:29] ** 2), abs=1e-6)


@pytest.mark.parametrize("centred", [False, True])
def test_leading_vectors_from_passes_over_lists(spark, monkeypatch, centred):
    """Flat values, several of them equal, with room for so few vectors that the best go on alone."""
    r = np.random.default_rng(8)
    half = (r.random((20, 100)) < 0.3) * r.normal(size=(20, 100))
    a = np.kron(np.eye(3), half)
    lists = spark.createDataFrame([(j, np.flatnonzero(c).tolist(), c[c != 0].tolist()) for j, c in enumerate(a.T) if c.any()], "j bigint, at array<int>, x array<double>").coalesce(2).cache()
    monkeypatch.setattr(leading, "BASIS_CELLS", 60 * 20)
    x = a - a.mean(0) if centred else a
    for side in (4096, 2):
        s, u = leading.left_vectors(lists, 60, 3, centred=centred, dense_side=side)
        assert s == pytest.approx(np.linalg.svd(x, compute_uv=False)[:3], rel=1e-9)
        assert u.T @ u == pytest.approx(np.eye(3), abs=1e-8) and x @ (x.T @ u) == pytest.approx(u * s**2, abs=1e-7)
    with pytest.warns(UserWarning, match="after 1 passes"):
        leading.left_vectors(lists, 60, 3, dense_side=2, max_passes=1)


def test_a_side_that_fits_the_driver_needs_no_distributed_basis(spark, monkeypatch):
    def never(*a, **k):
        raise AssertionError("a distributed basis for a short side")

    monkeypatch.setattr(embedding, "block_lanczos", never)
    x = np.random.default_rng(3).normal(size=(12, 30))
    for y in (x, x.T):
        stored = entries(spark, *[(i, j, y[i, j]) for i in range(y.shape[0]) for j in range(y.shape[1])])
        s, v = embedding.right_vectors(stored, coo.Shape(*y.shape), 3, 4)
        got = np.array([t.v for t in sorted(v.collect(), key=lambda t: t.j)])
        assert np.allclose(s, np.linalg.svd(y)[1][:3], atol=1e-9) and np.allclose(np.abs(got), np.abs(np.linalg.svd(y)[2][:3].T), atol=1e-7)


@pytest.mark.parametrize("entries_a_cell", [500_000, 300])
def test_full_products_are_made_in_cells_of_a_grid(spark, monkeypatch, entries_a_cell):
    """No tile meets: each cell of the result is made in one task, or in one per inner part, sparse and dense."""

    def never(*a, **k):
        raise AssertionError("products were shuffled")

    monkeypatch.setattr(coo, "_tile_products", never)
    monkeypatch.setattr(coo, "GRID_CELLS_USUAL", 500)
    monkeypatch.setattr(coo, "GRID_ENTRIES", entries_a_cell)
    monkeypatch.setattr(coo, "GRID_STEP", 5_000)
    r = np.random.default_rng(6)
    for m, k, n, share in ((70, 50, 60, 1.0), (90, 400, 5, 0.15), (4, 300, 80, 0.1)):
        a, b = ((r.random(s) < share) * r.integers(1, 9, s).astype(float) for s in ((m, k), (k, n)))
        left = [(int(i) + 3, int(j), a[i, j] / 2) for i, j in zip(*np.nonzero(a))]
        right = [(int(i), int(j) - 2, b[i, j]) for i, j in zip(*np.nonzero(b))]
        # Two rows of each position on the left add up; an inner place without a partner meets nothing.
        found = cells(coo.multiply(entries(spark, *left, *left, (3, 900, 1.0)), entries(spark, *right)))
        met = (a != 0).astype(int) @ (b != 0).astype(int)
        assert found == {(i + 3, j - 2): (a @ b)[i, j] for i, j in zip(*np.nonzero(met))}


def _sparse_case(spark, monkeypatch, n_rows=60, n=47, share=0.15):
    """A sparse matrix, its coordinates and its rows in pieces, with blocks of few columns and steps of few entries."""
    rng = np.random.default_rng(8)
    a = rng.integers(1, 9, (n_rows, n)) * (rng.random((n_rows, n)) < share).astype(float)
    a[:, 5] = 0.0  # a column without an entry
    a[:, n - 1] = 0.0
    a[3, n - 1] = 2.0
    a[::2, 20:30] = 1.0  # and a full square
    i, j = np.nonzero(a)
    table = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i bigint, j bigint, v double").repartition(3)
    monkeypatch.setattr(squares, "ENTRIES", 40)
    monkeypatch.setattr(squares, "STEP", 300)
    monkeypatch.setattr(squares, "SENT", 50)
    return a[np.abs(a).sum(1) > 0], table, coo.to_sparse_rows(table, n, 16)


@pytest.mark.parametrize("edge, products", [(64, 4_000_000), (9, 4_000_000), (9, 10), (2, 4_000_000)])
def test_squares_of_sparse_rows(spark, monkeypatch, edge, products):
    """Held as arrays and as places, in blocks of several widths; every column has a row."""
    a, table, rows = _sparse_case(spark, monkeypatch)
    n = a.shape[1]
    monkeypatch.setattr(squares, "EDGE", edge)
    monkeypatch.setattr(squares, "PRODUCTS", products)
    g = squares.grid(table, n, False)
    made = []
    for bi in range(g.parts):
        for bj in range(bi, g.parts):
            cell = squares.Cell(bi * g.parts + bj, g)
            for k in range(len(a)):
                for b in {bi, bj}:
                    o = np.flatnonzero(a[k, g.block(b)]).astype(np.int32)
                    if len(o):
                        cell.take(np.full(len(o), k), np.full(len(o), b), o, a[k, g.block(b)][o])
            cell.close()
            made += [(i[x], cell.cols[y], v) for i, r, c, w in cell.found() for x, y, v in zip(r, c, w)]
    found = np.zeros((n, n))
    for i, j, v in made:
        found[i, j] += v
    assert len({(i, j) for i, j, _ in made}) == len(made) and found == pytest.approx(np.triu(a.T @ a))
    upper = rowmatrix.square_of_rows(rows)
    assert {r.i for r in upper.collect()} == set(range(n))
    got = np.zeros((n, n))
    for r in rowmatrix.upper_cells(upper).collect():
        got[r.i, r.j] += r.v
    assert got == pytest.approx(np.triu(a.T @ a))
    norms = rowmatrix.column_norms(rows)
    assert norms == pytest.approx(np.linalg.norm(a, axis=0))
    size = np.outer(norms, norms)
    want = np.triu(np.divide(a.T @ a, size, out=np.zeros_like(size), where=size > 0))
    got = np.zeros((n, n))
    for r in rowmatrix.upper_cells(rowmatrix.cosines_upper(upper, norms)).collect():
        got[r.i, r.j] = r.v
    assert got == pytest.approx(want)


@pytest.mark.parametrize("edge", [64, 9])
def test_covariance_of_sparse_rows(spark, monkeypatch, edge):
    a, table, rows = _sparse_case(spark, monkeypatch)
    n = a.shape[1]
    monkeypatch.setattr(squares, "EDGE", edge)
    assert rowmatrix.local_square(rowmatrix.covariance_upper(rows), n) == pytest.approx(np.cov(a.T), abs=1e-9)
    monkeypatch.setattr(coo, "GRID_COLUMNS", 40)
    monkeypatch.setattr(coo, "MAX_COLUMNS", 40)
    dims = coo.Shape(len(a), n)
    found = {(r.i, r.j): r.v for r in coo.covariance_upper(table, dims).collect()}
    assert len(found) == n * (n + 1) // 2
    assert found == pytest.approx({(i, j): np.cov(a.T)[i, j] for i in range(n) for j in range(i, n)}, abs=1e-9)


def test_wide_rows_with_gaps_stay_dense(spark, monkeypatch):
    monkeypatch.setattr(rowmatrix, "MAX_DENSE", 3)
    table = entries(spark, (0, 0, 1.0), (1, 4, 2.0))
    assert rowmatrix.is_sparse(catalog._wide_rows(table))
    gap = table.withColumn("v", F.when(F.col("j") == 0, F.col("v")))
    assert not rowmatrix.is_sparse(catalog._wide_rows(gap))


@pytest.mark.parametrize("turn", [False, True])
def test_process_takes_its_basis_over_the_shorter_side(spark, monkeypatch, turn):
    a = np.random.default_rng(8).integers(-2, 3, (6, 40)).astype(float)
    a[5] = a[0] + a[1]
    a = a.T if turn else a
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i, j in np.argwhere(a).tolist()], "i bigint, j bigint, v double")
    seen = []
    monkeypatch.setattr(embedding, "block_lanczos", lambda m, *args, keep=embedding.block_lanczos, **kw: seen.append(m.select("j").distinct().count()) or keep(m, *args, **kw))
    s, v = embedding.right_vectors(cells, coo.Shape(*a.shape), 6, dense_side=0)
    assert seen == [6] and len(s) == 5 and s == pytest.approx(np.linalg.svd(a, compute_uv=False)[:5])
    found = np.zeros((a.shape[1], 5))
    for r in v.collect():
        found[r.j] = r.v
    assert np.abs(found.T @ found - np.eye(5)).max() < 1e-8 and np.abs(a.T @ (a @ found) - found * s**2).max() < 1e-7


@pytest.mark.parametrize("turn", [False, True])
def test_many_components_come_from_rotations_of_blocks(spark, monkeypatch, turn):
    def never(*args, **kw):
        raise AssertionError("the process has no room for so many components")

    monkeypatch.setattr(embedding, "block_lanczos", never)
    monkeypatch.setattr(rotations, "BLOCK_CELLS", 280 * 75)
    a = (np.random.default_rng(5).random((280, 330)) < 0.05).astype(float)
    a[9], a[11], a[:, 4] = a[8], 0.0, 0.0
    a = a.T if turn else a
    m, n = a.shape
    table = spark.createDataFrame([(i, j, 1.0) for i, j in np.argwhere(a).tolist()], "i bigint, j bigint, v double")
    s, v = embedding.right_vectors(table, coo.Shape(m, n), 280, dense_side=0)
    want = np.linalg.svd(a, compute_uv=False)
    want = want[want > 1e-7 * want[0]]
    assert len(s) == len(want) < 280 and s == pytest.approx(want)
    found = np.zeros((n, len(s)))
    for r in v.collect():
        found[r.j] = r.v
    assert np.abs(found.T @ found - np.eye(len(s))).max() < 1e-7 and np.abs(a.T @ (a @ found) - found * s**2).max() < 1e-8
    assert all(found[np.round(np.abs(found[:, c]), 9).argmax(), c] > 0 for c in range(len(s)))
    image = {r.i: r.row for r in rotations.product(table, v, m, len(s)).collect()}
    assert sorted(image) == list(range(m)) and np.abs(np.array([image[i] for i in range(m)]) - a @ found).max() < 1e-12


def test_every_pair_of_blocks_meets_once():
    for count in (2, 4, 6, 12):
        met = [p for turn in range(count - 1) for p in rotations.pairs(count, turn)]
        assert len(met) == len(set(met)) == count * (count - 1) // 2
        assert all(sorted(sum(rotations.pairs(count, turn), ())) == list(range(count)) for turn in range(count - 1))


def test_equal_values_and_dense_stripes_turn_into_place(spark):
    a = np.kron(np.eye(3), np.ones((4, 5))) + np.kron(np.eye(3), np.eye(4, 5))
    table = spark.createDataFrame([(i, j, float(a[i, j])) for i, j in np.argwhere(a).tolist()], "i bigint, j bigint, v double")
    s, v = rotations.right_vectors(table, 12, 15, 12, 1e-7)
    assert s == pytest.approx(np.linalg.svd(a, compute_uv=False))
    found = np.zeros((15, 12))
    for r in v.collect():
        found[r.j] = r.v
    assert np.abs(found.T @ found - np.eye(12)).max() < 1e-10 and np.abs(a.T @ (a @ found) - found * s**2).max() < 1e-10


def test_sparse_and_dense_sums_of_a_stripe_agree(monkeypatch):
    a = (np.random.default_rng(3).random((40, 30)) < 0.2) * 2.0
    at, j = np.nonzero(a)
    order = np.lexsort((at, j))
    at, j = at[order], j[order]
    x, right = a[at, j], np.random.default_rng(4).random((40, 6))
    monkeypatch.setattr(rotations, "STEP_CELLS", 150)
    own = np.unique(j)[::-1]
    lines = np.random.default_rng(6).random((len(own), 3))
    for dense in (0, 10**9):
        monkeypatch.setattr(rotations, "DENSE", dense)
        square, sums = np.zeros((40, 12)), np.zeros((40, 3))
        rotations._add_square(square, 10, 22, j, at, x)
        assert square == pytest.approx((a @ a.T)[:, 10:22])
        assert rotations._lists_times(j, at, x, right) == pytest.approx(a.T[np.unique(j)] @ right)
        rotations._add_lists(sums, (j, at, x), own, lines)
        assert sums == pytest.approx(a[:, own] @ lines)


@pytest.mark.parametrize("side", [4_096, 0])
def test_equal_components_fall(spark, tmp_path, monkeypatch, side):
    keep = embedding.right_vectors
    monkeypatch.setattr(embedding, "MOST", 0)
    monkeypatch.setattr(embedding, "right_vectors", lambda *args: keep(*args, dense_side=side))
    a = np.random.default_rng(12).random((8, 15)) < 0.4
    rows = [(1, 1, int(i) + 8 * copy, int(j) + 15 * copy + 100, 2.0) for copy in range(4) for i, j in np.argwhere(a)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.QUERIES["g13_all_components"](spark, str(tmp_path)).orderBy("component").collect()]
    assert got == [(n, 0.0, 1.0, True, float(len(rows))) for n in range(1, 33)]


@pytest.mark.parametrize("unit", [False, True])
def test_tiles_of_lists_multiply_like_the_lists(spark, monkeypatch, unit):
    """Lists and places with more entries than a run, an entry that comes twice, and more lists than a tile holds."""
    monkeypatch.setattr(leading, "TILE", 40)
    monkeypatch.setattr(leading, "RUN", 4)
    r = np.random.default_rng(5)
    a = (r.random((30, 50)) < 0.2) * r.normal(size=(30, 50))
    a[:, 0] = a[7] = 1.0
    rows = [(j, np.flatnonzero(c).tolist(), (np.ones(np.count_nonzero(c)) if unit else c[c != 0]).tolist()) for j, c in enumerate(a.T)]
    rows[0][1].append(3), rows[0][2].append(1.0)
    x = (a != 0) * 1.0 if unit else a.copy()
    x[3, 0] += 1.0
    laid = leading.tiles(spark.createDataFrame(rows, "j bigint, at array<int>, x array<double>").coalesce(2))
    assert laid.count() > 2 and laid.selectExpr("sum(n)").first()[0] == 50
    q = r.normal(size=(30, 3))
    for cells in (leading.TILE_CELLS, 1):
        monkeypatch.setattr(leading, "TILE_CELLS", cells)
        assert leading.square_times(laid, q) == pytest.approx(x @ (x.T @ q), abs=1e-9)
    y = x - x.mean(0)
    assert leading.square_times(laid, q, centred=True) == pytest.approx(y @ (y.T @ q), abs=1e-9)


def test_entries_go_to_cells_of_blocks_that_their_row_has(spark, monkeypatch):
    """Parts that share no row are sent once each, and wide cells are cut by their entries, however many products they have."""
    monkeypatch.setattr(squares, "EDGE", 2)
    monkeypatch.setattr(squares, "BLOCK_ENTRIES", 160)
    monkeypatch.setattr(squares, "PRODUCTS", 50)
    r = np.random.default_rng(3)
    a = np.kron(np.eye(2), r.integers(1, 9, (20, 16))).astype(float)
    i, j = np.nonzero(a)
    table = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i bigint, j bigint, v double")
    monkeypatch.setattr(squares, "shuffle_partitions", lambda spark: 2)
    g = squares.grid(table, 32, False)
    assert g.edge > squares.EDGE and all(np.count_nonzero(a[:, g.block(b)]) <= 160 for b in range(g.parts))
    sent = squares.to_cells(table, g).collect()
    own = [len({y // g.edge for y in np.flatnonzero(row)}) for row in a]
    assert sum(len(x.o) for x in sent) == sum(n * np.count_nonzero(row) for n, row in zip(own, a))
    got = np.zeros((32, 32))
    for x in squares.stored_upper(table, 32).collect():
        got[x.i, x.first + np.array(x["at"], dtype=int)] += x.part
    assert got == pytest.approx(np.triu(a.T @ a))


def test_triplets_are_checked_with_one_line_a_column(spark):
    """The check sees a wrong value, and no row per column and component is shuffled."""
    a = np.random.default_rng(4).normal(size=(4, 30))
    table = entries(spark, *[(i, j, float(a[i, j])) for i in range(4) for j in range(30)])
    found = factor.svd(coo.to_sparse_rows(table, 30, 16), 4, compute_u=True)
    checked = catalog._checked_triplets(table, found, spark)
    rows = {r.component: r for r in checked.collect()}
    assert all(r.residual < 1e-9 and abs(r.left_length - 1) < 1e-9 and abs(r.right_length - 1) < 1e-9 and r.falling for r in rows.values()) and len(rows) == 4
    wrong = {r.component: r for r in catalog._checked_triplets(table, found._replace(s=found.s * [1.0, 1.5, 1.0, 1.0]), spark).collect()}
    assert wrong[2].residual > 0.01 > wrong[1].residual
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [j#" in plan and "images" in plan and not any("Join" in line and "c#" in line for line in plan.splitlines())
