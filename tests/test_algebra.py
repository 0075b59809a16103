"""Cell algebra and array helpers against NumPy; gradient check."""

import numpy as np
from pyspark.sql import functions as F

from cellgrad.functions import arrays as A
from cellgrad.operators import coo
from cellgrad.operators.reshape import coo_to_array, matrix_to_coo
from cellgrad.operators.weights import stack
from cellgrad.plans.arrays import np_gradient
from cellgrad.plans.relational import Net, step_gradient


def to_cells(spark, m):
    rows = [(i + 1, j + 1, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "i long, j long, v double")


def to_np(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"] - 1, r["j"] - 1] = r["v"]
    return out


def test_products_match_numpy(spark):
    rng = np.random.default_rng(7)
    a, b, c = rng.normal(size=(5, 3)), rng.normal(size=(3, 4)), rng.normal(size=(6, 3))
    da, db, dc = to_cells(spark, a), to_cells(spark, b), to_cells(spark, c)
    assert np.allclose(to_np(coo.matmul(da, db, b_bound=12), (5, 4)), a @ b)
    assert np.allclose(to_np(coo.matmul_bt(da, dc), (5, 6)), a @ c.T)
    assert np.allclose(to_np(coo.matmul_at(da, to_cells(spark, a)), (3, 3)), a.T @ a)
    assert np.allclose(to_np(coo.hadamard(da, da), (5, 3)), a * a)
    # invariant: A·Bᵀ == A·transpose(B)
    assert np.allclose(to_np(coo.matmul_bt(da, dc), (5, 6)),
                       to_np(coo.matmul(da, coo.transpose(dc)), (5, 6)))


def test_softmax_rows_sum_to_one(spark):
    rng = np.random.default_rng(3)
    m = to_cells(spark, rng.normal(size=(4, 5)) * 50)
    sums = coo.softmax_rows(m).groupBy("i").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_array_helpers_match_numpy(spark):
    rng = np.random.default_rng(11)
    x, w = rng.normal(size=3), rng.normal(size=(3, 4))
    df = spark.createDataFrame([(x.tolist(), w.tolist())], "x array<double>, w array<array<double>>")
    r = df.select(A.vec_mat("x", "w").alias("p"), A.mat_t("w").alias("t"), A.outer("x", "x").alias("o"),
                  A.argmax("x").alias("k"), A.softmax("x").alias("s"),
                  A.mat_mul("w", A.mat_t("w")).alias("ww"),
                  A.one_hot(F.lit(2), 4).alias("h")).first()
    assert np.allclose(r["p"], x @ w)
    assert np.allclose(np.array(r["t"]), w.T)
    assert np.allclose(np.array(r["o"]), np.outer(x, x))
    assert r["k"] == int(np.argmax(x)) + 1
    assert np.allclose(r["s"], np.exp(x - x.max()) / np.exp(x - x.max()).sum())
    assert np.allclose(np.array(r["ww"]), w @ w.T)
    assert r["h"] == [0.0, 0.0, 1.0, 0.0]


def test_coo_array_round_trip(spark):
    m = np.arange(12, dtype=float).reshape(3, 4)
    back = matrix_to_coo(coo_to_array(to_cells(spark, m)), "m")
    assert np.allclose(to_np(back, (3, 4)), m)


def test_relational_gradient_matches_numpy_and_finite_differences(spark):
    rng = np.random.default_rng(5)
    n, d, h, c = 6, 3, 2, 2
    x = rng.normal(size=(n, d)); y = np.eye(c)[rng.integers(0, c, n)]
    w1, w2 = rng.normal(size=(d, h)), rng.normal(size=(h, c))
    net = Net(d, h, c)
    g = step_gradient(to_cells(spark, x), to_cells(spark, y), to_cells(spark, w1), to_cells(spark, w2), net)
    g1 = to_np(g.filter("id = 0"), (d, h)); g2 = to_np(g.filter("id = 1"), (h, c))
    [(n1, n2)] = np_gradient(x, y, [(w1, w2)], "sigmoid")
    assert np.allclose(g1, n1) and np.allclose(g2, n2)

    def loss(a, b):
        s = lambda z: 1 / (1 + np.exp(-z))
        return ((s(s(x @ a) @ b) - y) ** 2).sum()
    eps = 1e-6
    for (i, j) in [(0, 0), (2, 1)]:
        p = w1.copy(); p[i, j] += eps; m = w1.copy(); m[i, j] -= eps
        assert abs((loss(p, w2) - loss(m, w2)) / (2 * eps) - g1[i, j]) < 1e-5
    p = w2.copy(); p[1, 0] += eps; m = w2.copy(); m[1, 0] -= eps
    assert abs((loss(w1, p) - loss(w1, m)) / (2 * eps) - g2[1, 0]) < 1e-5


def test_mat_axpy(spark):
    w = np.array([[1.0, 2.0], [3.0, 4.0]]); g = np.array([[0.5, -1.0], [2.0, 0.0]])
    df = spark.createDataFrame([(w.tolist(), g.tolist())], "w array<array<double>>, g array<array<double>>")
    got = np.array(df.select(A.mat_axpy("w", "g", -0.1).alias("m")).first()["m"])
    assert np.allclose(got, w - 0.1 * g)
