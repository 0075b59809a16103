"""Property tests: random small matrices, cell products vs array products vs
NumPy, and one training step of both trainers vs NumPy."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellgrad.functions import arrays as A
from cellgrad.operators import coo
from cellgrad.operators.weights import stack
from cellgrad.plans.arrays import np_gradient, train_array
from cellgrad.plans.relational import Net, train_relational

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def cells(spark, m):
    rows = [(i + 1, j + 1, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"] - 1, r["j"] - 1] = r["v"]
    return out


@SETTINGS
@given(n=st.integers(1, 4), k=st.integers(1, 4), m=st.integers(1, 4), seed=st.integers(0, 10_000))
def test_cell_and_array_products_agree_with_numpy(spark, n, k, m, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    got_cells = dense(coo.matmul(cells(spark, a), cells(spark, b), b_bound=k * m), (n, m))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<array<double>>")
    got_arrays = np.array(df.select(A.mat_mul("a", "b").alias("p")).first()["p"])
    assert np.allclose(got_cells, a @ b) and np.allclose(got_arrays, a @ b)


@SETTINGS
@given(n=st.integers(1, 5), d=st.integers(1, 3), h=st.integers(1, 3), c=st.integers(1, 3),
       seed=st.integers(0, 10_000), preset=st.sampled_from(["sigmoid", "tanh_softmax"]))
def test_one_step_of_both_trainers_matches_numpy(spark, n, d, h, c, seed, preset):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)); y = np.eye(c)[rng.integers(0, c, n)]
    w1, w2 = rng.normal(size=(d, h)), rng.normal(size=(h, c))
    net = Net(d, h, c, preset)
    w0 = stack(cells(spark, w1), cells(spark, w2)).drop("iter")
    [(g1, g2)] = np_gradient(x, y, [(w1, w2)], preset)
    rel = train_relational(cells(spark, x), cells(spark, y), w0, net, 0.1, 1, reduction="mean")
    rows = spark.createDataFrame([(i + 1, x[i].tolist(), y[i].tolist()) for i in range(n)],
                                 "i long, x array<double>, y array<double>")
    arr = train_array(rows, w0, net, 0.1, 1, reduction="mean")
    for hist in (rel, arr):
        step = hist.filter("iter = 1")
        assert np.allclose(dense(step.filter("id = 0"), (d, h)), w1 - 0.1 * g1 / n)
        assert np.allclose(dense(step.filter("id = 1"), (h, c)), w2 - 0.1 * g2 / n)
