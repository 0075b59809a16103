import math

import numpy as np
import pytest

from cellgrad.llm import queries
from cellgrad.llm import whitening as W

from .conftest import SF001


def test_inertia_counts_eigenvalues_below():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 20, 41):
        a = rng.standard_normal((d, d))
        a = a + a.T
        if d > 3:
            a[0, 0] = a[1, 1] = 0.0  # pivots of two
        e = np.linalg.eigvalsh(a)
        for shift in [*(e[:-1] + np.diff(e) / 2), e[0] - 1, e[-1] + 1]:
            assert W.inertia(a, shift) == (e < shift).sum()
    assert W.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("kind", ["plain", "doubled", "equal", "steep", "few rows", "one row"])
def test_components_equal_a_dense_solver(kind):
    rng = np.random.default_rng(len(kind))
    x = rng.standard_normal((90, 48))
    if kind == "doubled":  # dependent dimensions
        x = np.hstack([x[:, :20], x[:, :20]])
    if kind == "equal":  # every eigenvalue twice
        x = np.kron(x[:, :20], np.eye(2))
    if kind == "steep":
        x = x * 10.0 ** -np.linspace(0, 5, 48)
    if kind == "few rows":
        x = x[:7]
    if kind == "one row":
        x = x[:1]
    z = x - x.mean(axis=0)
    v = z.T @ z / len(z)
    e, u = W.leading_components(v, 32)
    ref = np.linalg.eigvalsh(v)[::-1][:32]
    top = max(ref[0], 1e-300)
    assert np.allclose(e, ref[:len(e)], atol=1e-12 * top) and (ref[len(e):] < 1e-10 * top).all()
    assert np.abs(u.T @ u - np.eye(len(e))).max(initial=0) < 1e-12
    assert np.abs(v @ u - u * e).max(initial=0) < 1e-12 * top


def check(rows, vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    white = np.array([r["whitened"] for r in rows])
    k = white.shape[1]
    ref = z @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((white * ref).sum(axis=0))
    assert np.abs(white - ref * sign).max() < 1e-7
    for r, row in zip(rows, x):
        assert r["n"] == n and r["deviation"] == sum(int(d) ** 2 for d in n * row - s)
        assert np.allclose(r["explained"], e[:k] / np.trace(v), rtol=1e-10)
        assert 0 <= r["identity_error"] < 1e-9
    return k


def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = W.whiten(table).orderBy("vec_id").collect()
    vectors = [r["embedding"] for r in table.orderBy("vec_id").collect()]
    assert check(rows, vectors) == 32
    again = W.whiten(table.repartition(7)).orderBy("vec_id").collect()
    for a, b in zip(rows, again, strict=True):  # the fit is exact: partitions do not matter
        assert (a["vec_id"], a["n"], a["deviation"], a["explained"]) == (b["vec_id"], b["n"], b["deviation"], b["explained"])
        assert np.abs(np.subtract(a["whitened"], b["whitened"])).max() < 1e-12
    out = queries.op13_whitening(spark, SF001)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 32 * len(vectors)
    first = out.where("component = 5").orderBy("vec_id").first()
    assert first["whitened"] == rows[0]["whitened"][4] and first["explained"] == rows[0]["explained"][4]


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [[float(x) for x in rng.standard_normal(6)] for _ in range(40)]
    good += [good[0], good[0]]  # repeats
    rows = [(k, v, "x", k) for k, v in enumerate(good)]
    rows += [(100, None, "x", 0), (101, [], "x", 0), (102, [1.0] * 5 + [None], "x", 0), (103, [math.nan] * 6, "x", 0),
             (104, [math.inf] + [0.0] * 5, "x", 0), (105, [1.0, 2.0], "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n long")
    got = W.whiten(df).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(42)) and check(got, good) == 6
    null_id = spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = W.whiten(null_id).collect()
    assert len(got) == 2 and {r["vec_id"] for r in got} == {None, 1} and all(len(r["whitened"]) == 1 for r in got)


def test_nothing_varies(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = W.whiten(df).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(0, [], [], 0.0)] * 2
    assert W.whiten(df.where("false")).collect() == []
