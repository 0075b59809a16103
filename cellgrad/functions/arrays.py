"""Matrices as nested arrays: a vector is ``ARRAY<DOUBLE>`` (a 1×n matrix),
a matrix is ``ARRAY<ARRAY<DOUBLE>>`` stored row by row.

All helpers build Spark higher-order-function expressions, so they run in the
JVM.  Intermediates that are used more than once are bound with ``let`` so the
optimizer cannot copy a large sub-expression into every use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column lambda)."""
    return F.element_at(F.transform(F.array(_c(value)), body), 1)


def vec_mat(x, w) -> Column:
    """Row vector times matrix: x (k) · W (k×m) -> (m)."""
    x, w = _c(x), _c(w)
    return F.transform(
        F.sequence(F.lit(0), F.size(F.element_at(w, 1)) - 1),
        lambda col: F.aggregate(F.zip_with(x, w, lambda a, row: a * row[col]),
                                F.lit(0.0), lambda acc, t: acc + t))


def mat_mul(a, b) -> Column:
    """Matrix product A (n×k) · B (k×m)."""
    b = _c(b)
    return F.transform(_c(a), lambda row: vec_mat(row, b))


def mat_t(a) -> Column:
    """Transpose of a matrix."""
    a = _c(a)
    return F.transform(F.sequence(F.lit(0), F.size(F.element_at(a, 1)) - 1),
                       lambda j: F.transform(a, lambda row: row[j]))


def vec_zip(x, y, fn) -> Column:
    return F.zip_with(_c(x), _c(y), fn)


def mat_zip(a, b, fn) -> Column:
    """Cell-wise combination of two equally shaped matrices."""
    return F.zip_with(_c(a), _c(b), lambda r, s: F.zip_with(r, s, fn))


def mat_axpy(w, g, alpha: float) -> Column:
    """``W + alpha * G`` cell-wise (the update ``W - lr * G`` with alpha = -lr)."""
    return mat_zip(w, g, lambda a, b: a + F.lit(float(alpha)) * b)


def mat_map(a, fn) -> Column:
    """Scalar function applied to every cell."""
    return F.transform(_c(a), lambda r: F.transform(r, fn))


def outer(x, d) -> Column:
    """Outer product of two vectors: (n) ⊗ (m) -> n×m (xᵀ·d of 1×n, 1×m)."""
    d = _c(d)
    return F.transform(_c(x), lambda p: F.transform(d, lambda q: p * q))


def argmax(x) -> Column:
    """1-based position of the largest value; the first one on ties."""
    x = _c(x)
    return F.array_position(x, F.array_max(x)).cast("long")


def softmax(x) -> Column:
    """Row softmax, shifted by the row maximum for stability."""
    def body(v):
        return let(F.transform(v, lambda t: F.exp(t - F.array_max(v))),
                   lambda e: F.transform(e, lambda t: t / F.aggregate(
                       e, F.lit(0.0), lambda acc, u: acc + u)))
    return let(_c(x), body)


def sigmoid_vec(x) -> Column:
    return F.transform(_c(x), lambda t: F.lit(1.0) / (F.lit(1.0) + F.exp(-t)))


def tanh_vec(x) -> Column:
    return F.transform(_c(x), lambda t: F.tanh(t))


def one_hot(label, n_classes: int) -> Column:
    """Vector of n values, 1 at the 0-based position ``label`` and 0 elsewhere
    (all 0 for a label outside 0..n-1); NULL, unlabelled, for a NULL label."""
    k = _c(label).cast("long")
    return F.when(k.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                                             lambda p: (p == k).cast("double")))


def pack(cols, div: float = 1.0, add: float = 0.0) -> Column:
    """Wide columns -> one vector, scaled ``x / div + add``."""
    return F.array(*[_c(c).cast("double") / F.lit(float(div)) + F.lit(float(add))
                     for c in cols])
