"""Scalar column functions used by every layer (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The deterministic weight rule shared with the SQL oracle.
#   w_xh(i, j) = ((i*31 + j*17) % 101) / 50.0 - 1
#   w_ho(i, j) = ((i*13 + j*29) % 101) / 50.0 - 1      (1-based i, j)
W_XH_COEF = (31, 17)
W_HO_COEF = (13, 29)
WEIGHT_MODULUS = 101
WEIGHT_SCALE = 50.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    """1 / (1 + exp(-x)); saturates to 0 or 1 for |x| large, no error."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def tanh(x) -> Column:
    return F.tanh(_c(x))


def d_sigmoid(a) -> Column:
    """Derivative of the sigmoid expressed in its output a: a(1-a)."""
    a = _c(a)
    return a * (F.lit(1.0) - a)


def d_tanh(a) -> Column:
    """Derivative of tanh expressed in its output a: 1 - a*a."""
    a = _c(a)
    return F.lit(1.0) - a * a


def d_sqloss(a, y) -> Column:
    """Derivative of the squared loss: 2(a - y)."""
    return F.lit(2.0) * (_c(a) - _c(y))


def formula_weight(i, j, coef=W_XH_COEF) -> Column:
    """Deterministic weight in [-1, 1) from 1-based indices (see fixed values)."""
    a, b = coef
    k = (_c(i).cast("long") * F.lit(a) + _c(j).cast("long") * F.lit(b)) % F.lit(WEIGHT_MODULUS)
    return k.cast("double") / F.lit(WEIGHT_SCALE) - F.lit(1.0)


def uniform_weight(seed: int, *cell: str) -> Column:
    """Weight in [-1, 1) drawn by hashing the seed with the cell's indices:
    the same cells get the same weights on any cluster and in any order."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), *cell), 11)
    return draw.cast("double") / F.lit(float(1 << 52)) - F.lit(1.0)


def register_sql_functions(spark: SparkSession) -> None:
    """SQL-body functions usable from spark.sql; they inline into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sig(x DOUBLE) RETURNS DOUBLE "
              "RETURN 1.0D / (1.0D + exp(-x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION d_sig(a DOUBLE) RETURNS DOUBLE "
              "RETURN a * (1.0D - a)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION d_tanh(a DOUBLE) RETURNS DOUBLE "
              "RETURN 1.0D - a * a")


def register_table_functions(spark: SparkSession) -> None:
    """SQL-body table functions for index grids, for use in SQL text:
    ``LATERAL index_row(n)`` gives j in 1..n per row, ``index_grid(r, c)`` all
    (i, j) with i in 1..r and j in 1..c; none where a bound is null or below
    one.  They inline into a generator: no join, no exchange."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION index_row(n BIGINT) RETURNS TABLE (j BIGINT) "
              "RETURN SELECT explode(CASE WHEN n > 0 THEN sequence(1L, n) END)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION index_grid(r BIGINT, c BIGINT) "
              "RETURNS TABLE (i BIGINT, j BIGINT) RETURN SELECT k.i, k.j FROM (SELECT explode("
              "CASE WHEN r > 0 AND c > 0 THEN transform(sequence(0L, r * c - 1), "
              "k -> struct(k div c + 1 AS i, k % c + 1 AS j)) END) AS k)")
