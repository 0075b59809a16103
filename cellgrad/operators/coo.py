"""Matrix algebra over cell tables ``(i, j, v)``.

A product is a join on the contracted index followed by ``sum`` grouped by the
two kept indices.  Which index is contracted decides whether a side is used
as is or transposed, so no transpose is ever materialised.

Partitioning: the large operand is the example matrix, keyed by example id
``i``.  If it is hash partitioned on ``i`` (``partition_examples``), products
with a broadcast weight matrix and every later cell-wise join on ``(i, j)``
keep that partitioning and add no exchange.  Contractions over examples
(``matmul_at``) end in a tiny ``(j, k)`` result; the partial aggregate on the
map side collapses each partition to at most ``rows × cols`` cells first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrad.session import CELL_ROW_BYTES, broadcast_cap, shuffle_partitions

def contract_join(left: DataFrame, right: DataFrame, on: list[str], bound: int | None,
                  salt_by: str, row_bytes: int = CELL_ROW_BYTES) -> DataFrame:
    """Join of a large side with weights on the contracted index ``_k``.

    Within the broadcast cap ``right`` is broadcast.  Beyond it both sides are
    shuffled; ``_k`` has few values, so the large side is salted by
    ``salt_by`` and the weights are repeated once per salt: the join then
    spreads over keys x salts, whatever the size of the weights."""
    spark = left.sparkSession
    if bound is not None and bound * row_bytes <= broadcast_cap(spark):
        return left.join(F.broadcast(right), on)
    salts = shuffle_partitions(spark)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread.hint("shuffle_hash"), [*on, "_salt"]).drop("_salt")


def contract(a: DataFrame, b: DataFrame, a_sum: str, b_sum: str,
             *, b_bound: int | None = None, act=None) -> DataFrame:
    """General product of two cell tables.

    ``a_sum`` / ``b_sum`` name the index ("i" or "j") of each side that is
    summed over; the other index of each side is kept, ``a``'s first.
    ``b_bound`` is the proven row bound of a weight side, see
    ``contract_join``.  ``act`` is applied to the sum.
    """
    a_keep = "j" if a_sum == "i" else "i"
    b_keep = "j" if b_sum == "i" else "i"
    left = a.select(F.col(a_keep).alias("_ri"), F.col(a_sum).alias("_k"),
                    F.col("v").alias("_av"))
    right = b.select(F.col(b_sum).alias("_k"), F.col(b_keep).alias("_rj"),
                     F.col("v").alias("_bv"))
    s = F.sum(F.col("_av") * F.col("_bv"))
    joined = contract_join(left, right, ["_k"], b_bound, "_ri") if b_bound is not None else left.join(right, "_k")
    return (joined.groupBy(F.col("_ri").alias("i"), F.col("_rj").alias("j"))
            .agg((act(s) if act is not None else s).alias("v")))


def matmul(a: DataFrame, b: DataFrame, *, b_bound: int | None = None,
           act=None) -> DataFrame:
    """A·B: join ``a.j = b.i``, group by ``(a.i, b.j)``."""
    return contract(a, b, "j", "i", b_bound=b_bound, act=act)


def matmul_bt(a: DataFrame, b: DataFrame, *, b_bound: int | None = None,
              act=None) -> DataFrame:
    """A·Bᵀ: join ``a.j = b.j``, group by ``(a.i, b.i)``."""
    return contract(a, b, "j", "j", b_bound=b_bound, act=act)


def matmul_at(a: DataFrame, b: DataFrame, *, b_bound: int | None = None,
              act=None) -> DataFrame:
    """Aᵀ·B: join ``a.i = b.i`` (contracts the example index), group by
    ``(a.j, b.j)``."""
    return contract(a, b, "i", "i", b_bound=b_bound, act=act)


def hadamard(a: DataFrame, b: DataFrame, fn=None) -> DataFrame:
    """Cell-wise ``fn(a.v, b.v)`` (default product) over the cells both have."""
    fn = fn or (lambda x, y: x * y)
    left = a.select("i", "j", F.col("v").alias("_av"))
    right = b.select("i", "j", F.col("v").alias("_bv"))
    return (left.join(right, ["i", "j"])
            .select("i", "j", fn(F.col("_av"), F.col("_bv")).alias("v")))


def cellwise(a: DataFrame, fn) -> DataFrame:
    """Scalar function applied to every cell value."""
    return a.select("i", "j", fn(F.col("v")).alias("v"))


def softmax_rows(a: DataFrame) -> DataFrame:
    """Softmax over each row i (window partitioned by i; no exchange when
    the input is already partitioned by i)."""
    w = Window.partitionBy("i")
    shifted = a.withColumn("_e", F.exp(F.col("v") - F.max("v").over(w)))
    return shifted.select("i", "j", (F.col("_e") / F.sum("_e").over(w)).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def layer(x: DataFrame, w: DataFrame, act, *, w_bound: int | None = None) -> DataFrame:
    """Dense layer without bias: act(x·W), activation fused into the aggregate."""
    return matmul(x, w, b_bound=w_bound, act=act)

