"""Weight matrices as cell tables: initialisation, tagging, stacking, models.

A weight table is ``(i, j, v)``; a model store adds ``w_id`` (one model per
hidden size); a training history adds ``iter`` and ``id`` (0 = input→hidden,
1 = hidden→output).  All of them are bounded by the shape parameters, which
is what lets the plans broadcast them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrad.functions.scalar import W_HO_COEF, W_XH_COEF, formula_weight, uniform_weight

XH, HO = 0, 1


def dims_frame(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(1).select(F.lit(rows).alias("_r"), F.lit(cols).alias("_c"))


def weight_cells(dims: DataFrame, coef=W_XH_COEF, seed: int | None = None,
                 rows_col: str = "_r", cols_col: str = "_c",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Cells i in 1..rows, j in 1..cols for each row of ``dims`` (two
    generators, no cross join).  ``seed`` given: uniform in [-1, 1);
    otherwise the deterministic rule of ``formula_weight``."""
    keep = list(keep)
    grid = (dims.select(*keep, F.explode(F.sequence(F.lit(1), F.col(rows_col))).alias("i"), cols_col)
            .select(*keep, "i", F.explode(F.sequence(F.lit(1), F.col(cols_col))).alias("j"))
            .select(*keep, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    v: Column = uniform_weight(seed, *keep, "i", "j") if seed is not None else formula_weight("i", "j", coef)
    return grid.select(*keep, "i", "j", v.alias("v"))


def init_coo(spark: SparkSession, rows: int, cols: int, coef=W_XH_COEF,
             seed: int | None = None, w_id: int | None = None) -> DataFrame:
    cells = weight_cells(dims_frame(spark, rows, cols), coef, seed)
    return tag(cells, w_id=w_id) if w_id is not None else cells


def tag(df: DataFrame, **consts) -> DataFrame:
    """Prefix constant columns (``select 0, 0, *``)."""
    return df.select(*[F.lit(v).cast("long").alias(k) for k, v in consts.items()], *df.columns)


def stack(w_xh: DataFrame, w_ho: DataFrame, iter_: int = 0) -> DataFrame:
    """Both matrices in one table ``(iter, id, i, j, v)``; rows are unique by
    ``(id, i, j)`` already, so a plain union (no de-duplicating shuffle)."""
    return (tag(w_xh.select("i", "j", "v"), iter=iter_, id=XH)
            .unionByName(tag(w_ho.select("i", "j", "v"), iter=iter_, id=HO)))


def select_model(w: DataFrame, w_id: int, col: str = "w_id") -> DataFrame:
    """Equality filter on the model id (partition pruning when the store is
    written partitioned by it)."""
    return w.filter(F.col(col) == F.lit(w_id)).drop(col)


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """``INSERT INTO … SELECT`` inside a plan: union by name."""
    return store.unionByName(new)


def unstack(w: DataFrame, matrix_id: int) -> DataFrame:
    return w.filter(F.col("id") == F.lit(matrix_id)).select("i", "j", "v")


def write_store(store: DataFrame, path: str, key: str = "w_id", mode: str = "append") -> None:
    """Append models to a parquet model store partitioned by model id, so that
    reading one model prunes every other model's files."""
    store.write.mode(mode).partitionBy(key).parquet(path)


def read_model(spark: SparkSession, path: str, w_id: int, key: str = "w_id") -> DataFrame:
    """One model from a partitioned store (partition filter on ``key``)."""
    return select_model(spark.read.parquet(path), w_id, key)


def weights_from_json(df: DataFrame, text_col: str, alias: str = "m") -> DataFrame:
    """Literal matrix text ``[[...],[...]]`` -> ``ARRAY<ARRAY<DOUBLE>>``."""
    return df.withColumn(alias, F.from_json(F.col(text_col), "array<array<double>>"))


def matrix_json(df: DataFrame, mat_col: str, alias: str = "text") -> DataFrame:
    return df.withColumn(alias, F.to_json(F.col(mat_col)))
