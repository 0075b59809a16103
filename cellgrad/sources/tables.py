"""The driver's parquet tables in the roles of the two reference data sets.

* MNIST-like (dense, 10 classes): ``embeddings(vec_id, embedding, label)``
  with i = vec_id + 1, feature j = position + 1, class j = label + 1.
* Iris-like (4 features, 3 classes): ``lineitem`` with the four scaled
  columns below and the class from ``l_returnflag``; the id is the row number
  over the unique key ``LINEITEM_KEY``.
* Binary labels on part of the rows: ``documents`` × ``labels.quality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrad.operators import reshape as R

# Fixed values for the Iris-like mapping of lineitem.
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
# Ties in the key are broken by the other columns that are read, in this order.
LINEITEM_TIES = ["l_discount", "l_quantity", "l_tax", "l_returnflag"]
LINEITEM_FEATURES = [  # (output name, source column, divisor, multiplier)
    ("x1", "l_quantity", 50.0, 1.0),
    ("x2", "l_extendedprice", 105000.0, 1.0),
    ("x3", "l_discount", 1.0, 10.0),
    ("x4", "l_tax", 1.0, 10.0),
]
RETURNFLAG_CLASS = {"A": 0, "N": 1, "R": 2}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- embeddings
def embedding_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per example: ``i`` (1-based), ``x`` ARRAY<DOUBLE>, ``label``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).cast("long").alias("i"),
                    F.transform("embedding", lambda t: t.cast("double")).alias("x"),
                    F.col("label").cast("long").alias("label"))


def embedding_cells(examples: DataFrame) -> DataFrame:
    """Feature cells ``(i, j, v)``."""
    return R.vector_to_coo(examples, "x")


def embedding_one_hot(examples: DataFrame, n_classes: int) -> DataFrame:
    return R.one_hot_coo(examples, "label", n_classes)


# ------------------------------------------------------------------ lineitem
def class_of_returnflag(col="l_returnflag"):
    expr = None
    for flag, cls in RETURNFLAG_CLASS.items():
        expr = (F.when(F.col(col) == flag, F.lit(cls)) if expr is None
                else expr.when(F.col(col) == flag, F.lit(cls)))
    return expr.cast("long")


def lineitem_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key columns, the four raw feature columns as DOUBLE and ``species``."""
    li = table(spark, sf_dir, "lineitem")
    feats = sorted({src for _, src, _, _ in LINEITEM_FEATURES} - set(LINEITEM_KEY))
    return li.select(*LINEITEM_KEY, *[F.col(c).cast("double").alias(c) for c in feats],
                     class_of_returnflag().alias("species"))


def lineitem_scaled_cols():
    return [(F.col(src).cast("double") / F.lit(div) * F.lit(mul)).alias(name)
            for name, src, div, mul in LINEITEM_FEATURES]


def lineitem_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` (dense, key order), ``x1..x4`` scaled, ``species``."""
    raw = lineitem_raw(spark, sf_dir)
    with_id = R.assign_ids(raw, LINEITEM_KEY, "id")
    return with_id.select("id", *lineitem_scaled_cols(), "species")


# --------------------------------------------------------- labelled documents
def document_label_one_hot(spark: SparkSession, sf_dir: str, n_classes: int = 2) -> DataFrame:
    """Binary one-hot over all documents; only labelled ones get a 1 (right
    outer join of the sparse labels onto the document × class grid)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    grid = R.class_grid(docs, n_classes)
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("i"), (F.col("quality") + 1).alias("j"))
    return R.densify(grid, labels)
