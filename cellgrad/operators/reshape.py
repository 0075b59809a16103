"""Reshaping between wide tables, cell tables and array rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrad.functions import arrays as A
from cellgrad.session import CELL_ROW_BYTES, bounded_broadcast, materialize, partitions_for, shuffle_partitions

_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


def assign_ids(df: DataFrame, order_cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """Dense ids 1..N in the order of ``order_cols`` (row_number over a total
    order) without funnelling the data through one task.

    The rows are range partitioned and sorted by the key, then by all other
    columns, so ties get the same ids on any cluster; within a sorted partition
    ``monotonically_increasing_id`` numbers rows in order.  The sorted rows are
    written out once, so the counts and the numbering see the same partitions,
    also after a lost executor.  A tiny per-partition count table gives each
    partition its offset, which is broadcast back (its size is bounded by the
    number of partitions).
    """
    rest = [c for c, t in df.dtypes if c not in order_cols and not t.startswith(("map", "variant"))]
    ordered = df.orderBy(*order_cols, *rest)
    mid = F.monotonically_increasing_id()
    tagged = materialize(ordered.withColumn("_pid", F.shiftright(mid, _POS_BITS))
                         .withColumn("_pos", mid.bitwiseAND(F.lit((1 << _POS_BITS) - 1))), "ordered")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # A range shuffle yields at most spark.sql.shuffle.partitions partitions
    # (AQE only merges them), so the offset table has a proven bound.
    offsets = bounded_broadcast(offsets, shuffle_partitions(df.sparkSession), row_bytes=32)
    return (tagged.join(offsets, "_pid")
            .select((F.col("_off") + F.col("_pos") + F.lit(1)).cast("long").alias(id_col), *df.columns))


def to_coo(df: DataFrame, id_col: str, cols: Sequence[str], div: float = 1.0,
           add: float = 0.0) -> DataFrame:
    """Wide -> cells in one pass: one row per (example, feature), j 1-based."""
    packed = df.select(F.col(id_col).cast("long").alias("i"),
                       A.pack(cols, div, add).alias("_x"))
    return vector_to_coo(packed, "_x")


def vector_to_coo(df: DataFrame, vec_col: str, id_col: str = "i") -> DataFrame:
    """Array column -> cells ``(i, j, v)`` with j = position + 1."""
    return (df.select(F.col(id_col).cast("long").alias("i"),
                      F.posexplode(F.col(vec_col)).alias("_p", "_v"))
            .select("i", (F.col("_p") + 1).cast("long").alias("j"),
                    F.col("_v").cast("double").alias("v")))


def matrix_to_coo(df: DataFrame, mat_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Nested array column -> cells ``(*keys, i, j, v)``, both 1-based."""
    rows = df.select(*keys, F.posexplode(F.col(mat_col)).alias("_r", "_row"))
    return (rows.select(*keys, "_r", F.posexplode("_row").alias("_p", "_v"))
            .select(*keys, (F.col("_r") + 1).cast("long").alias("i"),
                    (F.col("_p") + 1).cast("long").alias("j"),
                    F.col("_v").cast("double").alias("v")))


def to_array(df: DataFrame, id_col: str, cols: Sequence[str], div: float = 1.0,
             add: float = 0.0, alias: str = "x") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("i"), A.pack(cols, div, add).alias(alias))


def class_grid(examples: DataFrame, n_classes: int, id_col: str = "i") -> DataFrame:
    """Index grid (example i) × (class 1..n): one generator per example row,
    no cross join; the work grows with the number of examples."""
    return examples.select(
        F.col(id_col).cast("long").alias("i"),
        F.explode(F.sequence(F.lit(1), F.lit(n_classes))).alias("j")
    ).select("i", F.col("j").cast("long").alias("j"))


def one_hot_coo(examples: DataFrame, label_col: str, n_classes: int,
                id_col: str = "i", label_offset: int = 1) -> DataFrame:
    """One-hot cells ``(i, j, v, dummy)``: v = 1 at class ``label+offset``,
    0 elsewhere; dummy = 1 at the label, NULL elsewhere.  A NULL label has no
    cells (unlabelled), one outside the classes only zeros.  Built from the
    example rows themselves, so no join is needed when labels sit on the
    example."""
    lab = (F.col(label_col).cast("long") + F.lit(label_offset))
    rows = examples.where(lab.isNotNull()).select(F.col(id_col).cast("long").alias("i"), lab.alias("_lab"),
                           F.explode(F.sequence(F.lit(1), F.lit(n_classes))).alias("_j"))
    hit = F.col("_j").cast("long") == F.col("_lab")
    return rows.select("i", F.col("_j").cast("long").alias("j"),
                       F.when(hit, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("v"),
                       F.when(hit, F.lit(1)).cast("long").alias("dummy"))


def densify(grid: DataFrame, labels: DataFrame) -> DataFrame:
    """Right outer join of sparse label cells ``(i, j)`` onto a full grid:
    ``v = coalesce(label, 0)``, ``dummy`` = 1 or NULL.

    Written as the inner join plus the grid cells without a label: a label
    repeated for one hot example is then a plain inner-join side, which AQE
    splits (a right outer join's left side it cannot), and the result equals
    the right outer join row for row."""
    cell = ["i", "j"]
    grid = grid.select(*cell)
    lab = labels.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    one = F.lit(1).cast("long")
    hit = grid.join(lab, cell).select(*cell, one.alias("v"), one.alias("dummy"))
    rest = grid.join(lab.distinct(), cell, "left_anti").select(
        *cell, F.lit(0).cast("long").alias("v"), F.lit(None).cast("long").alias("dummy"))
    return hit.unionByName(rest)


def matrix_avg(df: DataFrame, mat_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Cell-wise mean ``(*by, i, j, v)`` of a nested-array column per group; a
    NULL cell does not count, rows may differ in shape.

    Each row's matrix is one vector, and the summariser adds vectors up inside
    the partitions: no row per cell before the aggregate, and one vector per
    group, shape and partition after it.  Cells come out of the sums only."""
    by = list(by)
    flat = F.flatten(mat_col)
    present = F.transform(flat, lambda c: c.isNotNull().cast("double"))
    filled = F.transform(flat, lambda c: F.coalesce(c.cast("double"), F.lit(0.0)))
    shape = F.transform(mat_col, lambda r: F.size(r))
    rows = df.where(F.forall(mat_col, lambda r: r.isNotNull()) & (F.size(flat) > 0))
    sums = rows.groupBy(*by, shape.alias("_shape")).agg(
        Summarizer.sum(array_to_vector(filled)).alias("_s"), Summarizer.sum(array_to_vector(present)).alias("_n"))
    places = F.flatten(F.transform("_shape", lambda n, r: F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda c: F.struct((r + 1).cast("long").alias("i"), c.cast("long").alias("j")))))
    cells = sums.select(*by, F.explode(F.arrays_zip(places.alias("at"), vector_to_array("_s").alias("s"),
                                                    vector_to_array("_n").alias("n"))).alias("_c"))
    total = F.sum("_c.n")
    return (cells.groupBy(*by, F.col("_c.at.i").alias("i"), F.col("_c.at.j").alias("j"))
            .agg(F.when(total > 0, F.sum("_c.s") / F.when(total > 0, total)).alias("v")))


def coo_to_array(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells ``(*keys, i, j, v)`` -> one nested array per key, rows and columns
    in index order (sorted explicitly; ``collect_list`` alone has no order).
    Meant for models: each group is one matrix of bounded size, gathered
    into one row — never use it on an example-sized matrix."""
    keys = list(keys)
    rows = (cells.groupBy(*keys, "i")
            .agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("_cells"))
            .select(*keys, "i", F.transform("_cells", lambda c: c["v"]).alias("_row")))
    return (rows.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("i", "_row"))).alias("_rows"))
            .select(*keys, F.transform("_rows", lambda r: r["_row"]).alias("m")))


def first_rows(cells: DataFrame, limit: int, strict: bool = True) -> DataFrame:
    """Training subset by id: ``i < limit`` (strict, as the recorded queries
    do, so ``limit`` - 1 examples train) or ``i <= limit``."""
    cond = F.col("i") < F.lit(limit) if strict else F.col("i") <= F.lit(limit)
    return cells.filter(cond)


def limit_examples(examples: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """The first n examples in key order (a top-n report: sort + limit, which
    Spark runs as a per-partition top-n followed by a merge of n rows each)."""
    return examples.orderBy(*order_cols).limit(n)


def replicate(df: DataFrame, k: int, copy_col: str = "copy") -> DataFrame:
    """Each row k times (the scaled load), tagged with its copy number 1..k.
    A generator per row: narrow, no join, no shuffle."""
    return df.select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias(copy_col), "*")


def partition_examples(df: DataFrame, n_partitions: int | None = None,
                       id_col: str = "i") -> DataFrame:
    """Hash partition rows (example rows or their cells) by example id.

    Apply it to the *cells*: a generator (posexplode) does not report its
    input's partitioning, so cells exploded from partitioned rows would be
    shuffled again by the first (i, j) aggregate.  With the cells of ``x`` and
    ``y`` partitioned by ``i`` into the same number of partitions, every
    product with a broadcast weight matrix, every (i, j) aggregate and every
    cell-wise join is exchange-free; only contractions over examples shuffle,
    and those only their partial sums.  Rows are sorted within a partition, so
    a cached side is joined on the id without sorting again.  Without a given
    number the partitions follow from the number of rows, which is counted."""
    n = n_partitions or partitions_for(df.count(), CELL_ROW_BYTES, df.sparkSession)
    return df.repartition(n, F.col(id_col)).sortWithinPartitions(*[c for c in (id_col, "j") if c in df.columns])
