"""Cells stored bucketed and sorted by example id.

Joins on the example id, aggregates by it and rank windows within it need no
exchange on such a table, in any query and any session that attaches it: the
shuffle is paid when the table is written.  The folder's name holds the number of
buckets, so a table cannot be attached with another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrad.session import CELL_ROW_BYTES, partitions_for

COLUMNS = "i BIGINT, j BIGINT, v DOUBLE"


def buckets_for(rows: int, spark: SparkSession) -> int:
    """Buckets of about one task's bytes; tables that are joined take one number."""
    return partitions_for(rows, CELL_ROW_BYTES, spark)


def folder(path: str, buckets: int) -> str:
    return f"{path.rstrip('/')}-i{int(buckets)}"


def write_cells(cells: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """Writes ``(i, j, v)`` as the table ``name``, one file per bucket, sorted by
    (i, j).  Example ids are many and a row's cells few, so no bucket is hot."""
    placed = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
                          F.col("v").cast("double").alias("v"))
    (placed.repartition(buckets, "i").write.format("parquet").mode("overwrite")
     .bucketBy(buckets, "i").sortBy("i", "j").option("path", folder(path, buckets)).saveAsTable(name))
    return cells.sparkSession.table(name)


def attach_cells(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    """The table that another session wrote, under ``name`` in this one."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet "
              f"CLUSTERED BY (i) SORTED BY (i, j) INTO {int(buckets)} BUCKETS LOCATION '{folder(path, buckets)}'")
    return spark.table(name)
