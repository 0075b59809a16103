"""Feature files (CSV), the result log and the discard sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column layouts of the two reference inputs.
IRIS_COLUMNS = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
IRIS_LABEL = "species"
MNIST_PIXELS = 784
RESULT_LOG_COLUMNS = ["name", "atts", "limit", "lr", "iter", "execution_time"]
LOG_HEADER_NAME = "Operator"


def iris_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType()) for c in IRIS_COLUMNS]
                        + [T.StructField(IRIS_LABEL, T.IntegerType())])


def mnist_schema(n_pixels: int = MNIST_PIXELS) -> T.StructType:
    return T.StructType([T.StructField("label", T.DoubleType())]
                        + [T.StructField(f"pixel{k}", T.DoubleType()) for k in range(1, n_pixels + 1)])


def read_features(spark: SparkSession, path: str, schema: T.StructType,
                  header: bool = True, sep: str = ",") -> DataFrame:
    """CSV feature file with a fixed schema (never inferred)."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, mode="FAILFAST")


def write_features(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def run_noop(df: DataFrame) -> None:
    """Run the full plan and discard the rows (timing without a result sink)."""
    df.write.format("noop").mode("overwrite").save()


def result_log_schema(extra: str | None = None) -> T.StructType:
    fields = [T.StructField("name", T.StringType()), T.StructField("atts", T.IntegerType()),
              T.StructField("limit", T.IntegerType()), T.StructField("lr", T.DoubleType()),
              T.StructField("iter", T.IntegerType()), T.StructField("execution_time", T.DoubleType())]
    if extra:
        fields.append(T.StructField(extra, T.DoubleType()))
    return T.StructType(fields)


def log_result(spark: SparkSession, row: dict, path: str) -> None:
    """Append one result row to a CSV log folder."""
    extra = [k for k in row if k not in RESULT_LOG_COLUMNS]
    schema = result_log_schema(extra[0] if extra else None)
    spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema) \
        .coalesce(1).write.mode("append").csv(path, header=False)


def read_result_log(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Read a raw log as strings (header lines may repeat inside the file)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=False)


def merge_logs(logs: Sequence[DataFrame], min_limit: int | None = None,
               threads_col: str | None = None, threads: str | None = None,
               rename: dict | None = None) -> DataFrame:
    """Stack result logs: drop repeated header rows, optionally keep one
    thread setting, project the six common columns and, if asked to, keep
    ``limit >= min_limit`` (rows over the whole table have no limit)."""
    out = None
    for log in logs:
        for old, new in (rename or {}).items():
            if old in log.columns:
                log = log.withColumnRenamed(old, new)
        log = log.filter(F.col("name") != F.lit(LOG_HEADER_NAME)).filter(F.col("name") != F.lit("name"))
        if threads_col and threads is not None and threads_col in log.columns:
            log = log.filter(F.col(threads_col) == F.lit(threads))
        log = log.select(F.col("name"), F.col("atts").cast("int"), F.col("limit").cast("int"),
                         F.col("lr").cast("double"), F.col("iter").cast("int"),
                         F.col("execution_time").cast("double"))
        out = log if out is None else out.unionByName(log)
    return out if min_limit is None else out.filter(F.col("limit") >= F.lit(min_limit))


def scan_log(spark: SparkSession, path: str, columns: Sequence[str] = RESULT_LOG_COLUMNS) -> DataFrame:
    """A result log as it lies there, one row per line: the typed columns,
    ``kind`` (row, header or bad), ``line`` and ``file``.

    Header lines may stand anywhere in a file.  A line with too few or too many
    fields, or with a field of another type, is bad: its text is in ``line``, its
    columns are null.  Blank lines are left out."""
    typed = {f.name: f.dataType for f in result_log_schema().fields}
    ddl = ", ".join(f"`{c}` {typed.get(c, T.DoubleType()).simpleString()}" for c in columns) + ", `_bad` string"
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    parsed = lines.where(F.trim("line") != "").withColumn(
        "_row", F.from_csv("line", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    first = F.trim(F.element_at(F.split("line", ","), 1))
    kind = (F.when(first.isin(LOG_HEADER_NAME, "name"), "header")
            .when(F.col("_row._bad").isNotNull(), "bad").otherwise("row"))
    told = parsed.withColumn("kind", kind)
    return told.select(*[F.when(F.col("kind") == "row", F.col(f"_row.`{c}`")).alias(c) for c in columns],
                       "kind", "line", "file")


def log_counts(scan: DataFrame) -> DataFrame:
    """Lines per file and kind: ``file, rows, headers, bad``."""
    return scan.groupBy("file").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(n)
                                      for k, n in (("row", "rows"), ("header", "headers"), ("bad", "bad"))])


def merge_scans(scans: Sequence[DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """The rows of several scanned logs (no headers, no bad lines): the six
    common columns and those of ``keep``, null in a log without them."""
    out = None
    for scan in scans:
        rows = scan.where(F.col("kind") == "row").select(
            *RESULT_LOG_COLUMNS, *[(F.col(c) if c in scan.columns else F.lit(None).cast("double")).alias(c) for c in keep])
        out = rows if out is None else out.unionByName(rows)
    return out
