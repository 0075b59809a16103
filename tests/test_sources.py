"""CSV features, replicated load, ids, literal matrices, result logs."""

import tempfile

from pyspark.sql import functions as F

from cellgrad.operators import reshape as R
from cellgrad.operators import weights as W
from cellgrad.sources import files


def test_csv_round_trip_with_and_without_header(spark):
    rows = [(5.1, 3.5, 1.4, 0.2, 0), (7.0, 3.2, 4.7, 1.4, 1), (6.3, 3.3, 6.0, 2.5, 2)]
    df = spark.createDataFrame(rows, files.iris_schema())
    d = tempfile.mkdtemp(prefix="cg-csv-")
    files.write_features(df, f"{d}/h", header=True)
    files.write_features(df, f"{d}/n", header=False)
    a = files.read_features(spark, f"{d}/h", files.iris_schema(), header=True)
    b = files.read_features(spark, f"{d}/n", files.iris_schema(), header=False)
    assert sorted(a.collect()) == sorted(df.collect()) == sorted(b.collect())
    assert len(files.mnist_schema().fields) == 785


def test_replicate_and_dense_ids(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(50)], "a long, b long")
    rep = R.replicate(df, 3)
    assert rep.count() == 150
    assert sorted(r["copy"] for r in rep.select("copy").distinct().collect()) == [1, 2, 3]
    ids = R.assign_ids(df.repartition(5), ["a", "b"], "id").orderBy("id").collect()
    assert [r["id"] for r in ids] == list(range(1, 51))
    assert [(r["a"], r["b"]) for r in ids] == sorted((k % 7, k) for k in range(50))


def test_literal_matrix_text(spark):
    df = spark.createDataFrame([("[[1.5, -2.0], [0.25, 4.0]]",)], "text string")
    m = W.weights_from_json(df, "text").first()["m"]
    assert m == [[1.5, -2.0], [0.25, 4.0]]


def test_merge_result_logs(spark):
    cols = ["name", "atts", "limit", "lr", "iter", "execution_time", "accuracy"]
    a = spark.createDataFrame([("name", "atts", "limit", "lr", "iter", "execution_time", "accuracy"),
                               ("DuckDB-SQL-92", "20", "150", "0.01", "10", "0.64", "0.6"),
                               ("DuckDB-SQL-92", "20", "2", "0.01", "10", "0.1", "0.3")], cols)
    b = spark.createDataFrame([("Operator", "20", "150", "0.2", "10", "0.002", "x"),
                               ("numpy", "50", "300", "0.2", "100", "0.01", "x")],
                              ["name", "atts", "size", "lr", "iter", "execution_time", "error"])
    merged = files.merge_logs([a, b], rename={"size": "limit"})
    got = sorted((r["name"], r["limit"]) for r in merged.collect())
    assert got == [("DuckDB-SQL-92", 2), ("DuckDB-SQL-92", 150), ("numpy", 300)]
    few = files.merge_logs([a, b], min_limit=3, rename={"size": "limit"})
    assert sorted(r["limit"] for r in few.collect()) == [150, 300]


def test_noop_sink_runs_plan(spark):
    files.run_noop(spark.range(10).withColumn("x", F.col("id") * 2))


def test_result_log_append_and_read(spark):
    d = tempfile.mkdtemp(prefix="cg-log-")
    files.log_result(spark, {"name": "cellgrad", "atts": 8, "limit": 101, "lr": 0.01, "iter": 3,
                             "execution_time": 1.5, "accuracy": 0.108}, f"{d}/log")
    files.log_result(spark, {"name": "cellgrad", "atts": 8, "limit": 101, "lr": 0.01, "iter": 4,
                             "execution_time": 2.5, "accuracy": 0.09}, f"{d}/log")
    log = files.read_result_log(spark, f"{d}/log", files.RESULT_LOG_COLUMNS + ["accuracy"])
    merged = files.merge_logs([log])
    assert sorted(r["iter"] for r in merged.collect()) == [3, 4]


def test_model_store_partition_pruning(spark):
    import io
    from contextlib import redirect_stdout
    d = tempfile.mkdtemp(prefix="cg-store-")
    sizes = spark.createDataFrame([(2,), (3,)], "w_id long").selectExpr("w_id", "w_id AS _r", "2 AS _c")
    ho = W.weight_cells(sizes, keep=["w_id"])
    W.write_store(ho, f"{d}/store")
    one = W.read_model(spark, f"{d}/store", 3)
    assert one.count() == 3 * 2
    buf = io.StringIO()
    with redirect_stdout(buf):
        one.explain("formatted")
    assert "PartitionFilters: [isnotnull(w_id" in buf.getvalue()
