"""End-to-end job on a CSV feature file (Iris-shaped, hand-made rows)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cellgrad.plans import jobs
from cellgrad.plans.relational import Net
from cellgrad.sources import files


def _iris_like(spark):
    rows = []
    for k in range(30):
        c = k % 3
        rows.append((4.5 + c + 0.01 * k, 3.0 + 0.2 * c, 1.4 + 2 * c + 0.01 * k, 0.2 + 0.8 * c, c))
    d = tempfile.mkdtemp(prefix="cg-job-")
    files.write_features(spark.createDataFrame(rows, files.iris_schema()), f"{d}/iris.csv")
    return files.read_features(spark, f"{d}/iris.csv", files.iris_schema(), header=True), d


def test_relational_and_array_jobs_agree(spark):
    df, d = _iris_like(spark)
    x, y, rows = jobs.prepare(df, files.IRIS_COLUMNS, files.IRIS_LABEL, 3, div=10.0, copies=2)
    assert x.count() == 2 * 30 * 4
    net = Net(4, 5, 3)
    rel = jobs.train_and_score(x, y, rows, net, 0.05, 3, encoding="relational", reduction="mean", seed=3)
    arr = jobs.train_and_score(x, y, rows, net, 0.05, 3, encoding="array", reduction="mean", seed=3,
                               w0=rel["history"].filter("iter = 0").drop("iter"))
    a = sorted((r["iter"], r["id"], r["i"], r["j"], round(r["v"], 9)) for r in rel["history"].collect())
    b = sorted((r["iter"], r["id"], r["i"], r["j"], round(r["v"], 9)) for r in arr["history"].collect())
    assert a == b
    assert 0 < rel["precision"] <= 1


def test_sweep_writes_result_log(spark):
    df, d = _iris_like(spark)
    x, y, rows = jobs.prepare(df, files.IRIS_COLUMNS, files.IRIS_LABEL, 3, div=10.0)
    out = jobs.sweep(x, y, rows, 4, 3, [{"atts": 4, "limit": 20, "lr": 0.1, "iter": 2},
                                         {"atts": 6, "limit": 31, "lr": 0.1, "iter": 1}],
                     "cellgrad-relational", f"{d}/log")
    assert [r["atts"] for r in out] == [4, 6]
    log = files.read_result_log(spark, f"{d}/log", files.RESULT_LOG_COLUMNS + ["accuracy"])
    assert log.count() == 2


@pytest.mark.parametrize("cap", [1, 10_000, 256 << 20])
def test_array_job_is_the_same_at_any_cap(spark, cap):
    """A rank tie counts twice for the cells and once for the arrays: the
    array job has to stay an array job past the cap."""
    df, d = _iris_like(spark)
    x, y, rows = jobs.prepare(df, files.IRIS_COLUMNS, files.IRIS_LABEL, 3, div=10.0)
    net = Net(4, 5, 3)
    tied = jobs.initial_weights(spark, net, 3).withColumn("v", F.expr("IF(id = 1, 0D, v)"))
    spark.conf.set("cellgrad.broadcast.maxBytes", str(cap))
    try:
        still = jobs.train_and_score(x, y, rows, net, 0.05, 0, encoding="array", w0=tied)
        run = jobs.train_and_score(x, y, rows, net, 0.05, 2, encoding="array", seed=3)
    finally:
        spark.conf.unset("cellgrad.broadcast.maxBytes")
    assert still["precision"] == 10 / 30  # the first of three tied classes
    total = run["history"].where("iter = 2").agg(F.round(F.sum("v"), 9)).first()[0]
    want = jobs.train_and_score(x, y, rows, net, 0.05, 2, encoding="array", seed=3)
    assert total == want["history"].where("iter = 2").agg(F.round(F.sum("v"), 9)).first()[0]
    assert run["precision"] == want["precision"]
    jobs.release(x, y)


def test_label_kinds_train_alike(spark):
    """NULL labels do not train, an extra class and one out of range do,
    with the targets the outputs have; both trainers agree."""
    ex = spark.createDataFrame([(1, 0.5, 0.2, 0), (2, 0.9, 0.4, None), (3, 0.1, 0.8, 2), (4, 0.7, 0.3, 7),
                                (5, 0.2, 0.6, 1)], "id long, a double, b double, label int")
    x, y, rows = jobs.prepare(ex, ["a", "b"], "label", 3, id_col="id")
    net = Net(2, 3, 2)
    runs = [jobs.train_and_score(x, y, rows, net, 0.3, 2, encoding=e, reduction="mean", seed=5)["history"]
            for e in ("relational", "array")]
    a, b = (sorted((r["iter"], r["id"], r["i"], r["j"], round(r["v"], 9)) for r in h.collect()) for h in runs)
    assert a == b and len(a) == 3 * net.cells
    without = jobs.prepare(ex.where("label IS NOT NULL"), ["a", "b"], "label", 3, id_col="id")
    c = jobs.train_and_score(*without, net, 0.3, 2, encoding="relational", reduction="mean", seed=5)["history"]
    assert sorted((r["iter"], r["id"], r["i"], r["j"], round(r["v"], 9)) for r in c.collect()) == a


def test_long_run_reads_one_history(spark):
    df, d = _iris_like(spark)
    x, y, rows = jobs.prepare(df.limit(6), files.IRIS_COLUMNS, files.IRIS_LABEL, 3, div=10.0)
    hist = jobs.train_and_score(x, y, rows, Net(4, 2, 3), 0.1, 100, encoding="array", seed=1)["history"]
    assert hist.select("iter").distinct().count() == 101
    assert hist._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
