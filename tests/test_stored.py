"""Stored models, bucketed cells, the SQL script, table functions and logs."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cellgrad.functions.scalar import register_table_functions
from cellgrad.operators import coo
from cellgrad.operators import weights as W
from cellgrad.plans import catalog as K
from cellgrad.plans.relational import Net, step_gradient, train_relational
from cellgrad.plans.script import train_script
from cellgrad.operators.weights import HO, XH, unstack
from cellgrad.session import VersionStore, drop_tables, loop_settings, materialize, settings, written_tables
from cellgrad.sources import buckets as BK
from cellgrad.sources import files as FI
from cellgrad.sources.models import ModelStore

from conftest import SF001
from test_plans import plan, shuffles


def new(name):
    return tempfile.mkdtemp(prefix=f"cg-{name}-") + "/t"


def model(spark, w_id, v=1.0):
    return spark.createDataFrame([(w_id, 0, 1, 1, v), (w_id, 1, 1, 1, -v)], "w_id long, id long, i long, j long, v double")


# ------------------------------------------------------------------ models
def test_a_repeated_append_adds_nothing(spark):
    store = ModelStore(spark, new("models"))
    assert store.appends() == [] and store.read().count() == 0
    assert store.append(model(spark, 1), "a") is True
    assert store.append(model(spark, 1, 9.0), "a") is False
    assert store.append(model(spark, 2).unionByName(model(spark, 3)), "b") is True
    assert store.appends() == ["a", "b"]
    assert sorted(map(tuple, store.read().collect())) == sorted(
        (k, m, 1, 1, v) for k in (1, 2, 3) for m, v in ((0, 1.0), (1, -1.0)))


def test_a_half_written_append_is_not_read_and_is_written_over(spark):
    path = new("models")
    store = ModelStore(spark, path)
    # The writer stopped before its marker.
    model(spark, 7, 5.0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .partitionBy("w_id").parquet(f"{path}/part=a")
    assert store.appends() == [] and store.read().count() == 0
    assert store.append(model(spark, 7), "a") is True
    assert sorted(r["v"] for r in store.read().collect()) == [-1.0, 1.0]


def test_wanted_models_with_repeats_nulls_and_unknown_ids(spark):
    store = ModelStore(spark, new("models"))
    store.append(model(spark, 1).unionByName(model(spark, 2)), "a")
    ids = spark.createDataFrame([(2,), (2,), (None,), (99,)], "w_id int")
    assert {r["w_id"] for r in store.wanted(ids).collect()} == {2}
    assert store.wanted(ids).count() == 2
    with pytest.raises(ValueError):
        store.append(model(spark, 3), "../x")


def test_wanted_models_prune_the_folders_of_others(spark):
    store = K.stored_models(spark, K.Emb(spark, SF001), new("models"))
    text = plan(store.wanted(K.wanted_regions(spark, SF001)))
    assert "dynamicpruning" in text
    assert "PartitionFilters" in text


# ------------------------------------------------------------------ buckets
def test_bucketed_cells_need_no_exchange(spark):
    e = K.Emb(spark, SF001)
    x = BK.write_cells(e.x, new("cells"), "t_cells_x", 4)
    y = BK.write_cells(e.y, new("cells"), "t_cells_y", 4)
    try:
        with loop_settings(spark):
            assert shuffles(plan(coo.hadamard(x, x))) == 0
            g = step_gradient(x, y, unstack(e.w0, XH), unstack(e.w0, HO), e.net)
            assert shuffles(plan(g)) == 1  # the final sum
    finally:
        spark.sql("DROP TABLE t_cells_x")
        spark.sql("DROP TABLE t_cells_y")


def test_bucketed_cells_attach_in_another_session(spark):
    e = K.Emb(spark, SF001)
    path = new("cells")
    BK.write_cells(e.x, path, "t_cells_a", 4)
    spark.sql("DROP TABLE t_cells_a")
    other = spark.newSession()
    x = BK.attach_cells(other, path, "t_cells_b", 4)
    try:
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, e.x.select("i", "j", "v").collect()))
        with loop_settings(other):
            assert shuffles(plan(coo.hadamard(x, x))) == 0
    finally:
        other.sql("DROP TABLE t_cells_b")


# ------------------------------------------------------------------- script
def test_script_equals_the_loop_and_leaves_no_names(spark):
    x = spark.createDataFrame([(i, j, ((i * 7 + j * 3) % 11) / 11.0) for i in range(1, 13) for j in (1, 2, 3)],
                              "i long, j long, v double")
    y = spark.createDataFrame([(i, j, int(i % 2 + 1 == j)) for i in range(1, 13) for j in (1, 2)], "i long, j long, v int")
    net = Net(3, 4, 2)
    w0 = W.stack(W.init_coo(spark, 3, 4), W.init_coo(spark, 4, 2)).drop("iter")
    before = {t.name for t in spark.catalog.listTables()}
    a = train_script(x, y, w0, net, 0.1, 3)
    b = train_relational(x, y, w0, net, 0.1, 3)
    key = lambda d: {tuple(r)[:4]: r["v"] for r in d.collect()}
    got, want = key(a), key(b)
    assert got.keys() == want.keys() and len(got) == 4 * net.cells
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert {t.name for t in spark.catalog.listTables()} == before
    with pytest.raises(ValueError):
        train_script(x, y, w0, Net(3, 4, 2, "tanh_softmax"), 0.1, 1)


def test_script_without_examples_has_the_start_only(spark):
    x = spark.createDataFrame([], "i long, j long, v double")
    w0 = W.stack(W.init_coo(spark, 2, 2), W.init_coo(spark, 2, 2)).drop("iter")
    out = train_script(x, x, w0, Net(2, 2, 2), 0.1, 2)
    assert {r["iter"] for r in out.collect()} == {0} and out.count() == 8


# ---------------------------------------------------------- table functions
def test_table_functions_over_odd_bounds(spark):
    register_table_functions(spark)
    rows = spark.createDataFrame([(1, 2, 3), (2, 0, 3), (3, None, 3), (4, 1, -1), (5, 3, 1)], "k long, r long, c long")
    rows.createOrReplaceTempView("t_bounds")
    row = spark.sql("SELECT b.k, g.j FROM t_bounds b, LATERAL index_row(b.r) g")
    assert sorted(map(tuple, row.collect())) == [(1, 1), (1, 2), (4, 1), (5, 1), (5, 2), (5, 3)]
    grid = spark.sql("SELECT b.k, g.i, g.j FROM t_bounds b, LATERAL index_grid(b.r, b.c) g")
    assert sorted(map(tuple, grid.collect())) == sorted(
        [(1, i, j) for i in (1, 2) for j in (1, 2, 3)] + [(5, i, 1) for i in (1, 2, 3)])
    for q in (row, grid):
        assert "Join" not in plan(q) and shuffles(plan(q)) == 0


# --------------------------------------------------------------------- logs
LOG = """name,atts,limit,lr,iter,execution_time,accuracy
a,20,150,0.01,10,0.64,0.6
name,atts,limit,lr,iter,execution_time,accuracy

a,20,150,0.01
a,twenty,150,0.01,10,0.64,0.6
a,20,,0.01,10,0.64,0.7
a,20,150,0.01,10,0.64,0.6,9
"""


def test_log_scan_tells_rows_headers_and_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="cg-log-")
    with open(f"{d}/one.csv", "w") as f:
        f.write(LOG)
    with open(f"{d}/two.csv", "w") as f:
        f.write("Operator,atts,size,lr,iter,execution_time,accuracy\nb,8,7,0.5,1,2.5,0.1\n")
    scan = FI.scan_log(spark, d, FI.RESULT_LOG_COLUMNS + ["accuracy"])
    counts = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["headers"], r["bad"]) for r in FI.log_counts(scan).collect()}
    assert counts == {"one.csv": (2, 2, 3), "two.csv": (1, 1, 0)}
    bad = scan.where("kind = 'bad'")
    assert sorted(r["line"] for r in bad.collect()) == [
        "a,20,150,0.01", "a,20,150,0.01,10,0.64,0.6,9", "a,twenty,150,0.01,10,0.64,0.6"]
    assert bad.where(F.col("atts").isNotNull()).count() == 0
    six = FI.scan_log(spark, f"{d}/two.csv", FI.RESULT_LOG_COLUMNS + ["accuracy"]).drop("accuracy")
    merged = FI.merge_scans([scan, six], ["accuracy"]).collect()
    assert sorted((r["name"], r["limit"] or 0, r["accuracy"] or 0.0) for r in merged) == [
        ("a", 0, 0.7), ("a", 150, 0.6), ("b", 7, 0.0), ("b", 7, 0.1)]


# -------------------------------------------------------- intermediate tables
def test_written_tables_are_listed_and_dropped(spark):
    with written_tables() as outer:
        first = materialize(spark.range(5), "first")
        with written_tables() as inner:
            second = materialize(spark.range(7), "second")
    materialize(spark.range(1), "not listed")
    assert [len(outer), len(inner)] == [1, 1] and "first-" in outer[0] and "second-" in inner[0]
    drop_tables(spark, [*inner, *inner])  # a folder that is gone is no error
    assert first.count() == 5 and spark.read.parquet(outer[0]).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner[0])
    assert second.columns == ["id"]


def test_a_version_is_not_summed_by_the_task_that_writes_it(spark):
    """The final aggregate stays on the shuffle's own tasks, one partition each."""
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}):
        summed = spark.range(0, 70, 1, 7).selectExpr("0L AS id", "id AS i", "1L AS j").groupBy("id", "i", "j").agg(F.count("*").alias("n"))
        store = VersionStore(spark)
        kept = store.write(0, summed.select("id", "i", "j", F.spark_partition_id().cast("double").alias("v")), 70)
    rows = kept.collect()
    assert sorted(r["i"] for r in rows) == list(range(70)) and len({r["v"] for r in rows}) == 7
    assert len(kept.inputFiles()) == 1


def test_a_log_is_not_summed_by_the_task_that_writes_it(spark):
    """What the one writing task reads are lines, not the shares' aggregate."""
    hist = spark.createDataFrame([(k, hit, n) for k in range(20) for hit, n in ((True, 3), (False, 1))],
                                 "id long, correct boolean, count long")
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}):
        lines = K._log_run(hist, "run", 0.5)
        assert "Aggregate" not in plan(lines.coalesce(1))
    assert sorted(r["line"] for r in lines.collect()) == sorted(f"run,{K.H},0,0.5,{k},0.5,0.75" for k in range(20))
