"""Tiles, sweeps, mini-batches, sparse cells, resumed runs, matrix means."""

import random

import pytest
from pyspark.sql import functions as F

from cellgrad.operators import coo
from cellgrad.operators import reshape as R
from cellgrad.operators import tiles as T
from cellgrad.operators import weights as W
from cellgrad.plans import minibatch as MB
from cellgrad.plans import tiled as TL
from cellgrad.operators.weights import HO, XH, unstack
from cellgrad.plans import evaluate as E
from cellgrad.plans.relational import Net, forward, step_gradient, train_relational, update

CELL = "i long, j long, v double"


def matrix(spark, rows, cols, seed, keep=1.0):
    r = random.Random(seed)
    return spark.createDataFrame([(i, j, r.uniform(-1, 1)) for i in range(1, rows + 1) for j in range(1, cols + 1)
                                  if r.random() < keep], CELL)


def cells(df, *keys):
    return {tuple(r[k] for k in (*keys, "i", "j")): r["v"] for r in df.collect()}


def close(a, b, tol=1e-10):
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= tol for k in a)


def examples(spark, n=23, d=5, c=3, seed=1):
    r = random.Random(seed)
    x = matrix(spark, n, d, seed)
    labels = spark.createDataFrame([(i, r.randrange(c) if i % 6 else None) for i in range(1, n + 1)], "i long, label int")
    return x, R.one_hot_coo(labels, "label", c)


def start(spark, d, h, c, seed=3):
    return W.stack(W.init_coo(spark, d, h, seed=seed), W.init_coo(spark, h, c, seed=seed + 1)).drop("iter")


def test_tile_products_equal_cell_products(spark):
    a, b, c = matrix(spark, 9, 7, 1, 0.7), matrix(spark, 7, 6, 2, 0.7), matrix(spark, 9, 3, 3, 0.7)
    tile = {k: T.to_tiles(m) for k, m in (("a", a), ("b", b), ("c", c))}
    dense = lambda df, rows, cols: {(i, j): cells(df).get((i, j), 0.0)
                                    for i in range(1, rows + 1) for j in range(1, cols + 1)}
    close(cells(T.to_cells(T.matmul(tile["a"], tile["b"]), rows=9, cols=6)), dense(coo.matmul(a, b), 9, 6))
    close(cells(T.to_cells(T.matmul(tile["a"], tile["b"], b_bound=4), rows=9, cols=6)), dense(coo.matmul(a, b), 9, 6))
    close(cells(T.to_cells(T.matmul_at(tile["a"], tile["c"]), rows=7, cols=3)), dense(coo.matmul_at(a, c), 7, 3))
    close(cells(T.to_cells(T.matmul_bt(tile["a"], tile["a"]), rows=9, cols=9)), dense(coo.matmul_bt(a, a), 9, 9))
    close(cells(T.to_cells(T.hadamard(tile["a"], tile["a"]), rows=9, cols=7)), dense(coo.hadamard(a, a), 9, 7))
    assert tile["a"].count() == T.tiles_in(9, 7) == 6  # 44 or so cells
    close(cells(T.to_cells(T.to_tiles(a, fill=None))), cells(a))
    assert T.to_tiles(a.where("false")).count() == 0


@pytest.mark.parametrize("preset, limit, how", [("sigmoid", 15, "sum"), ("tanh_softmax", None, "mean")])
def test_tiled_training_equals_cell_training(spark, preset, limit, how):
    x, y = examples(spark)
    net = Net(5, 6, 3, preset)
    w0 = start(spark, 5, 6, 3)
    a = train_relational(x, y, w0, net, 0.1, 2, limit, how)
    b = TL.train_tiled(x, y, w0, net, 0.1, 2, limit, how)
    close(cells(a, "iter", "id"), cells(b, "iter", "id"))


def test_a_sweep_equals_its_single_runs(spark):
    x, y = examples(spark)
    settings = [TL.Setting(1, 6, 0.1, 3), TL.Setting(2, 3, 0.2, 1, 10), TL.Setting(7, 5, 0.05, 2, 18)]
    w0 = None
    for s in settings:
        w = W.tag(start(spark, 5, s.n_hidden, 3, s.w_id), w_id=s.w_id)
        w0 = w if w0 is None else w0.unionByName(w)
    got = TL.train_sweep(x, y, w0, settings, 5, 3, reduction="mean").persist()
    assert {(r["w_id"], r["n"]) for r in got.groupBy("w_id").agg(F.max("iter").alias("n")).collect()} == {(1, 3), (2, 1), (7, 2)}
    for s in settings:
        one = train_relational(x, y, w0.where(f"w_id = {s.w_id}").drop("w_id"), Net(5, s.n_hidden, 3), s.lr, s.steps, s.limit, "mean")
        close(cells(got.where(f"w_id = {s.w_id}"), "iter", "id"), cells(one, "iter", "id"))
    with pytest.raises(ValueError):
        TL.train_sweep(x, y, w0, [settings[0]] * 2, 5, 3)


def test_batches_slide_and_wrap(spark):
    x, y = examples(spark)  # 23 rows: batches of 10, 10 and 3
    net, w0 = Net(5, 4, 3), start(spark, 5, 4, 3)
    store = MB.ExampleStore(x, y, 10)
    assert (store.rows, store.batches) == (23, 3)
    got = MB.train_minibatch(store, w0, net, 0.1, 4)
    w = w0
    for step, (a, b) in enumerate(((1, 10), (11, 20), (21, 23), (1, 10)), 1):
        part = F.col("i").between(a, b)
        h = train_relational(x.where(part), y.where(part), w, net, 0.1, 1, reduction="mean")
        w = h.where("iter = 1").drop("iter")
        close(cells(got.where(f"iter = {step}"), "id"), cells(w, "id"))
    assert MB.train_minibatch(store, w0, net, 0.1).agg(F.max("iter")).first()[0] == 2  # 23 div 10


def test_a_step_reads_one_batch(spark):
    x, y = examples(spark)
    batch = MB.ExampleStore(x, y, 5).cells("x", 2)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(batch" in plan.split("PartitionFilters")[1]
    files = {r[0] for r in batch.select(F.input_file_name()).collect()}
    assert files and all("batch=2" in f for f in files)
    assert batch.agg(F.min("i"), F.max("i")).first()[:] == (11, 15)


def test_sparse_training_equals_dense(spark):
    x, y = examples(spark, d=4)
    zeroed = x.withColumn("v", F.when((F.col("i") + F.col("j")) % 3 == 0, F.col("v")).otherwise(0.0)) \
        .withColumn("v", F.when(F.col("j") == 4, 0.0).otherwise(F.col("v")))  # a feature that never occurs
    net, w0 = Net(4, 4, 3), start(spark, 4, 4, 3)
    dense = train_relational(zeroed, y, w0, net, 0.1, 2)
    for given in (zeroed, zeroed.where("v <> 0")):
        kept = train_relational(given, y, w0, net, 0.1, 2, sparse=True)
        with_cells = {r["i"] for r in zeroed.where("v <> 0").select("i").distinct().collect()}
        assert len(with_cells) == 23
        close(cells(kept, "iter", "id"), cells(dense, "iter", "id"))


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    x, y = examples(spark)
    net, w0 = Net(5, 4, 3), start(spark, 5, 4, 3)
    whole = cells(train_relational(x, y, w0, net, 0.1, 4), "iter", "id")
    path = f"file://{tmp_path}/run"
    train_relational(x, y, w0, net, 0.1, 2, path=path)
    half = tmp_path / "run" / "iter=3"
    half.mkdir()
    (half / "part-00000.parquet").write_bytes(b"half")  # no marker: not complete
    first = (tmp_path / "run" / "iter=2")
    written = {f.name: f.stat().st_mtime_ns for f in first.iterdir()}
    close(cells(train_relational(x, y, w0, net, 0.1, 4, path=path), "iter", "id"), whole)
    assert {f.name: f.stat().st_mtime_ns for f in first.iterdir()} == written  # steps 0 to 2 were not done again
    shorter = cells(train_relational(x, y, w0, net, 0.1, 1, path=path), "iter", "id")
    close(shorter, {k: v for k, v in whole.items() if k[0] <= 1})


def test_matrix_means_of_ragged_and_null_cells(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (1, [[3.0, None], [5.0, 6.0], [7.0]]), (2, None), (2, [[]])],
                               "g int, m array<array<double>>")
    assert cells(R.matrix_avg(df, "m")) == {(1, 1): 2.0, (1, 2): 2.0, (2, 1): 4.0, (2, 2): 5.0, (3, 1): 7.0}
    assert cells(R.matrix_avg(df, "m", ["g"]), "g").keys() == {(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (1, 3, 1)}
    plan = R.matrix_avg(df, "m")._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.index("LocalTableScan") if "LocalTableScan" in plan else True
    assert R.matrix_avg(df.where("false"), "m").collect() == []


def test_partitions_follow_the_data(spark):
    from cellgrad.session import partitions_for, shuffle_partitions
    base = shuffle_partitions(spark)
    assert partitions_for(10, 48, spark) == base
    assert partitions_for(100 * partitions_for(10**7, 48, spark) * 10**6, 48, spark) > 10 * base


def by_cells(x, y, w0, net, lr, steps):
    """The descent by the cell operators."""
    out, w = {}, w0
    for step in range(steps + 1):
        if step:
            w = update(w, step_gradient(x, y, unstack(w, XH), unstack(w, HO), net), lr, net)
            w = x.sparkSession.createDataFrame(w.collect(), w.schema)
        out.update({(step, *k): v for k, v in cells(w, "id").items()})
    return out


def odd_examples(spark):
    """Repeated and missing cells, values and ids that are null, a feature that no
    trained example has, an unlabelled example."""
    x, y = examples(spark, n=9, d=5)  # 6 has no label
    x = x.withColumn("v", F.when((F.col("i") == 3) | ((F.col("i") == 4) & (F.col("j") < 3)), None).otherwise(F.col("v")))
    x = x.where("(i <> 5 OR j <> 2) AND i <> 7 AND (j <> 4 OR i = 6)")
    x = x.unionByName(x.where("i IN (2, 8)")).unionByName(spark.createDataFrame([(None, 1, 0.4), (None, 2, 0.3)], CELL))
    return x, y.select("i", "j", "v").unionByName(y.where("i IN (2, 9)").select("i", "j", "v"))


@pytest.mark.parametrize("preset", ["sigmoid", "tanh_softmax"])
def test_training_and_scores_of_odd_examples_equal_the_cell_operators(spark, preset):
    x, y = odd_examples(spark)
    net, w0 = Net(5, 6, 3, preset), start(spark, 5, 6, 3)
    got = train_relational(x, y, w0, net, 0.1, 2)
    want = by_cells(x, y, w0, net, 0.1, 2)
    assert {k[2] for k in want if k[:2] == (1, 0)} == {1, 2, 3, 5}  # feature 4 does not carry over
    close(cells(got, "iter", "id"), want)
    one = got.where("iter = 0")
    scores = cells(E.forward_all_steps(x, one, net, 1))
    plain = cells(forward(x, unstack(one, XH), unstack(one, HO), net)[1])
    assert scores.keys() == plain.keys() and scores[3, 1] is None and (None, 1) in scores
    close(*({k: -9.0 if v is None else v for k, v in m.items()} for m in (scores, plain)))


def test_training_and_scoring_join_blocks_not_cells(spark, monkeypatch):
    """Joined rows of a step and of the scores, against single multiplications."""
    x, y = examples(spark, n=80, d=4)
    joined, join = [], coo.contract_join

    def counted(left, right, on, *rest):
        out = join(left, right, on, *rest)
        joined.append(left.join(right, on).count())
        return out

    for module in (coo, T, E):
        monkeypatch.setattr(module, "contract_join", counted)
    net = Net(4, 8, 3)
    hist = train_relational(x, y, start(spark, 4, 8, 3), net, 0.1, 1)
    E.forward_all_steps(x, hist, net, 2).count()
    assert joined and sum(joined) < 80 * (4 * 8 + 2 * 8 * 3) / 4
