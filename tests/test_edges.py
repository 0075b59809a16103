"""Edge cases (FIXTURES.md §4) on hand-made cell tables."""

import math

from pyspark.sql import functions as F

from cellgrad.functions.scalar import sigmoid
from cellgrad.operators import coo
from cellgrad.operators.reshape import one_hot_coo
from cellgrad.operators.weights import stack
from cellgrad.plans import evaluate as E
from cellgrad.plans.relational import Net, forward, train_relational


def cells(spark, rows):
    return spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in rows], "i long, j long, v double")


def labels(spark, rows, n_classes):
    ex = spark.createDataFrame(rows, "i long, label long")
    return one_hot_coo(ex, "label", n_classes)


def test_rank_ties_all_count(spark):
    scores = cells(spark, [(1, 1, 0.7), (1, 2, 0.7), (2, 1, 0.1), (2, 2, 0.9)]).withColumn("iter", F.lit(0))
    y = labels(spark, [(1, 1), (2, 0)], 2)   # example 1 -> class 2, example 2 -> class 1
    acc = E.accuracy_per_step(scores, y).collect()
    # example 1: both classes rank 1, one of them is right -> 1 hit; example 2 wrong
    assert [(r["iter"], r["precision"]) for r in acc] == [(0, 0.5)]


def test_step_without_hit_has_no_row(spark):
    scores = cells(spark, [(1, 1, 0.9), (1, 2, 0.1)]).withColumn("iter", F.lit(3))
    y = labels(spark, [(1, 1)], 2)
    assert E.accuracy_per_step(scores, y).count() == 0


def test_unlabelled_rows_do_not_train(spark):
    net = Net(2, 2, 2)
    x = cells(spark, [(1, 1, 0.5), (1, 2, 0.2), (2, 1, 0.9), (2, 2, 0.4)])
    y_one = labels(spark, [(1, 0)], 2)
    w0 = stack(cells(spark, [(1, 1, 0.1), (1, 2, -0.2), (2, 1, 0.3), (2, 2, 0.4)]),
               cells(spark, [(1, 1, 0.5), (1, 2, -0.5), (2, 1, 0.2), (2, 2, 0.1)])).drop("iter")
    both = train_relational(x, y_one, w0, net, 0.1, 1).filter("iter = 1").orderBy("id", "i", "j").collect()
    only = train_relational(x.filter("i = 1"), y_one, w0, net, 0.1, 1).filter("iter = 1") \
        .orderBy("id", "i", "j").collect()
    assert [round(r["v"], 12) for r in both] == [round(r["v"], 12) for r in only]


def test_extra_label_class_is_tolerated(spark):
    net = Net(1, 1, 2)
    x = cells(spark, [(1, 1, 1.0), (2, 1, 2.0)])
    y = labels(spark, [(1, 2), (2, 0)], 3)   # class 3 has no output
    w0 = stack(cells(spark, [(1, 1, 0.5)]), cells(spark, [(1, 1, 0.3), (1, 2, -0.3)])).drop("iter")
    hist = train_relational(x, y, w0, net, 0.1, 2)
    assert hist.groupBy("iter").count().orderBy("iter").collect()[-1]["count"] == 3


def test_limit_one_trains_nothing(spark):
    """i < 1 keeps no example: the inner-join update leaves no weights."""
    net = Net(1, 1, 1)
    x = cells(spark, [(1, 1, 1.0)])
    y = labels(spark, [(1, 0)], 1)
    w0 = stack(cells(spark, [(1, 1, 0.5)]), cells(spark, [(1, 1, 0.3)])).drop("iter")
    counts = dict(train_relational(x, y, w0, net, 0.1, 2, limit=1).groupBy("iter").count().collect())
    assert counts == {0: 2}


def test_all_zero_example_still_scored(spark):
    net = Net(2, 1, 1)
    x = cells(spark, [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 1.0)])
    w_xh = cells(spark, [(1, 1, 0.7), (2, 1, -0.2)])
    w_ho = cells(spark, [(1, 1, 1.5)])
    a_xh, a_ho = forward(x, w_xh, w_ho, net)
    got = {r["i"]: r["v"] for r in a_xh.collect()}
    assert got[1] == 0.5
    assert a_ho.count() == 2


def test_one_by_one_net_matches_closed_form(spark):
    net = Net(1, 1, 1)
    x = cells(spark, [(1, 1, 0.8)])
    y = labels(spark, [(1, 0)], 1)
    w0 = stack(cells(spark, [(1, 1, 0.4)]), cells(spark, [(1, 1, -0.6)])).drop("iter")
    h = {(r["id"]): r["v"] for r in train_relational(x, y, w0, net, 0.5, 1).filter("iter = 1").collect()}
    s = lambda z: 1 / (1 + math.exp(-z))
    a1 = s(0.8 * 0.4); a2 = s(a1 * -0.6)
    d2 = 2 * (a2 - 1) * a2 * (1 - a2)
    d1 = d2 * -0.6 * a1 * (1 - a1)
    assert abs(h[1] - (-0.6 - 0.5 * a1 * d2)) < 1e-12
    assert abs(h[0] - (0.4 - 0.5 * 0.8 * d1)) < 1e-12


def test_sigmoid_saturates(spark):
    x = cells(spark, [(1, 1, 1000.0), (1, 2, -1000.0)])
    got = {r["j"]: r["v"] for r in coo.cellwise(x, sigmoid).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_densify_equals_plain_right_join_with_repeated_labels(spark):
    from cellgrad.operators.reshape import class_grid, densify
    examples = spark.createDataFrame([(k,) for k in range(1, 6)], "i long")
    grid = class_grid(examples, 3)
    # example 2 is "hot": its label appears 40 times; example 4 twice
    lab = spark.createDataFrame([(2, 1)] * 40 + [(4, 3), (4, 3), (5, 2)], "i long, j long")
    got = sorted(tuple(r) for r in densify(grid, lab).select("i", "j", "v", "dummy").collect())
    plain = (lab.withColumn("one", F.lit(1).cast("long")).join(grid, ["i", "j"], "right")
             .select("i", "j", F.coalesce("one", F.lit(0)).cast("long").alias("v"), F.col("one").alias("dummy")))
    want = sorted(tuple(r) for r in plain.collect())
    assert got == want
    assert len(got) == 15 - 1 - 1 + 40 + 2


def test_densify_plan_builds_no_array_of_labels(spark):
    from cellgrad.operators.reshape import class_grid, densify
    grid = class_grid(spark.range(1, 9).withColumnRenamed("id", "i"), 2)
    text = densify(grid, spark.createDataFrame([(2, 1)] * 9, "i long, j long"))._jdf.queryExecution().toString()
    assert "array_repeat" not in text


def test_mean_gradient_counts_labelled_examples_only(spark):
    net = Net(2, 2, 2)
    x = cells(spark, [(1, 1, 0.5), (1, 2, 0.2), (2, 1, 0.9), (2, 2, 0.4)])
    y = labels(spark, [(1, 0), (2, None)], 2)
    w0 = stack(cells(spark, [(1, 1, 0.1), (1, 2, -0.2), (2, 1, 0.3), (2, 2, 0.4)]),
               cells(spark, [(1, 1, 0.5), (1, 2, -0.5), (2, 1, 0.2), (2, 2, 0.1)])).drop("iter")
    both, only = (sorted((r["id"], r["i"], r["j"], round(r["v"], 12)) for r in train_relational(
        data, y, w0, net, 0.5, 1, reduction="mean").filter("iter = 1").collect()) for data in (x, x.filter("i = 1")))
    assert both == only


def test_seeded_weights_do_not_depend_on_partitions(spark):
    from cellgrad.operators.weights import weight_cells
    dims = spark.createDataFrame([(k, 3, 2) for k in range(6)], "w_id long, _r int, _c int")
    a, b = (sorted(map(tuple, weight_cells(dims.repartition(n), seed=7, keep=["w_id"]).collect())) for n in (1, 5))
    assert a == b and len({r[-1] for r in a}) == len(a) and all(-1 <= r[-1] < 1 for r in a)


def test_softmax_models_give_probabilities(spark):
    x = cells(spark, [(1, 1, 0.5), (1, 2, 0.2), (2, 1, 0.9), (2, 2, 0.4)])
    from cellgrad.operators.weights import weight_cells
    sizes = spark.createDataFrame([(2,), (3,)], "w_id long")
    xh = weight_cells(sizes.selectExpr("w_id", "2 AS _r", "w_id AS _c"), seed=1, keep=["w_id"])
    ho = weight_cells(sizes.selectExpr("w_id", "w_id AS _r", "3 AS _c"), seed=2, keep=["w_id"])
    sums = E.predict_models(x, xh, ho, 2, (2, 3), 3, "tanh_softmax").groupBy("w_id", "i").sum("v").collect()
    assert len(sums) == 4 and all(abs(r["sum(v)"] - 1) < 1e-12 for r in sums)
