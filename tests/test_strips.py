"""Strips: whole rows for nets of few inputs and outputs."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from cellgrad.operators import strips as S
from cellgrad.operators import weights as W
from cellgrad.operators.reshape import one_hot_coo
from cellgrad.operators.weights import HO, XH, unstack
from cellgrad.plans import catalog as K
from cellgrad.plans import evaluate as E
from cellgrad.plans.relational import Net, step_gradient, train_relational, update
from cellgrad.session import VersionStore

from conftest import SF001

CELL = "i long, j long, v double"


def examples(spark):
    """Missing, repeated and NULL cells, an example without any value, rows
    without an id, cells beyond the net, unlabelled rows and two labels."""
    x = [(i, j, ((i * 7 + j * 5) % 11) / 11 - 0.3) for i in range(1, 30) for j in range(1, 4) if (i + j) % 9]
    x += [(5, 1, 0.25), (7, 9, 1.0), (31, 9, 2.0), (32, 1, None), (32, 2, None), (33, 1, None), (33, 2, 0.5)]
    labels = [(i, i % 3 if i % 5 else None) for i in range(1, 30)] + [(4, 2), (32, 1), (33, 0), (50, 1), (8, 7)]
    y = one_hot_coo(spark.createDataFrame(labels, "i long, label int"), "label", 4)
    return spark.createDataFrame(x, CELL), y


def start(spark, net):
    return W.stack(W.init_coo(spark, net.n_in, net.n_hidden, seed=3),
                   W.init_coo(spark, net.n_hidden, net.n_out, seed=4)).drop("iter")


def table(df, *keys):
    return sorted((tuple(r[k] for k in keys), None if r["v"] is None else round(r["v"], 10)) for r in df.collect())


@pytest.mark.parametrize("preset", ["sigmoid", "tanh_softmax"])
def test_strips_train_as_cells_do(spark, preset):
    x, y = examples(spark)
    net = Net(3, 6, 3, preset)  # the second block has two units only
    assert S.fits(3, 6, 3, 1, spark)
    w = w0 = start(spark, net)
    got = train_relational(x, y, w0, net, 0.1, 2).persist()
    inside = x.where("j <= 3 AND v IS NOT NULL")
    for step in (1, 2):
        w = update(w, step_gradient(inside, y, unstack(w, XH), unstack(w, HO), net), 0.1, net)
        assert table(got.where(f"iter = {step}"), "id", "i", "j") == table(w, "id", "i", "j")
    got.unpersist()


@pytest.mark.parametrize("preset", ["sigmoid", "tanh_softmax"])
def test_strips_score_as_cells_do(spark, preset):
    x, y = examples(spark)
    x = x.unionByName(spark.createDataFrame([(None, 1, 0.5), (None, 2, 0.25)], CELL))
    net = Net(3, 6, 3, preset)
    w = start(spark, net)
    # Version 1 has no weights of output 2.
    hist = w.select(F.lit(0).cast("long").alias("iter"), "*").unionByName(
        w.where(f"NOT (id = {HO} AND j = 2)").select(F.lit(1).cast("long").alias("iter"), "*"))
    want = E.forward_keyed(x, *(hist.where(F.col("id") == k).drop("id") for k in (XH, HO)), net, "iter", 36, 36)
    key = lambda df: sorted((r["iter"], r["i"] or 0, r["j"], None if r["v"] is None else round(r["v"], 10))
                            for r in df.collect())
    assert key(E.forward_all_steps(x, hist, net, 2)) == key(want)
    acc = lambda scores: sorted((r["iter"], r["precision"]) for r in E.accuracy_per_step(scores, y).collect())
    strips = E.forward_all_steps(x, hist, net, 2, strips=True)
    assert "j" not in strips.columns and acc(strips) == acc(want) and len(acc(want)) == 2


def test_ties_zero_labels_and_repeats_count_as_with_cells(spark):
    scores = spark.createDataFrame([(0, i, a, b, True, True) for i, a, b in (
        (1, 0.7, 0.7), (2, 0.1, 0.9), (3, 0.2, 0.1), (4, None, None), (5, 0.3, 0.4))],
        "iter long, i long, v1 double, v2 double, o1 boolean, o2 boolean")
    cells = S.to_cells(scores, ["v1", "v2"], ["o1", "o2"], ["iter"])
    y = one_hot_coo(spark.createDataFrame([(1, 1), (2, 5), (3, 0), (3, 0), (4, 1), (9, 0)], "i long, label int"), "label", 3)
    want = E.accuracy_per_step(cells, y).collect()
    assert E.accuracy_per_step(scores, y).collect() == want
    assert [r["precision"] for r in want] == [(1 + 1 + 2 + 1) / 5]
    with pytest.raises(Exception, match="one-hot"):
        E.accuracy_per_step(scores, y.withColumn("v", F.lit(2))).collect()


def test_model_without_a_matrix_has_no_blocks(spark):
    w = start(spark, Net(3, 6, 3))
    assert S.model(w, 3, 6, 3).count() == S.blocks_in(6) == 2
    assert S.model(w.where(f"id = {XH}"), 3, 6, 3).count() == 0
    assert S.model(w.where("false"), 3, 6, 3).count() == 0


def test_lineitem_scores_are_not_unfolded_and_ranked(spark, monkeypatch):
    """One row for an example and version up to the accuracy, and examples that
    are exchanged as rows, once for features and once for labels."""
    hist = spark.createDataFrame([], f"iter long, {VersionStore.CELLS}")
    monkeypatch.setattr(K, "_iris_hist", lambda x, y, w0: hist)
    buf = io.StringIO()
    with redirect_stdout(buf):
        K.QUERIES["train_and_score_lineitem"](spark, SF001).explain("formatted")
    text = buf.getvalue()
    assert "rank(" not in text
    initial = text[text.index("Initial Plan"):text.index("\n(1) ")] if "Initial Plan" in text else text[:text.index("\n(1) ")]
    assert initial.count("Generate") == 2
    assert text.count("REPARTITION_BY_NUM") == 2
