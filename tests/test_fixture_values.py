"""Published fixture values (FIXTURES.md §3): embeddings at sf0.01, hidden 8,
outputs 10, deterministic weights, training rows i <= 100."""

from pyspark.sql import functions as F

from cellgrad.plans import catalog as K
from cellgrad.plans import evaluate as E
from cellgrad.plans.relational import train_relational
from cellgrad.plans.arrays import train_array

from conftest import SF01

SUM_LR001 = [3.5, -4.566123, -10.863408, -15.538315]
SUM_MEAN_LR05 = [3.5, -0.533062, -4.161097, -7.362389]
HITS = [54, 45, 45, 43]
MAE = [1.044615, 0.887874, 0.769489, 0.687576]


def _sums(hist):
    rows = hist.groupBy("iter").agg(F.round(F.sum("v"), 6).alias("s"), F.count("*").alias("n")) \
        .orderBy("iter").collect()
    return [r["s"] for r in rows], [r["n"] for r in rows]


def test_relational_sum_gradient(spark):
    e = K.Emb(spark, SF01, partitioned=True)
    sums, cells = _sums(train_relational(e.x, e.y, e.w0, e.net, 0.01, 3, limit=101))
    assert sums == SUM_LR001
    assert cells == [64 * 8 + 8 * 10] * 4


def test_relational_mean_gradient(spark):
    e = K.Emb(spark, SF01, partitioned=True)
    sums, _ = _sums(train_relational(e.x, e.y, e.w0, e.net, 0.5, 3, limit=101, reduction="mean"))
    assert sums == SUM_MEAN_LR05


def test_array_trainer_matches_relational(spark):
    e = K.Emb(spark, SF01)
    sums, _ = _sums(train_array(e.vectors(), e.w0, e.net, 0.5, 3, limit=101, reduction="mean"))
    assert sums == SUM_MEAN_LR05
    sums, _ = _sums(train_array(e.vectors(), e.w0, e.net, 0.01, 3, limit=101, reduction="sum"))
    assert sums == SUM_LR001


def test_hits_precision_and_error(spark):
    e = K.Emb(spark, SF01, partitioned=True)
    hist = train_relational(e.x, e.y, e.w0, e.net, 0.01, 3, limit=101)
    acc = E.accuracy_per_step(E.forward_all_steps(e.x, hist, e.net, 4), e.y).orderBy("iter").collect()
    assert [round(r["precision"] * 500) for r in acc] == HITS
    from cellgrad.operators.reshape import first_rows
    mae = E.mean_abs_error(E.forward_all_steps(first_rows(e.x, 101), hist, e.net, 4), e.y) \
        .orderBy("iter").collect()
    assert [round(r["error"], 6) for r in mae] == MAE
