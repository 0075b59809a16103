"""The query catalog: one Spark query per operator of the survey, each with
its DuckDB oracle (same column names, same rounding).

Fixtures (FIXTURES.md): the MNIST-like net runs on ``embeddings`` (64
features, 10 classes, hidden 8, deterministic weights, lr 0.01, summed
gradient, 3 steps); the Iris-like net on ``lineitem``
(4 features, 3 classes).  Every query reads the tables, whole: training
uses every example (the ``i < limit`` training subset of the recorded runs
is covered by the tests and by the ``row_limit_filter`` operator).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrad.functions import arrays as A
from cellgrad.functions.scalar import (
    W_HO_COEF, W_XH_COEF, register_sql_functions, register_table_functions, sigmoid, tanh)
from cellgrad.operators import coo
from cellgrad.operators import reshape as R
from cellgrad.operators import tiles as TI
from cellgrad.operators import weights as W
from cellgrad.plans import arrays as AP
from cellgrad.plans import evaluate as E
from cellgrad.plans import minibatch as MB
from cellgrad.plans import script as SC
from cellgrad.plans import tiled as TL
from cellgrad.plans.relational import (
    Net, cells_per_step, distinct_steps, forward, gradient, hidden_delta, loss_gradient,
    output_delta, train_relational, update)
from cellgrad.session import CELL_ROW_BYTES, ensure_checkpoint_dir, loop_settings, materialize, partitions_for
from cellgrad.sources import buckets as BK
from cellgrad.sources import files as FI
from cellgrad.sources import models as MO
from cellgrad.sources import tables as TB

# Fixed parameters of the checked fixtures; feature and class counts are read
# from the data.
H = 8                          # hidden units on embeddings
LIMIT = 101                    # the row-limit operators keep i < 101 (i <= 100)
TRAIN_LIMIT = None             # registered training queries use every row
LR = 0.01
STEPS = 3
LONG_STEPS = 10                # the shortest recorded Iris run
MEAN_LR = 0.5                  # mean-gradient runs
ARRAY_LR = 0.1                 # the array workload's hard-coded step
OFFSET = 0.001                 # added to scaled features in the recorded load
SEED = 1
HIDDEN_SIZES = (4, 8, 16)      # small multi-model store
MODEL_SIZES = (10, 20, 50, 100)  # the recorded inference sizes start like this
IRIS_D, IRIS_H, IRIS_C = 4, 20, 3
IRIS_ONE_HOT_CLASSES = 4       # one class more than outputs, as recorded
REPLICAS = 3

IRIS_NET = Net(IRIS_D, IRIS_H, IRIS_C)


# ----------------------------------------------------------------- helpers
def finish(df: DataFrame) -> DataFrame:
    """Round doubles to 6 digits (+0.0 drops -0.0); integers as BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


class Emb:
    """The embeddings fixture, built lazily per query but for its shape: the
    number of features and classes comes from the data."""

    def __init__(self, spark: SparkSession, sf: str, partitioned: bool = False):
        ex = TB.embedding_examples(spark, sf)
        d, c = ex.agg(F.max(F.size("x")), F.max("label") + 1).first()
        self.spark = spark
        self.ex = ex
        self.classes = int(c or 0)
        self.net = Net(int(d or 0), H, self.classes)
        self.net_ts = Net(int(d or 0), H, self.classes, "tanh_softmax")
        self.x = TB.embedding_cells(ex)
        self.y = TB.embedding_one_hot(ex, self.classes)
        if partitioned:
            # Training / scoring fixtures: cells partitioned by example id once.
            with loop_settings(spark):
                self.x = R.partition_examples(self.x).persist()
                self.y = R.partition_examples(self.y).persist()
        self.w_xh = W.init_coo(spark, self.net.n_in, H, W_XH_COEF)
        self.w_ho = W.init_coo(spark, H, self.classes, W_HO_COEF)

    @property
    def w0(self) -> DataFrame:
        return W.stack(self.w_xh, self.w_ho).drop("iter")

    def vectors(self) -> DataFrame:
        return self.ex.select("i", "x", A.one_hot("label", self.classes).alias("y"))

    def with_model(self) -> DataFrame:
        """Each example row with the (single, bounded) model attached: each
        matrix is packed to a nested array by one scalar subquery, which
        Spark computes once and uses as a value in the projection (no join)."""
        w_xh = R.coo_to_array(self.w_xh).select("m").scalar()
        w_ho = R.coo_to_array(self.w_ho).select("m").scalar()
        return self.vectors().select("*", w_xh.alias("w_xh"), w_ho.alias("w_ho"))


def _iris_cells(spark, sf):
    li = TB.lineitem_examples(spark, sf)
    return li, R.to_coo(li, "id", [n for n, _, _, _ in TB.LINEITEM_FEATURES])


def _hist(e: Emb, steps=STEPS, lr=LR, reduction="sum", net=None) -> DataFrame:
    out = train_relational(e.x, e.y, e.w0, net or e.net, lr, steps, TRAIN_LIMIT, reduction)
    e.x.unpersist()  # the history is written; scoring reads the table again
    e.y.unpersist()
    return out


def _dims(spark, sf) -> DataFrame:
    """Net dimensions read from the data: d = vector size, c = max label + 1."""
    ex = TB.embedding_examples(spark, sf)
    return ex.agg(F.max(F.size("x")).cast("long").alias("_d"),
                  (F.max("label") + 1).cast("long").alias("_cl"))


def _store(spark, sf, sizes=HIDDEN_SIZES) -> tuple[DataFrame, DataFrame]:
    dims = _dims(spark, sf)
    sized = (dims.select(F.explode(F.array(*[F.lit(int(h)) for h in sizes])).alias("w_id"), "_d", "_cl")
             .withColumn("w_id", F.col("w_id").cast("long")))
    xh = W.weight_cells(sized.select("w_id", F.col("_d").alias("_r"), F.col("w_id").alias("_c")),
                        W_XH_COEF, keep=["w_id"])
    ho = W.weight_cells(sized.select("w_id", F.col("w_id").alias("_r"), F.col("_cl").alias("_c")),
                        W_HO_COEF, keep=["w_id"])
    return xh, ho


# ------------------------------------------------------------ Spark queries
def q_scan_features(spark, sf):
    return finish(TB.lineitem_raw(spark, sf))


def q_replicate_rows(spark, sf):
    li = TB.lineitem_raw(spark, sf)
    return finish(R.replicate(li, REPLICAS).groupBy("copy").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_quantity")))


def q_scale_features(spark, sf):
    return finish(TB.lineitem_examples(spark, sf).drop("species"))


def q_assign_ids(spark, sf):
    li = TB.table(spark, sf, "lineitem").select(*TB.LINEITEM_KEY)
    return finish(R.assign_ids(li, TB.LINEITEM_KEY, "id"))


def q_limit_examples(spark, sf):
    ex = TB.embedding_examples(spark, sf)
    return finish(TB.embedding_cells(R.limit_examples(ex, LIMIT - 1, ["i"])))


def q_row_limit_filter(spark, sf):
    return finish(R.first_rows(Emb(spark, sf).x, LIMIT))


def q_wide_to_coo(spark, sf):
    return finish(_iris_cells(spark, sf)[1])


def q_pack_features(spark, sf):
    li = TB.lineitem_examples(spark, sf)
    packed = R.to_array(li, "id", [n for n, _, _, _ in TB.LINEITEM_FEATURES])
    return finish(R.vector_to_coo(packed, "x"))


def q_one_hot_coo(spark, sf):
    return finish(Emb(spark, sf).y)


def q_one_hot_coo_lineitem(spark, sf):
    li = TB.lineitem_examples(spark, sf)
    return finish(R.one_hot_coo(li, "species", IRIS_ONE_HOT_CLASSES, id_col="id"))


def q_one_hot_coo_labels(spark, sf):
    return finish(TB.document_label_one_hot(spark, sf, 2))


def q_one_hot_array(spark, sf):
    e = Emb(spark, sf)
    return finish(R.vector_to_coo(e.vectors(), "y"))


def q_class_count(spark, sf):
    ex = TB.embedding_examples(spark, sf)
    return finish(ex.agg((F.max("label") + 1).alias("n")))


def q_series_grid(spark, sf):
    return finish(R.class_grid(TB.embedding_examples(spark, sf), Emb(spark, sf).classes))


def q_init_weights(spark, sf):
    xh, ho = _store(spark, sf)
    return finish(W.tag(xh.select("w_id", "i", "j", "v"), id=0).select("w_id", "id", "i", "j", "v")
                  .unionByName(W.tag(ho.select("w_id", "i", "j", "v"), id=1)
                               .select("w_id", "id", "i", "j", "v")))


def q_init_weights_array(spark, sf):
    xh, ho = _store(spark, sf)
    arr_xh = R.coo_to_array(xh, ["w_id"]).withColumn("id", F.lit(0).cast("long"))
    arr_ho = R.coo_to_array(ho, ["w_id"]).withColumn("id", F.lit(1).cast("long"))
    models = arr_xh.unionByName(arr_ho)
    return finish(R.matrix_to_coo(models, "m", ["w_id", "id"]))


CLASS_MODEL = 3


def _products(spark, sf) -> DataFrame:
    """The cells of xᵀy, a weight matrix that the data give."""
    e = Emb(spark, sf)
    return coo.matmul_at(e.x, e.y.select("i", "j", F.col("v").cast("double").alias("v")))


def _class_models(spark, sf) -> DataFrame:
    """A model per class: the mean of x ⊗ y over its examples."""
    e = Emb(spark, sf)
    rows = e.ex.select(F.col("label").alias("w_id"), A.outer("x", A.one_hot("label", e.classes)).alias("m"))
    return R.matrix_avg(rows, "m", ["w_id"])


def q_literal_weights(spark, sf):
    """The data's matrix xᵀy as literal text and back."""
    text = W.matrix_json(R.coo_to_array(_products(spark, sf)), "m").select("text")
    return finish(R.matrix_to_coo(W.weights_from_json(text, "text"), "m").select("i", "j", "v"))


def q_append_models(spark, sf):
    models = _class_models(spark, sf)
    return finish(W.append(models.where("w_id < 3"), models.where("w_id >= 3")))


def q_select_model(spark, sf):
    return finish(W.select_model(_class_models(spark, sf), CLASS_MODEL))


def q_tag_weights(spark, sf):
    return finish(W.tag(_products(spark, sf), iter=0, id=0))


def q_stack_weights(spark, sf):
    """Both matrices of the data's gradient in one table."""
    g = _train_gradient(Emb(spark, sf))
    return finish(W.stack(W.unstack(g, 0), W.unstack(g, 1)))


def q_coo_to_array(spark, sf):
    e = Emb(spark, sf)
    m = R.coo_to_array(coo.matmul_at(e.x, e.y.select("i", "j", F.col("v").cast("double").alias("v"))))
    return finish(R.matrix_to_coo(m, "m"))


def q_matmul(spark, sf):
    e = Emb(spark, sf)
    return finish(coo.matmul(e.x, e.w_xh, b_bound=e.net.xh_cells))


def q_matmul_bt(spark, sf):
    e = Emb(spark, sf)
    y = e.y.select("i", "j", F.col("v").cast("double").alias("v"))
    return finish(coo.matmul_bt(y, e.w_ho, b_bound=e.net.ho_cells))


def q_matmul_at(spark, sf):
    e = Emb(spark, sf)
    y = e.y.select("i", "j", F.col("v").cast("double").alias("v"))
    return finish(coo.matmul_at(e.x, y))


def q_hadamard(spark, sf):
    e = Emb(spark, sf)
    return finish(coo.hadamard(e.x, e.x))


def q_sigmoid(spark, sf):
    return finish(coo.cellwise(Emb(spark, sf).x, sigmoid))


def q_sql_udf_sigmoid(spark, sf):
    """The layer in SQL text: one row per example, the weight columns as one
    bounded scalar value, the dot products as an array expression and the
    registered SQL function on each."""
    e = Emb(spark, sf)
    register_sql_functions(spark)
    e.ex.createOrReplaceTempView("cg_examples")
    R.coo_to_array(coo.transpose(e.w_xh)).createOrReplaceTempView("cg_columns")
    return finish(spark.sql("""
        WITH units AS (SELECT i, x, (SELECT m FROM cg_columns) AS cols FROM cg_examples),
        raw AS (
          SELECT i, posexplode(transform(cols, unit ->
            aggregate(zip_with(x, unit, (p, q) -> p * q), 0D, (t, u) -> t + u))) AS (place, total)
          FROM units)
        SELECT i, CAST(place + 1 AS BIGINT) AS j, sig(total) AS v FROM raw"""))


def q_sigmoid_layer(spark, sf):
    e = Emb(spark, sf)
    return finish(coo.layer(e.x, e.w_xh, sigmoid, w_bound=e.net.xh_cells))


def q_tanh_layer(spark, sf):
    e = Emb(spark, sf)
    return finish(coo.layer(e.x, e.w_xh, tanh, w_bound=e.net.xh_cells))


def q_softmax_layer(spark, sf):
    e = Emb(spark, sf)
    return finish(forward(e.x, e.w_xh, e.w_ho, e.net_ts)[1])


def q_forward(spark, sf):
    e = Emb(spark, sf)
    return finish(forward(e.x, e.w_xh, e.w_ho, e.net)[1])


def q_predict_scores(spark, sf):
    e = Emb(spark, sf)
    xh, ho = _store(spark, sf)
    return finish(E.predict_scores(e.x, W.select_model(xh, H), W.select_model(ho, H), e.net))


def q_loss_gradient(spark, sf):
    e = Emb(spark, sf)
    return finish(loss_gradient(forward(e.x, e.w_xh, e.w_ho, e.net)[1], e.y))


def q_delta_output(spark, sf):
    e = Emb(spark, sf)
    return finish(output_delta(forward(e.x, e.w_xh, e.w_ho, e.net)[1], e.y, e.net))


def q_delta_hidden(spark, sf):
    e = Emb(spark, sf)
    a_xh, a_ho = forward(e.x, e.w_xh, e.w_ho, e.net)
    return finish(hidden_delta(output_delta(a_ho, e.y, e.net), e.w_ho, a_xh, e.net))


def _train_gradient(e: Emb) -> DataFrame:
    x = e.x
    a_xh, a_ho = forward(x, e.w_xh, e.w_ho, e.net)
    d_ho = output_delta(a_ho, e.y, e.net)
    return gradient(x, a_xh, hidden_delta(d_ho, e.w_ho, a_xh, e.net), d_ho)


def q_gradient(spark, sf):
    return finish(_train_gradient(Emb(spark, sf)))


def q_weight_update(spark, sf):
    e = Emb(spark, sf)
    return finish(update(e.w0, _train_gradient(e), LR, e.net))


def q_train_relational(spark, sf):
    return finish(_hist(Emb(spark, sf, partitioned=True)))


def q_cells_per_step(spark, sf):
    return finish(cells_per_step(_hist(Emb(spark, sf, partitioned=True))))


def q_distinct_steps(spark, sf):
    return finish(distinct_steps(_hist(Emb(spark, sf, partitioned=True))))


def _all_steps(e: Emb, **kw) -> DataFrame:
    return E.forward_all_steps(e.x, _hist(e, **kw), e.net, STEPS + 1)


def q_forward_all_steps(spark, sf):
    return finish(_all_steps(Emb(spark, sf, partitioned=True)))


def q_rank_predictions(spark, sf):
    e = Emb(spark, sf, partitioned=True)
    return finish(E.rank_scores(_all_steps(e), ("iter", "i")).drop("v"))


def q_rank_labels(spark, sf):
    e = Emb(spark, sf)
    return finish(E.rank_scores(e.y.drop("dummy"), ("i",)).drop("v"))


def q_accuracy_per_step(spark, sf):
    e = Emb(spark, sf, partitioned=True)
    return finish(E.accuracy_per_step(_all_steps(e), e.y))


def q_best_accuracy(spark, sf):
    e = Emb(spark, sf, partitioned=True)
    return finish(E.best_accuracy(E.accuracy_per_step(_all_steps(e), e.y)))


def q_train_and_score(spark, sf):
    """Train (mean gradient, lr 0.5) and score every version in one call."""
    e = Emb(spark, sf, partitioned=True)
    scores = _all_steps(e, lr=MEAN_LR, reduction="mean")
    return finish(E.best_accuracy(E.accuracy_per_step(scores, e.y)))


def q_mean_abs_error(spark, sf):
    e = Emb(spark, sf, partitioned=True)
    hist = _hist(e)
    scores = E.forward_all_steps(e.x, hist, e.net, STEPS + 1)
    return finish(E.mean_abs_error(scores, e.y))


def _array_rows(e: Emb) -> DataFrame:
    m = e.with_model()
    return m.select("i", "x", "y", "w_xh", "w_ho")


def q_array_matmul(spark, sf):
    rows = _array_rows(Emb(spark, sf))
    return finish(R.vector_to_coo(rows.select("i", A.vec_mat("x", "w_xh").alias("s")), "s"))


def q_array_transpose(spark, sf):
    e = Emb(spark, sf)
    m = R.coo_to_array(coo.matmul_at(e.x, e.y.select("i", "j", F.col("v").cast("double").alias("v"))))
    return finish(R.matrix_to_coo(m.select(A.mat_t("m").alias("t")), "t"))


def _output_delta_vec(a2, y):
    return A.vec_zip(A.vec_zip(a2, y, lambda a, t: F.lit(2.0) * (a - t)), a2,
                     lambda l, a: l * (a * (F.lit(1.0) - a)))


def _forward_bound(body):
    """``body(a_xh, a_ho)`` with both activations bound once per row (let),
    so no sub-expression is repeated by projection collapsing."""
    return A.let(A.sigmoid_vec(A.vec_mat("x", "w_xh")),
                 lambda a1: A.let(A.sigmoid_vec(A.vec_mat(a1, F.col("w_ho"))),
                                  lambda a2: body(a1, a2)))


def q_array_elementwise(spark, sf):
    rows = _array_rows(Emb(spark, sf))
    d = rows.select("i", _forward_bound(lambda a1, a2: _output_delta_vec(a2, F.col("y"))).alias("d"))
    return finish(R.vector_to_coo(d, "d"))


def q_array_outer(spark, sf):
    rows = _array_rows(Emb(spark, sf))
    o = rows.select("i", _forward_bound(
        lambda a1, a2: A.outer(a1, _output_delta_vec(a2, F.col("y")))).alias("m"))
    return finish(R.matrix_to_coo(o, "m", ["i"]).toDF("i", "r", "c", "v"))


def q_array_argmax(spark, sf):
    ex = TB.embedding_examples(spark, sf)
    return finish(ex.select("i", A.argmax("x").alias("j")))


def q_array_forward(spark, sf):
    rows = _array_rows(Emb(spark, sf))
    out = rows.select("i", _forward_bound(lambda a1, a2: a2).alias("a"))
    return finish(R.vector_to_coo(out, "a"))


def q_matrix_avg(spark, sf):
    """Cell-wise mean over all examples of x ⊗ y."""
    e = Emb(spark, sf)
    return finish(R.matrix_avg(e.vectors().select(A.outer("x", "y").alias("m")), "m"))


def q_matrix_avg_by_class(spark, sf):
    """The same mean per class."""
    e = Emb(spark, sf)
    rows = e.ex.select("label", A.outer("x", A.one_hot("label", e.classes)).alias("m"))
    return finish(R.matrix_avg(rows, "m", ["label"]))


def q_vectors_by_value(spark, sf):
    """Grouping by an array column, and equality of arrays."""
    e = Emb(spark, sf)
    rows = e.vectors().join(e.ex.select("i", "label"), "i")
    return finish(rows.groupBy("y").agg(
        F.sum(F.get("y", F.lit(0))).alias("first"), F.count("*").alias("count"), F.min("i").alias("least"),
        F.bool_and(F.col("y") == A.one_hot("label", e.classes)).alias("same")).drop("y"))


def q_array_tanh_layer(spark, sf):
    rows = _array_rows(Emb(spark, sf))
    return finish(R.vector_to_coo(rows.select("i", A.tanh_vec(A.vec_mat("x", "w_xh")).alias("a")), "a"))


def q_array_softmax(spark, sf):
    rows = _array_rows(Emb(spark, sf))
    out = rows.select("i", A.let(A.tanh_vec(A.vec_mat("x", "w_xh")),
                                 lambda a: A.softmax(A.vec_mat(a, F.col("w_ho")))).alias("a"))
    return finish(R.vector_to_coo(out, "a"))


def q_array_mat_mul(spark, sf):
    """Product of two whole matrices, (xᵀy)ᵀ · w_xh, mapped cell by cell (× 1)."""
    e = Emb(spark, sf)
    both = R.coo_to_array(_products(spark, sf)).select(
        A.mat_t("m").alias("a"), R.coo_to_array(e.w_xh).select("m").scalar().alias("b"))
    out = both.select(A.mat_map(A.mat_mul("a", "b"), lambda t: t * F.lit(1.0)).alias("m"))
    return finish(R.matrix_to_coo(out, "m"))


def q_array_weight_update(spark, sf):
    """W - lr * G on nested arrays, G from the relational gradient."""
    e = Emb(spark, sf)
    packed = R.coo_to_array(_train_gradient(e), ["id"]).withColumnRenamed("m", "g")
    both = R.coo_to_array(e.w0, ["id"]).join(packed, "id")
    return finish(R.matrix_to_coo(both.select("id", A.mat_axpy("m", "g", -LR).alias("m")), "m", ["id"]))


def q_offset_features(spark, sf):
    """Scaled features with the recorded offset added."""
    li = TB.lineitem_examples(spark, sf)
    return finish(li.select("id", *[(F.col(n) + F.lit(OFFSET)).alias(n) for n, _, _, _ in TB.LINEITEM_FEATURES]))


def q_init_weights_seeded(spark, sf):
    """Seeded start weights of the data's shape: size, range, no repeats."""
    e = Emb(spark, sf)
    w = W.init_coo(spark, e.net.n_in, H, seed=SEED)
    return finish(w.agg(F.count("*").alias("cells"), F.bool_and((F.col("v") >= -1) & (F.col("v") < 1)).alias("in_range"),
                        (F.countDistinct("v") == F.count("*")).alias("all_distinct")))


def q_predict_correct(spark, sf):
    e = Emb(spark, sf)
    w1, w2 = AP.weights_to_numpy(e.w0, e.net)
    return finish(AP.predict_correct(e.vectors(), w1, w2, e.net))


def _array_counts(e: Emb) -> DataFrame:
    hist = AP.train_array(e.vectors(), e.w0, e.net, ARRAY_LR, STEPS, TRAIN_LIMIT, "mean")
    return AP.score_history(e.vectors(), hist, e.net, STEPS + 1)


def q_correct_counts(spark, sf):
    return finish(_array_counts(Emb(spark, sf)))


def q_best_accuracy_array(spark, sf):
    return finish(E.best_share(_array_counts(Emb(spark, sf)), "id"))


def q_ordered_accuracy(spark, sf):
    e = Emb(spark, sf, partitioned=True)
    return finish(E.ordered(E.accuracy_per_step(_all_steps(e), e.y)))


def q_train_relational_tanh_softmax(spark, sf):
    e = Emb(spark, sf, partitioned=True)
    return finish(_hist(e, net=e.net_ts))


def q_predict_models(spark, sf):
    e = Emb(spark, sf)
    return finish(E.predict_models(e.x, *_store(spark, sf, MODEL_SIZES), e.net.n_in, MODEL_SIZES, e.classes))


def q_predict_models_tanh_softmax(spark, sf):
    e = Emb(spark, sf)
    return finish(E.predict_models(e.x, *_store(spark, sf, MODEL_SIZES), e.net.n_in, MODEL_SIZES, e.classes,
                                   "tanh_softmax"))


def q_predict_models_correct(spark, sf):
    """Array inference with several models in one pass, counts per model."""
    e = Emb(spark, sf)
    xh, ho = _store(spark, sf, MODEL_SIZES)
    models = {}
    for h in MODEL_SIZES:
        net = Net(e.net.n_in, h, e.classes)
        w = W.stack(W.select_model(xh, h), W.select_model(ho, h))
        models[h] = (AP.Blocks(spark, *AP.weights_to_numpy(w, net)), net)
    return finish(AP.count_correct(e.vectors(), models, "w_id"))


def q_train_array(spark, sf):
    e = Emb(spark, sf)
    return finish(AP.train_array(e.vectors(), e.w0, e.net, MEAN_LR, STEPS, TRAIN_LIMIT, "mean"))


def q_train_array_tanh_softmax(spark, sf):
    e = Emb(spark, sf)
    return finish(AP.train_array(e.vectors(), e.w0, e.net_ts, ARRAY_LR, STEPS, TRAIN_LIMIT, "mean"))


def _iris_start(spark) -> DataFrame:
    return W.stack(W.init_coo(spark, IRIS_D, IRIS_H, W_XH_COEF),
                   W.init_coo(spark, IRIS_H, IRIS_C, W_HO_COEF)).drop("iter")


def _iris(spark, sf):
    """Cells of both tables unfold from rows that are hash partitioned by id, as
    many partitions as the cells of all versions take."""
    li = TB.lineitem_examples(spark, sf)
    li = li.repartition(partitions_for(li.count() * IRIS_D * (STEPS + 1), CELL_ROW_BYTES, spark), "id")
    x = R.to_coo(li, "id", [n for n, _, _, _ in TB.LINEITEM_FEATURES])
    return x, R.one_hot_coo(li, "species", IRIS_NET.n_out, id_col="id"), _iris_start(spark)


def _iris_hist(x: DataFrame, y: DataFrame, w0: DataFrame) -> DataFrame:
    return train_relational(x, y, w0, IRIS_NET, LR, STEPS)


def q_train_relational_lineitem(spark, sf):
    return finish(_iris_hist(*_iris(spark, sf)))


def q_train_and_score_lineitem(spark, sf):
    x, y, w0 = _iris(spark, sf)
    hist = _iris_hist(x, y, w0)
    scores = E.forward_all_steps(x, hist, IRIS_NET, STEPS + 1, strips=True)
    return finish(E.accuracy_per_step(scores, y))


def _iris_rows(spark, sf) -> DataFrame:
    li = TB.lineitem_examples(spark, sf)
    return li.select(F.col("id").alias("i"),
                     F.array(*[F.col(n) for n, _, _, _ in TB.LINEITEM_FEATURES]).alias("x"),
                     A.one_hot("species", IRIS_C).alias("y"))


def q_train_array_lineitem(spark, sf):
    return finish(AP.train_array(_iris_rows(spark, sf), _iris_start(spark), IRIS_NET, MEAN_LR, STEPS, None, "mean"))


def q_train_array_lineitem_long(spark, sf):
    """As many steps as the shortest recorded Iris run."""
    return finish(AP.train_array(_iris_rows(spark, sf), _iris_start(spark), IRIS_NET, MEAN_LR, LONG_STEPS, None, "mean"))


def _y(e: Emb) -> DataFrame:
    return e.y.select("i", "j", F.col("v").cast("double").alias("v"))


def q_matmul_tiled(spark, sf):
    e = Emb(spark, sf)
    out = TI.matmul(TI.to_tiles(e.x), TI.to_tiles(e.w_xh), b_bound=TI.tiles_in(e.net.n_in, H))
    return finish(TI.to_cells(out, cols=H).join(e.ex.select("i"), "i", "left_semi"))


def q_matmul_bt_tiled(spark, sf):
    e = Emb(spark, sf)
    out = TI.matmul_bt(TI.to_tiles(_y(e)), TI.to_tiles(e.w_ho), b_bound=TI.tiles_in(H, e.classes))
    return finish(TI.to_cells(out, cols=H).join(e.ex.select("i"), "i", "left_semi"))


def q_matmul_at_tiled(spark, sf):
    e = Emb(spark, sf)
    out = TI.matmul_at(TI.to_tiles(e.x), TI.to_tiles(_y(e)))
    return finish(TI.to_cells(out, rows=e.net.n_in, cols=e.classes))


def q_train_tiled_lineitem(spark, sf):
    """The Iris-shaped training run over tiles."""
    li, x = _iris_cells(spark, sf)
    y = R.one_hot_coo(li, "species", IRIS_NET.n_out, id_col="id")
    return finish(TL.train_tiled(x, y, _iris_start(spark), IRIS_NET, LR, STEPS))


# A sweep: settings of their own size, rate, number of steps and row limit.
SWEEP = (TL.Setting(1, H, 0.01, 3), TL.Setting(2, 4, 0.02, 2, 102), TL.Setting(3, H, 0.005, 3, 258),
         TL.Setting(4, 16, 0.01, 1, 51))


def q_train_sweep(spark, sf):
    """Four settings trained at once, all versions of each."""
    e = Emb(spark, sf)
    start = None
    for k in SWEEP:
        w = W.stack(W.init_coo(spark, e.net.n_in, k.n_hidden, W_XH_COEF),
                    W.init_coo(spark, k.n_hidden, e.classes, W_HO_COEF)).drop("iter")
        w = W.tag(w, w_id=k.w_id)
        start = w if start is None else start.unionByName(w)
    return finish(TL.train_sweep(e.x, e.y, start, SWEEP, e.net.n_in, e.classes))


BATCH = 130                    # does not divide the rows; with the wrap below
BATCH_STEPS = 6


def q_train_minibatch(spark, sf):
    """Sliding batches, past the last one to the first again."""
    e = Emb(spark, sf)
    return finish(MB.train_minibatch(MB.ExampleStore(e.x, e.y, BATCH), e.w0, e.net, MEAN_LR, BATCH_STEPS))


LINE_NUMBERS = 7


def _sparse_lineitem(spark, sf) -> tuple[DataFrame, DataFrame, Net]:
    """Eight features of which seven are a one-hot line number: mostly zeros."""
    li = R.assign_ids(TB.lineitem_raw(spark, sf), TB.LINEITEM_KEY, "id")
    wide = li.select("id", "species", F.array(
        *[(F.col("l_linenumber") == k).cast("double") for k in range(1, LINE_NUMBERS + 1)],
        F.col("l_quantity") / 50.0).alias("x"))
    x = R.vector_to_coo(wide, "x", "id")
    return x, R.one_hot_coo(wide, "species", IRIS_C, id_col="id"), Net(LINE_NUMBERS + 1, H, IRIS_C)


def q_train_sparse_lineitem(spark, sf):
    """Training on stored non-zero cells only."""
    x, y, net = _sparse_lineitem(spark, sf)
    w0 = W.stack(W.init_coo(spark, net.n_in, H, W_XH_COEF), W.init_coo(spark, H, IRIS_C, W_HO_COEF)).drop("iter")
    with loop_settings(spark):
        x, y = (R.partition_examples(c).persist() for c in (x.where("v <> 0"), y))
    out = train_relational(x, y, w0, net, LR, 2, reduction="mean", sparse=True)
    x.unpersist()
    y.unpersist()
    return finish(out)


def _folder(spark, name: str) -> str:
    """A new folder of a query's own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cellgrad/{name}-{uuid.uuid4().hex}"


def _csv_round_trip(spark, sf, header: bool) -> DataFrame:
    li = TB.lineitem_raw(spark, sf)
    flat = li.select(*[F.col(src).cast("double").alias(c) for c, (_, src, _, _) in zip(FI.IRIS_COLUMNS, TB.LINEITEM_FEATURES)],
                     F.col("species").cast("int").alias(FI.IRIS_LABEL))
    path = _folder(spark, "csv")
    FI.write_features(flat, path, header=header)
    back = FI.read_features(spark, path, FI.iris_schema(), header=header)
    return finish(back.groupBy(FI.IRIS_LABEL).agg(F.count("*").alias("n_rows"), *[
        F.sum(c).alias(c) for c in FI.IRIS_COLUMNS], *[F.max(c).alias(f"max_{c}") for c in FI.IRIS_COLUMNS]))


def q_scan_csv_header(spark, sf):
    """All lineitem rows written as CSV files with headers and scanned again."""
    return _csv_round_trip(spark, sf, True)


def q_scan_csv_plain(spark, sf):
    """The same without headers."""
    return _csv_round_trip(spark, sf, False)


def q_scan_csv_wide(spark, sf):
    """The embeddings as wide CSV rows, label first, to cells."""
    e = Emb(spark, sf)
    schema = FI.mnist_schema(e.net.n_in)
    pixels = schema.names[1:]
    path = _folder(spark, "csv")
    FI.write_features(e.ex.select(F.col("label").cast("double").alias("label"),
                                  *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate(pixels)]), path, header=False)
    back = FI.read_features(spark, path, schema, header=False)
    packed = back.select("label", A.pack(pixels).alias("x"))
    return finish(R.matrix_avg(packed.select("label", F.array("x").alias("m")), "m", ["label"])
                  .select("label", "j", "v"))


def _log_run(hist: DataFrame, name: str, lr: float) -> DataFrame:
    """Log lines of a scored run, a version each, written down: the one task that
    writes a log would run the final aggregate of every shuffle partition itself."""
    share = hist.groupBy("id").agg((F.sum(F.when(F.col("correct"), F.col("count")).otherwise(0)) / F.sum("count")).alias("hit"))
    return materialize(share.select(
        F.concat_ws(",", F.lit(name), F.lit(H), F.lit(0), F.lit(lr), F.col("id").cast("string"), F.lit(0.5),
                    F.col("hit").cast("string")).alias("line")), "log-lines")


def q_merge_result_logs(spark, sf):
    """Two trained and scored runs logged by two writers, one file with a header
    per run and a line that was cut off; scanned, told apart and merged."""
    e = Emb(spark, sf)
    runs = []
    for net, lr in ((e.net, MEAN_LR), (e.net_ts, ARRAY_LR)):
        hist = AP.train_array(e.vectors(), e.w0, net, lr, STEPS, TRAIN_LIMIT, "mean")
        runs.append(materialize(AP.score_history(e.vectors(), hist, net, STEPS + 1), "scored"))
    columns = FI.RESULT_LOG_COLUMNS + ["accuracy"]
    head = spark.range(1).select(F.lit(",".join(columns)).alias("line"))
    cut = spark.range(1).select(F.lit("cellgrad-sigmoid,8,").alias("line"))
    other = spark.range(1).select(F.lit("Operator,atts,size,lr,iter,execution_time,accuracy").alias("line"))
    first, second = _log_run(runs[0], "cellgrad-sigmoid", MEAN_LR), _log_run(runs[1], "cellgrad-softmax", ARRAY_LR)
    paths = _folder(spark, "log"), _folder(spark, "log")
    # A line per version: one file each, as a writer on one machine leaves it.
    head.union(first).union(head).union(cut).coalesce(1).write.text(paths[0])
    other.union(second).coalesce(1).write.text(paths[1])
    scans = [FI.scan_log(spark, p, columns) for p in paths]
    counts = FI.log_counts(scans[0].unionByName(scans[1])).agg(F.sum("headers").alias("h"), F.sum("bad").alias("b"))
    counts = materialize(counts, "log-counts")
    return finish(FI.merge_scans(scans, ["accuracy"]).select(
        "name", "atts", F.col("limit").alias("row_limit"), "lr", "iter", "accuracy",
        counts.select("h").scalar().alias("headers"), counts.select("b").scalar().alias("bad_lines")))


# Models of a store: one append each, a region's key as the wanted id.
STORED = (TL.Setting(1, H, 0.01, 2), TL.Setting(2, 4, 0.02, 1), TL.Setting(3, 16, 0.005, 1))
WANTED = ("AMERICA", "EUROPE")


def stored_models(spark, e: Emb, path: str) -> MO.ModelStore:
    """``STORED`` trained on the embeddings in one sweep and appended, each
    twice (the repeat adds nothing)."""
    start = None
    for k in STORED:
        w = W.tag(W.stack(W.init_coo(spark, e.net.n_in, k.n_hidden, W_XH_COEF),
                          W.init_coo(spark, k.n_hidden, e.classes, W_HO_COEF)).drop("iter"), w_id=k.w_id)
        start = w if start is None else start.unionByName(w)
    hist = materialize(TL.train_sweep(e.x, e.y, start, STORED, e.net.n_in, e.classes), "sweep")
    store = MO.ModelStore(spark, path)
    for k in (*STORED, *STORED):
        last = hist.where((F.col("w_id") == k.w_id) & (F.col("iter") == k.steps)).drop("iter")
        store.append(last, f"model-{k.w_id}")
    return store


def wanted_regions(spark, sf) -> DataFrame:
    regions = TB.table(spark, sf, "region").where(F.col("r_name").isin(*WANTED))
    return regions.select(F.col("r_regionkey").cast("long").alias("w_id"))


def q_score_wanted_models(spark, sf):
    """Models trained on the embeddings, kept in a store, and those that the
    region table asks for scored on all examples."""
    e = Emb(spark, sf)
    kept = stored_models(spark, e, _folder(spark, "models")).wanted(wanted_regions(spark, sf))
    xh, ho = (kept.where(F.col("id") == m).select("w_id", "i", "j", "v") for m in (0, 1))
    return finish(E.predict_models(e.x, xh, ho, e.net.n_in, [k.n_hidden for k in STORED], e.classes))


def _bucketed(spark, e: Emb) -> tuple[DataFrame, DataFrame]:
    n = BK.buckets_for(e.x.count(), spark)
    out = []
    for cells in (e.x, e.y):
        name = f"cellgrad_cells_{uuid.uuid4().hex}"
        out.append(BK.write_cells(cells, _folder(spark, "cells"), name, n))
        spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return out[0], out[1]


def q_hadamard_bucketed(spark, sf):
    x, _ = _bucketed(spark, Emb(spark, sf))
    with loop_settings(spark):
        return finish(materialize(coo.hadamard(x, x), "hadamard"))


def q_gradient_bucketed(spark, sf):
    e = Emb(spark, sf)
    e.x, e.y = _bucketed(spark, e)
    with loop_settings(spark):
        return finish(materialize(_train_gradient(e), "gradient"))


def q_train_script(spark, sf):
    """The run of ``train_relational`` as one SQL script."""
    e = Emb(spark, sf)
    return finish(SC.train_script(e.x, e.y, e.w0, e.net, LR, STEPS))


def q_index_grid_sql(spark, sf):
    """Class positions of every example by a table function in SQL text."""
    register_table_functions(spark)
    TB.embedding_examples(spark, sf).createOrReplaceTempView("cg_grid_examples")
    return finish(spark.sql("SELECT e.i, g.j FROM cg_grid_examples e, LATERAL index_row(e.label + 1) g"))


def q_matrix_grid_sql(spark, sf):
    """All cell positions of each example's features by its class."""
    register_table_functions(spark)
    TB.embedding_examples(spark, sf).createOrReplaceTempView("cg_grid_examples")
    return finish(spark.sql("SELECT g.i, g.j, count(*) AS examples, sum(e.x[CAST(g.i - 1 AS INT)]) AS total "
                            "FROM cg_grid_examples e, LATERAL index_grid(size(e.x), e.label + 1) g GROUP BY g.i, g.j"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
