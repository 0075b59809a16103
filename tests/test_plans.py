"""Physical-plan properties that matter at scale (checked with explain)."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from cellgrad.operators import coo
from cellgrad.operators import reshape as R
from cellgrad.plans import catalog as K
from cellgrad.plans.relational import forward, step_gradient
from cellgrad.operators.weights import unstack, XH, HO
from cellgrad.session import LOOP_CONF, bounded_broadcast, loop_settings

from conftest import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def shuffles(text: str) -> int:
    return text.count("ENSURE_REQUIREMENTS")


def emb(spark):
    return K.Emb(spark, SF001, partitioned=True)


def test_training_step_has_one_exchange_and_no_sort_of_cached_cells(spark):
    e = emb(spark)
    with loop_settings(spark):
        _, out = forward(e.x, e.w_xh, e.w_ho, e.net)
        assert shuffles(plan(out)) == 0
        keep = []
        text = plan(step_gradient(e.x, e.y, unstack(e.w0, XH), unstack(e.w0, HO), e.net, keep))
    for df in keep:
        df.unpersist()
    assert shuffles(text) == 1   # partial sums of both contractions
    tree = text[:text.index("\n(1) ")]
    top = tree.split("InMemoryRelation")[0].splitlines()
    scans = [k for k, line in enumerate(top) if "InMemoryTableScan" in line]
    assert scans and "Sort" not in top[scans[0] - 1] and "Sort" not in top[scans[0] - 2]


def test_plans_do_not_depend_on_what_ran_before(spark):
    """On a plain session, before and after a training call."""
    keys = ["one_hot_coo_labels", "delta_hidden", "sql_udf_sigmoid", "matmul_at"]
    number = lambda t: re.sub(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]|-[0-9a-f]{32}|\d+", "", t)
    settings = {k: spark.conf.get(k, None) for k in LOOP_CONF}
    before = [number(plan(K.QUERIES[k](spark, SF001))) for k in keys]
    K.QUERIES["train_relational"](spark, SF001).count()
    K.QUERIES["train_array"](spark, SF001).count()
    assert {k: spark.conf.get(k, None) for k in LOOP_CONF} == settings
    assert [number(plan(K.QUERIES[k](spark, SF001))) for k in keys] == before


def test_sql_layer_does_not_shuffle(spark):
    text = plan(K.QUERIES["sql_udf_sigmoid"](spark, SF001))
    assert "SortMergeJoin" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_prunes_columns_and_pushes_filters(spark):
    ex = K.TB.embedding_examples(spark, SF001).filter(F.col("i") < 50)
    text = plan(R.vector_to_coo(ex, "x"))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
    assert "PushedFilters: [IsNotNull(vec_id)" in text


def test_broadcast_only_within_proven_bound(spark):
    small = spark.range(10)
    assert "broadcast" in plan(small.join(bounded_broadcast(small, 10), "id")).lower()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("cellgrad.broadcast.maxBytes", "100")
    try:
        text = plan(small.join(bounded_broadcast(small, 10_000), "id"))
        assert "BroadcastHashJoin" not in text
    finally:
        spark.conf.unset("cellgrad.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_ids_do_not_use_a_global_window(spark):
    li = K.TB.table(spark, SF001, "lineitem").select(*K.TB.LINEITEM_KEY)
    text = plan(R.assign_ids(li, K.TB.LINEITEM_KEY))
    # the sorted rows are read back; the one window is over the count per partition
    assert text.count("Window") and "_n" in text and "Scan parquet" in text and "Sort [l_orderkey" not in text


def test_no_cross_joins_or_row_udfs_in_catalog_plans(spark):
    trains = [k for k in K.QUERIES if re.search("train|step|accuracy|rank_pred|mean_abs|correct", k)]
    for key in K.QUERIES:
        if key in trains:
            continue
        text = plan(K.QUERIES[key](spark, SF001))
        for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
            assert bad not in text, (key, bad)


def test_weights_past_the_cap_give_the_same_result(spark):
    """Past the broadcast cap the join is shuffled over keys x salts."""
    e = emb(spark)
    keys = ["predict_models", "predict_models_correct", "predict_correct", "correct_counts", "train_array"]

    def results():
        return [sorted(map(tuple, K.QUERIES[k](spark, SF001).collect())) for k in keys]

    want = results()
    for cap in (1, 10_000):
        spark.conf.set("cellgrad.broadcast.maxBytes", str(cap))
        try:
            text = plan(coo.matmul(e.x, e.w_xh, b_bound=e.net.xh_cells))
            got = results()
        finally:
            spark.conf.unset("cellgrad.broadcast.maxBytes")
        assert "_salt" in text and "BroadcastHashJoin" not in text
        assert got == want
