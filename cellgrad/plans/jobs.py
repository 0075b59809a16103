"""End-to-end jobs: load → reshape → initialise → train → score → log.

``train_and_score`` is the benchmark run of the recorded workload (one
setting of hidden size, training rows, learning rate and steps) in either
encoding; ``sweep`` runs a list of settings and appends one result-log row
per setting.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.functions import arrays as A
from cellgrad.functions.scalar import W_HO_COEF, W_XH_COEF
from cellgrad.operators import reshape as R
from cellgrad.operators import weights as W
from cellgrad.plans import arrays as AP
from cellgrad.plans import evaluate as E
from cellgrad.plans.relational import Net, train_relational
from cellgrad.session import loop_settings
from cellgrad.sources.files import log_result


def prepare(features: DataFrame, feature_cols: Sequence[str], label_col: str, n_classes: int,
            id_col: str | None = None, order_cols: Sequence[str] | None = None,
            div: float = 1.0, add: float = 0.0, copies: int = 1):
    """Wide feature table → (cells x, one-hot cells y, array rows).  The cells
    are persisted; ``release`` them when the runs are done.

    ``copies`` > 1 replicates the rows (the scaled load); ids come from
    ``id_col`` or, if absent, from dense row numbers over ``order_cols``
    (plus the copy number)."""
    df = features
    order = list(order_cols or feature_cols + [label_col])
    if copies > 1:
        df = R.replicate(df, copies)
        order = ["copy"] + order
    if id_col is None:
        df = R.assign_ids(df, order, "id")
        id_col = "id"
    x = R.partition_examples(R.to_coo(df, id_col, feature_cols, div, add))
    y = R.partition_examples(R.one_hot_coo(df, label_col, n_classes, id_col=id_col))
    with loop_settings(df.sparkSession):
        x, y = x.persist(), y.persist()
    rows = df.select(F.col(id_col).cast("long").alias("i"), A.pack(feature_cols, div, add).alias("x"),
                     A.one_hot(label_col, n_classes).alias("y"))
    return x, y, rows


def release(*cells: DataFrame) -> None:
    for df in cells:
        df.unpersist()


def initial_weights(spark, net: Net, seed: int | None = None) -> DataFrame:
    xh = W.init_coo(spark, net.n_in, net.n_hidden, W_XH_COEF, seed)
    ho = W.init_coo(spark, net.n_hidden, net.n_out, W_HO_COEF, None if seed is None else seed + 1)
    return W.stack(xh, ho).drop("iter")


def train_and_score(x: DataFrame, y: DataFrame, rows: DataFrame, net: Net, lr: float, steps: int,
                    limit: int | None = None, encoding: str = "relational",
                    reduction: str | None = None, seed: int | None = None,
                    w0: DataFrame | None = None) -> dict:
    """Train for ``steps`` steps on ``i < limit`` and score every version on
    all rows.  Returns the best precision, the history and the run time."""
    spark = x.sparkSession
    w0 = w0 if w0 is not None else initial_weights(spark, net, seed)
    start = time.perf_counter()
    if encoding == "relational":
        hist = train_relational(x, y, w0, net, lr, steps, limit, reduction or "sum")
        acc = E.accuracy_per_step(E.forward_all_steps(x, hist, net, steps + 1), y)
        best = E.best_accuracy(acc).first()["precision"]
    elif encoding == "array":
        hist = AP.train_array(rows, w0, net, lr, steps, limit, reduction or "mean")
        best = E.best_share(AP.score_history(rows, hist, net, steps + 1), "id").first()["precision"]
    else:
        raise ValueError("encoding must be 'relational' or 'array'")
    return {"precision": best, "history": hist, "seconds": time.perf_counter() - start}


def sweep(x: DataFrame, y: DataFrame, rows: DataFrame, n_in: int, n_out: int,
          settings: Sequence[dict], name: str, log_path: str | None = None,
          encoding: str = "relational", preset: str = "sigmoid") -> list[dict]:
    """Run settings ``{atts, limit, lr, iter}`` one after another; append one
    ``name, atts, limit, lr, iter, execution_time, accuracy`` row each."""
    out = []
    for s in settings:
        net = Net(n_in, int(s["atts"]), n_out, preset)
        r = train_and_score(x, y, rows, net, float(s["lr"]), int(s["iter"]), s.get("limit"), encoding)
        row = {"name": name, "atts": int(s["atts"]), "limit": s.get("limit"), "lr": float(s["lr"]),
               "iter": int(s["iter"]), "execution_time": r["seconds"], "accuracy": r["precision"]}
        if log_path:
            log_result(x.sparkSession, row, log_path)
        out.append(row)
    return out
