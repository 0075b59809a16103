"""Array encoding: one row per example, ``x`` and ``y`` as ``ARRAY<DOUBLE>``.

Training and batch scoring run NumPy over Arrow batches inside Spark tasks
(``mapInArrow``): each task multiplies its whole batch as a matrix, and for
training emits only its partial gradient, at most ``d·h + h·c`` cells.  A
Spark aggregate sums the partials, a broadcast join applies the update, and
the new weights go to the shared history.

A model is shipped as blocks of hidden units, each a broadcast variable within
``cellgrad.broadcast.maxBytes``; a layer is the sum over the blocks, so any
model size takes the same path and gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.functions import arrays as A
from cellgrad.operators.weights import HO, XH
from cellgrad.plans.relational import Net, update
from cellgrad.session import VersionStore, broadcast_cap, loop_settings, ship_package

GRAD_SCHEMA = "id long, i long, j long, v double"


# --------------------------------------------------------------- numpy side
def _act(z, kind):
    if kind == "tanh":
        return np.tanh(z)
    if kind == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return 1.0 / (1.0 + np.exp(-z))


def np_forward(x, blocks, preset):
    """Hidden values per block, and the output values."""
    hidden, z = [], 0.0
    for w1, w2 in blocks:
        hidden.append(_act(x @ w1, "tanh" if preset == "tanh_softmax" else "sigmoid"))
        z = z + hidden[-1] @ w2
    return hidden, _act(z, "softmax" if preset == "tanh_softmax" else "sigmoid")


def np_gradient(x, y, blocks, preset):
    """Summed gradient of the squared loss for one batch, a pair per block.
    Outputs without a target (NaN) have no error."""
    slope = (lambda a: 1.0 - a * a) if preset == "tanh_softmax" else (lambda a: a * (1.0 - a))
    hidden, out = np_forward(x, blocks, preset)
    err = np.where(np.isnan(y), 0.0, 2.0 * (out - y) * slope(out))
    return [(x.T @ ((err @ w2.T) * slope(a)), a.T @ err) for (_, w2), a in zip(blocks, hidden)]


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _cells(matrix_id: int, m: np.ndarray, rows_from: int = 0, cols_from: int = 0):
    r, c = m.shape
    ii = np.repeat(np.arange(1, r + 1, dtype=np.int64) + rows_from, c)
    jj = np.tile(np.arange(1, c + 1, dtype=np.int64) + cols_from, r)
    return (np.full(r * c, matrix_id, dtype=np.int64), ii, jj, m.reshape(-1))


# --------------------------------------------------------------- Spark side
def _dense(pdf, net: Net):
    w1 = np.zeros((net.n_in, net.n_hidden))
    w2 = np.zeros((net.n_hidden, net.n_out))
    for mid, m in ((XH, w1), (HO, w2)):
        part = pdf[pdf["id"] == mid]
        m[part["i"].to_numpy() - 1, part["j"].to_numpy() - 1] = part["v"].to_numpy()
    return w1, w2


def weights_to_numpy(w: DataFrame, net: Net):
    """A stacked model ``(id, i, j, v)``, bounded by the net's shape, as two
    dense arrays."""
    return _dense(w.select("id", "i", "j", "v").toPandas(), net)


class Blocks:
    """A model on the executors: blocks of hidden units, a broadcast each."""

    def __init__(self, spark, w1: np.ndarray, w2: np.ndarray):
        width = max(1, int(broadcast_cap(spark) // (8 * (w1.shape[0] + w2.shape[1]))))
        self.shared = [spark.sparkContext.broadcast((w1[:, k:k + width], w2[k:k + width]))
                       for k in range(0, w1.shape[1], width)]

    def values(self):
        return [b.value for b in self.shared]

    def destroy(self):
        for b in self.shared:
            b.destroy()


def training_rows(rows: DataFrame, net: Net) -> DataFrame:
    """The labelled rows: ``x``, and ``y`` fitted to the net's outputs (extra
    classes are left out, a missing one is NULL and has no error)."""
    y = F.transform(F.sequence(F.lit(1), F.lit(net.n_out)), lambda k: F.get("y", k - 1))
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", y.alias("y"))


def gradient_cells(rows: DataFrame, model: Blocks, net: Net) -> DataFrame:
    """Per-partition partial gradients ``(id, i, j, v)`` summed by Spark."""
    d, c, preset = net.n_in, net.n_out, net.preset

    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows == 0:
                continue
            part = np_gradient(_matrix(b, "x", d), _matrix(b, "y", c), model.values(), preset)
            total = part if total is None else [(p + q, r + s) for (p, r), (q, s) in zip(total, part)]
        at = 0
        for g1, g2 in total or []:
            cols = [np.concatenate(p) for p in zip(_cells(XH, g1, 0, at), _cells(HO, g2, at, 0))]
            at += g1.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in cols], names=["id", "i", "j", "v"])

    return (rows.select("x", "y").mapInArrow(partial, GRAD_SCHEMA)
            .groupBy("id", "i", "j").agg(F.sum("v").alias("v")))


def train_array(rows: DataFrame, w0: DataFrame, net: Net, lr: float, steps: int,
                limit: int | None = None, reduction: str = "mean") -> DataFrame:
    """Array trainer; ``rows`` has ``i``, ``x`` (d values) and ``y`` (one-hot;
    NULL for an unlabelled row, which does not train).  Returns all versions
    ``(iter, id, i, j, v)``.  Each input partition sends one partial gradient
    of the model's size per step."""
    if reduction not in ("sum", "mean"):
        raise ValueError("reduction must be 'sum' or 'mean'")
    spark = rows.sparkSession
    ship_package(spark)
    store = VersionStore(spark)
    train = rows.filter(F.col("i") < F.lit(limit)) if limit is not None else rows
    train = training_rows(train, net).persist()
    with loop_settings(spark):
        divisor = float(train.count()) if reduction == "mean" else 1.0
        w = store.write(0, w0, net.cells)
        for step in range(1, steps + 1):
            model = Blocks(spark, *weights_to_numpy(w, net))
            w = store.write(
                step, update(w, gradient_cells(train, model, net), lr, net, divisor or 1.0), net.cells)
            model.destroy()
    train.unpersist()
    return store.history()


def scoring_rows(rows: DataFrame) -> DataFrame:
    """The labelled rows: ``i``, ``x`` and the label's class (1-based, first on
    ties), whatever the number of classes."""
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        "i", "x", A.argmax("y").alias("_class"))


def _hits(batch: pa.RecordBatch, blocks, net: Net) -> np.ndarray:
    _, out = np_forward(_matrix(batch, "x", net.n_in), blocks, net.preset)
    return np.argmax(out, axis=1) + 1 == batch.column(batch.schema.get_field_index("_class")).to_numpy()


def count_correct(rows: DataFrame, models: dict, key: str) -> DataFrame:
    """``(key, correct, count)`` of several models in one pass; ``models``:
    key -> (Blocks, Net).  Each task sends one row per model and outcome."""
    def count(batches):
        acc = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            for ver, (model, net) in models.items():
                hit = _hits(b, model.values(), net)
                acc[ver, True] = acc.get((ver, True), 0) + int(hit.sum())
                acc[ver, False] = acc.get((ver, False), 0) + int((~hit).sum())
        keys = [k for k, n in acc.items() if n]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys]),
                 pa.array([acc[k] for k in keys], pa.int64())], names=[key, "correct", "count"])

    ship_package(rows.sparkSession)
    return (scoring_rows(rows).select("x", "_class").mapInArrow(count, f"{key} long, correct boolean, count long")
            .groupBy(key, "correct").agg(F.sum("count").alias("count")))


def score_history(rows: DataFrame, history: DataFrame, net: Net, n_versions: int, key: str = "id") -> DataFrame:
    """``correct`` counts per weight version.  Versions are read, shipped,
    scored and dropped in groups that fit the broadcast cap (one at least), so
    neither the driver nor a task holds the whole history."""
    spark = rows.sparkSession
    group = max(1, int(broadcast_cap(spark) // (net.cells * 8)))
    counts = []
    for start in range(0, n_versions, group):
        pdf = history.where(F.col("iter").between(start, min(start + group, n_versions) - 1)).toPandas()
        models = {int(v): (Blocks(spark, *_dense(part, net)), net) for v, part in pdf.groupby("iter")}
        counts += [tuple(r) for r in count_correct(rows, models, key).collect()]
        for model, _ in models.values():
            model.destroy()
    return spark.createDataFrame(counts, f"{key} long, correct boolean, count long")


def predict_correct(rows: DataFrame, w1: np.ndarray, w2: np.ndarray, net: Net) -> DataFrame:
    """``(i, correct)`` for one model: one narrow stage, no shuffle."""
    ship_package(rows.sparkSession)
    model = Blocks(rows.sparkSession, w1, w2)

    def flags(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("i")), pa.array(_hits(b, model.values(), net))],
                    names=["i", "correct"])

    return scoring_rows(rows).mapInArrow(flags, "i long, correct boolean")
