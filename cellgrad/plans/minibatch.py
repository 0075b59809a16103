"""Mini-batch training over stored example cells.

``ExampleStore`` keeps the feature and one-hot cells in the shared checkpoint
folder, range partitioned by example id: a folder per batch of consecutive ids.
A step reads one batch and no other files (a partition filter in its plan), so
its cost is the batch's, whatever the number of examples.

Batches are (i - 1) div size; the last one may be short.  Step s takes batch
(s - 1) mod the number of batches: after the last one it starts again at the
first.  Without a number of steps there are rows div size of them, one at least,
as in the recorded runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.operators.weights import HO, XH, unstack
from cellgrad.plans.relational import Net, step_gradient, update
from cellgrad.session import (
    CELL_ROW_BYTES, VersionStore, ensure_checkpoint_dir, loop_settings, partitions_for)

CELLS = "i long, j long, v double, batch long"


class ExampleStore:
    """Cells ``x`` and ``y`` by batch of ``size`` consecutive example ids."""

    def __init__(self, x: DataFrame, y: DataFrame, size: int):
        if size < 1:
            raise ValueError("a batch holds one example at least")
        self.spark, self.size = x.sparkSession, size
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/cellgrad/examples-{uuid.uuid4().hex}"
        for name, cells in (("x", x), ("y", y)):
            placed = cells.select("i", "j", F.col("v").cast("double").alias("v"),
                                  F.expr(f"(i - 1) div {size}").alias("batch"))
            n = partitions_for(placed.count(), CELL_ROW_BYTES, self.spark)
            (placed.repartitionByRange(n, "batch", "i").sortWithinPartitions("batch", "i", "j")
             .write.partitionBy("batch").parquet(f"{self.path}/{name}"))
        self.rows = int(x.agg(F.max("i")).first()[0] or 0)
        self.batches = max(1, -(-self.rows // size))

    def cells(self, name: str, batch: int) -> DataFrame:
        """The cells of one batch; only its folder is read."""
        stored = self.spark.read.schema(CELLS).parquet(f"{self.path}/{name}")
        return stored.where(F.col("batch") == batch).drop("batch")


def train_minibatch(store: ExampleStore, w0: DataFrame, net: Net, lr: float, steps: int | None = None,
                    reduction: str = "mean") -> DataFrame:
    """All versions ``(iter, id, i, j, v)``; each step moves the weights by the
    gradient of its batch, summed or divided by the batch's labelled examples.
    A batch without any leaves the weights as they are."""
    if reduction not in ("sum", "mean"):
        raise ValueError("reduction must be 'sum' or 'mean'")
    steps = max(1, store.rows // store.size) if steps is None else steps
    versions = VersionStore(store.spark)
    with loop_settings(store.spark):
        w = versions.write(0, w0, net.cells)
        for step in range(1, steps + 1):
            batch = (step - 1) % store.batches
            x, y = store.cells("x", batch), store.cells("y", batch)
            trained = x.select("i").distinct().join(y.select("i").distinct(), "i", "left_semi").count()
            if trained:
                keep: list = []
                g = step_gradient(x, y, unstack(w, XH), unstack(w, HO), net, keep)
                w = update(w, g, lr, net, float(trained) if reduction == "mean" else 1.0, keep_all=True)
                w = versions.write(step, w, net.cells)
                for df in keep:
                    df.unpersist()
            else:
                w = versions.write(step, w, net.cells)
    return versions.history()
