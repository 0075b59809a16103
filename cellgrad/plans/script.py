"""Training as one SQL script: a loop over a step table, in Spark's SQL scripting.

The script holds the whole run: it fills step 0, then each turn of the loop
reads the weights of one step (a partition of the step table), makes a forward
and a backward pass in one INSERT and adds the next step.  It is the same
descent as ``relational.train_relational`` (sigmoid, summed gradient) for users
who work in SQL text alone.

The example cells are tables bucketed by example id (``sources.buckets``), so a
step's joins on it need no exchange.  The step table is external, in the shared checkpoint folder, so a step is
written once and for all and its lineage ends there; the catalog entries
go when the run is over, the files stay under the returned DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cellgrad.functions.scalar import register_sql_functions
from cellgrad.plans.relational import Net
from cellgrad.session import CELL_ROW_BYTES, broadcast_cap, ensure_checkpoint_dir, loop_settings
from cellgrad.sources.buckets import buckets_for, write_cells

SCHEMA = "id BIGINT, i BIGINT, j BIGINT, v DOUBLE, iter BIGINT"


def training_script(steps_table: str, x: str, y: str, start: str, lr: float, steps: int,
                    path: str, hint: str = "") -> str:
    """The SQL text.  ``x``, ``y``, ``start``: tables or views of feature cells,
    one-hot cells ``(i, j, v)`` and start weights ``(id, i, j, v)``; ``hint``:
    a join hint for the weights ``w``."""
    return f"""
BEGIN
  DECLARE step BIGINT DEFAULT 0;
  CREATE TABLE {steps_table} ({SCHEMA}) USING parquet PARTITIONED BY (iter) LOCATION '{path}';
  INSERT INTO {steps_table} SELECT id, i, j, v, 0L FROM {start};
  WHILE step < {int(steps)} DO
    INSERT INTO {steps_table}
    WITH w AS (SELECT id, i, j, v FROM {steps_table} WHERE iter = step),
    hidden AS (
      SELECT {hint} x.i, w.j, sig(sum(x.v * w.v)) AS v
      FROM {x} x JOIN w ON w.id = 0 AND x.j = w.i GROUP BY x.i, w.j),
    scores AS (
      SELECT {hint} h.i, w.j, sig(sum(h.v * w.v)) AS v
      FROM hidden h JOIN w ON w.id = 1 AND h.j = w.i GROUP BY h.i, w.j),
    out_err AS (
      SELECT s.i, s.j, 2D * (s.v - y.v) * d_sig(s.v) AS v
      FROM scores s JOIN {y} y ON s.i = y.i AND s.j = y.j),
    carried AS (
      SELECT {hint} e.i, w.i AS j, sum(e.v * w.v) AS v
      FROM out_err e JOIN w ON w.id = 1 AND e.j = w.j GROUP BY e.i, w.i),
    hidden_err AS (
      SELECT c.i, c.j, c.v * d_sig(h.v) AS v
      FROM carried c JOIN hidden h ON c.i = h.i AND c.j = h.j),
    products AS (
      SELECT 0L AS id, x.j AS i, e.j, x.v * e.v AS v FROM {x} x JOIN hidden_err e ON x.i = e.i
      UNION ALL
      SELECT 1L AS id, h.j AS i, e.j, h.v * e.v AS v FROM hidden h JOIN out_err e ON h.i = e.i),
    moves AS (SELECT id, i, j, sum(v) AS v FROM products GROUP BY id, i, j)
    SELECT {hint} m.id, m.i, m.j, w.v - CAST({float(lr)!r} AS DOUBLE) * m.v, step + 1
    FROM moves m JOIN w ON m.id = w.id AND m.i = w.i AND m.j = w.j;
    SET step = step + 1;
  END WHILE;
END"""


def train_script(x: DataFrame, y: DataFrame, w0: DataFrame, net: Net, lr: float, steps: int) -> DataFrame:
    """Runs the script; all versions ``(iter, id, i, j, v)``, as
    ``train_relational`` with the sigmoid preset and the summed gradient.
    Without examples only step 0 has weights."""
    if net.preset != "sigmoid":
        raise ValueError("the script trains the sigmoid preset")
    spark = x.sparkSession
    register_sql_functions(spark)
    run = uuid.uuid4().hex
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cellgrad/script-{run}"
    names = {k: f"cellgrad_{k}_{run}" for k in ("x", "y", "w0", "steps")}
    w0.select("id", "i", "j", "v").createOrReplaceTempView(names["w0"])
    fits = net.cells * CELL_ROW_BYTES <= broadcast_cap(spark)
    buckets = buckets_for(x.count(), spark)
    try:
        for name, cells in (("x", x), ("y", y)):
            write_cells(cells, f"{path}-{name}", names[name], buckets)
        with loop_settings(spark):
            spark.sql(training_script(names["steps"], names["x"], names["y"], names["w0"], lr, steps, path,
                                      "/*+ BROADCAST(w) */" if fits else "")).collect()
    finally:
        for k in ("x", "y", "steps"):
            spark.sql(f"DROP TABLE IF EXISTS {names[k]}")
        spark.catalog.dropTempView(names["w0"])
    return spark.read.schema("id long, i long, j long, v double, iter long").parquet(path) \
        .select("iter", "id", "i", "j", "v")
