"""Forward pass, back-propagation and gradient descent on cell tables.

Network: input -> one hidden layer -> output, no biases.  Presets:

* ``sigmoid``: sigmoid on both layers, derivative a(1-a) on both.
* ``tanh_softmax``: tanh hidden layer, softmax output, and the derivative
  1 - a*a on *both* layers (the recorded array workload uses this rule for
  the softmax layer too; it is not the true softmax derivative).

Scale notes (see README): training multiplies blocks of cells
(``operators.tiles``), as a cell product has a joined row for each single
multiplication.  The example tiles are hash partitioned by block once and
cached; weights are broadcast behind a shape bound.  One step then is one job
with one exchange over the tiny gradient, that ends in the step's folder of the
shared history, which also cuts the lineage.  Nets of few inputs and outputs train
on whole rows (``operators.strips``) in the same loop.  Results are those of the
cell operators above the loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.functions.scalar import d_sigmoid, d_sqloss, d_tanh, sigmoid, tanh
from cellgrad.operators import coo
from cellgrad.operators import strips as S
from cellgrad.operators import tiles as T
from cellgrad.operators.reshape import first_rows
from cellgrad.operators.weights import HO, XH, unstack
from cellgrad.session import CELL_ROW_BYTES, VersionStore, bounded_broadcast, loop_settings, partitions_for

PRESETS = ("sigmoid", "tanh_softmax")


@dataclass(frozen=True)
class Net:
    n_in: int
    n_hidden: int
    n_out: int
    preset: str = "sigmoid"

    def __post_init__(self):
        if self.preset not in PRESETS:
            raise ValueError(f"preset must be one of {PRESETS}")

    @property
    def xh_cells(self) -> int:
        return self.n_in * self.n_hidden

    @property
    def ho_cells(self) -> int:
        return self.n_hidden * self.n_out

    @property
    def cells(self) -> int:
        return self.xh_cells + self.ho_cells

    def hidden_act(self, s):
        return tanh(s) if self.preset == "tanh_softmax" else sigmoid(s)

    def out_act(self, s):
        return s if self.preset == "tanh_softmax" else sigmoid(s)

    def deriv(self, a):
        return d_tanh(a) if self.preset == "tanh_softmax" else d_sigmoid(a)


# ------------------------------------------------------------------ forward
def hidden_layer(x: DataFrame, w_xh: DataFrame, net: Net) -> DataFrame:
    return coo.matmul(x, w_xh, b_bound=net.xh_cells, act=net.hidden_act)


def output_layer(hidden: DataFrame, w_ho: DataFrame, net: Net) -> DataFrame:
    s = coo.matmul(hidden, w_ho, b_bound=net.ho_cells, act=net.out_act)
    return coo.softmax_rows(s) if net.preset == "tanh_softmax" else s


def forward(x: DataFrame, w_xh: DataFrame, w_ho: DataFrame, net: Net):
    """Returns (hidden, output) values."""
    hidden = hidden_layer(x, w_xh, net)
    return hidden, output_layer(hidden, w_ho, net)


# ----------------------------------------------------------------- backward
def loss_gradient(out: DataFrame, y: DataFrame) -> DataFrame:
    """2(a - y) over the cells that have a label cell (inner join)."""
    return coo.hadamard(out, y.select("i", "j", F.col("v").cast("double").alias("v")),
                        lambda a, t: d_sqloss(a, t))


def output_delta(out: DataFrame, y: DataFrame, net: Net) -> DataFrame:
    """2(a - y) · f'(a), loss and derivative from one join."""
    return coo.hadamard(out, y.select("i", "j", F.col("v").cast("double").alias("v")),
                        lambda a, t: d_sqloss(a, t) * net.deriv(a))


def hidden_delta(out_err: DataFrame, w_ho: DataFrame, hidden: DataFrame, net: Net) -> DataFrame:
    """(out_err · w_hoᵀ) ∘ f'(hidden); the transpose is a join-key choice."""
    carried = coo.matmul_bt(out_err, w_ho, b_bound=net.ho_cells)
    return coo.hadamard(carried, hidden, lambda e, a: e * net.deriv(a))


def gradient(x: DataFrame, hidden: DataFrame, hidden_err: DataFrame, out_err: DataFrame) -> DataFrame:
    """Stacked gradient ``(id, i, j, v)``: id 0 = xᵀ·hidden_err, id 1 =
    hiddenᵀ·out_err.  Both contract the example index; their products are
    summed together, so one exchange carries the partial sums of both."""
    def products(left: DataFrame, right: DataFrame, matrix: int) -> DataFrame:
        return (left.select(F.col("i").alias("_ex"), F.col("j").alias("i"), F.col("v").alias("_l"))
                .join(right.select(F.col("i").alias("_ex"), "j", F.col("v").alias("_r")), "_ex")
                .select(F.lit(matrix).cast("long").alias("id"), "i", "j", (F.col("_l") * F.col("_r")).alias("v")))

    both = products(x, hidden_err, XH).unionByName(products(hidden, out_err, HO))
    return both.groupBy("id", "i", "j").agg(F.sum("v").alias("v"))


def step_gradient(x: DataFrame, y: DataFrame, w_xh: DataFrame, w_ho: DataFrame,
                  net: Net, keep: list | None = None) -> DataFrame:
    """Gradient of one step.  With ``keep`` (a list), the hidden activations
    and the output delta, each read by later operators, are persisted for the
    step (filled by the gradient's own job) and appended to ``keep`` so the
    caller can release them; otherwise Spark recomputes them for every use."""
    def kept(df: DataFrame) -> DataFrame:
        if keep is None:
            return df
        keep.append(df.persist())
        return keep[-1]

    hidden = kept(hidden_layer(x, w_xh, net))
    out_err = kept(output_delta(output_layer(hidden, w_ho, net), y, net))
    return gradient(x, hidden, hidden_delta(out_err, w_ho, hidden, net), out_err)


def update(w: DataFrame, g: DataFrame, lr: float, net: Net, divisor: float = 1.0,
           keep_all: bool = False) -> DataFrame:
    """``w - lr * g / divisor`` joined on (id, i, j).  Inner join as recorded:
    a weight without a gradient cell does not carry over.  ``keep_all``: it
    does, its gradient is zero (cells that are zero need not be stored)."""
    factor = F.lit(float(lr) / float(divisor))
    key = ["id", "i", "j"]
    if keep_all:
        bound = bounded_broadcast(g.select(*key, F.col("v").alias("_g")), net.cells)
        return w.select(*key, F.col("v").alias("_w")).join(bound, key, "left").select(
            *key, (F.col("_w") - factor * F.coalesce("_g", F.lit(0.0))).alias("v"))
    wb = bounded_broadcast(w.select(*key, F.col("v").alias("_w")), net.cells)
    return (g.select(*key, F.col("v").alias("_g")).join(wb, key)
            .select(*key, (F.col("_w") - factor * F.col("_g")).alias("v")))


# ------------------------------------------------------------------- tiles
def example_tiles(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature tiles, and target tiles with the sum and the number of the targets
    of each cell.  A cell that is stored several times counts as often; what is
    not stored stays NULL."""
    n = partitions_for(x.count(), CELL_ROW_BYTES, x.sparkSession)
    return (T.to_tiles(x, n_partitions=n, fill=None, add=True),
            T.to_tiles(y, n_partitions=n, fill=None, add=True, counts=True))


def weight_tiles(w: DataFrame, which: int, net: Net) -> DataFrame:
    """One matrix of a stored version; a model in one file needs no exchange."""
    return T.to_tiles(unstack(w.coalesce(VersionStore.files(net.cells)), which))


def tile_gradient(xt: DataFrame, yt: DataFrame, w: DataFrame, net: Net, keep: list) -> DataFrame:
    """``step_gradient`` of ``example_tiles``, as cells ``(id, i, j, v)`` of both
    matrices.  An example without any value has no hidden values and no error,
    nor has an output without a target.  What is read twice is persisted and
    appended to ``keep``."""
    from cellgrad.plans import tiled as TL  # which is written for the Net of this module

    def kept(df: DataFrame) -> DataFrame:
        keep.append(df.persist())
        return keep[-1]

    xh, ho = T.tiles_in(net.n_in, net.n_hidden), T.tiles_in(net.n_hidden, net.n_out)
    w_ho = weight_tiles(w, HO, net)
    hidden = kept(T.matmul(xt, weight_tiles(w, XH, net), b_bound=xh, act=TL.hidden_act(net), gaps=True))
    out = TL.output_layer(hidden, w_ho, net, ho, gaps=True)
    at = ["bi", "bj"]
    out_err = kept(out.selectExpr(*at, *T.renamed("a"))
                   .join(yt.selectExpr(*at, *T.renamed("t"), *[f"n{p}" for p in T.PLACES]), at)
                   .selectExpr(*at, *[f"coalesce(2D * (n{p} * a{p} - t{p}) * {TL.slope(net, f'a{p}')}, 0D) AS {c}"
                                      for p, c in enumerate(T.CELLS)]))
    carried = T.matmul_bt(out_err, w_ho, b_bound=ho)
    known = T.filled(hidden)
    hidden_err = T.hadamard(carried, known, lambda e, a: f"{e} * {TL.slope(net, a)}")

    def pairs(left: DataFrame, right: DataFrame, which: int) -> DataFrame:
        both = left.selectExpr("bi AS _ex", f"{which}L AS id", "bj AS bi", *T.renamed("a")).join(
            right.selectExpr("bi AS _ex", "bj", *T.renamed("b")), "_ex")
        return both.select("id", "bi", "bj", *[f"{s}{p}" for s in "ab" for p in T.PLACES])

    both = pairs(T.filled(xt), hidden_err, XH).unionByName(pairs(known, out_err, HO))
    return T.to_cells(T.sum_products(both, ["id"], True, False), ["id"])


def trained_rows(xt: DataFrame, yt: DataFrame) -> DataFrame:
    """The rows ``(id, i)`` of x's and the columns of y's index that some trained
    example has a value in: only their weights have a gradient."""
    rows = range(T.SIZE)
    place = lambda side, r, c: f"{side}{r * T.SIZE + c}"
    any_of = lambda side, r: "coalesce(" + ", ".join(place(side, r, c) for c in rows) + ") IS NOT NULL"

    def seen(a: DataFrame, b: DataFrame, which: int) -> DataFrame:
        flags = b.selectExpr("bi", *[f"{any_of('c', r)} AS f{r}" for r in rows]).groupBy("bi").agg(
            *[F.expr(f"bool_or(f{r}) AS f{r}") for r in rows])
        used = a.join(flags, "bi").groupBy("bj").agg(*[F.expr(
            "bool_or(" + " OR ".join(f"(f{r} AND {place('c', r, c)} IS NOT NULL)" for r in rows) + f") AS u{c}") for c in rows])
        return used.select(F.lit(which).cast("long").alias("id"), "bj", F.posexplode(F.array(*[f"u{c}" for c in rows])).alias(
            "_p", "_u")).where("_u").selectExpr("id", f"CAST(bj * {T.SIZE} + _p + 1 AS BIGINT) AS k")

    return seen(xt, yt, XH).unionByName(seen(yt, xt, HO))


# ------------------------------------------------------------------ strips
def forward_strips(strips: DataFrame, blocks: DataFrame, net: Net, by) -> DataFrame:
    """Outputs ``(*by, a1 ..)`` of strips ``x1 ..`` under the model or models of
    ``blocks``; an output without weights is NULL.  What a strip lacks is zero."""
    from cellgrad.plans import tiled as TL  # which is written for the Net of this module

    x, s, a, there = (S.names(p, n) for p, n in zip("xsap", (net.n_in, *[net.n_out] * 3)))
    h = S.names("h", S.BLOCK)
    rows = S.layer(S.joined(strips, blocks), S.filled(x), S.into(net.n_in), h, TL.hidden_act(net))
    out = S.sum_blocks(rows, by, h, S.out_of(net.n_out), there, s)
    if net.preset == "tanh_softmax":
        return S.softmax(out, s, a)
    return S.added(out, a, [TL.out_act(net)(c) for c in s])


def example_strips(x: DataFrame, y: DataFrame, net: Net) -> DataFrame:
    """The examples that train, with a value and a target: ``x1 ..``, the sums of
    the targets ``t1 ..`` and their numbers ``n1 ..``."""
    both = S.to_strips(x, net.n_in, y, net.n_out)
    return both.where(f"i IS NOT NULL AND {S.any_of(S.names('x', net.n_in))} AND {S.any_of(S.names('t', net.n_out))}")


def strip_gradient(strips: DataFrame, w: DataFrame, net: Net) -> DataFrame:
    """``step_gradient`` of ``example_strips``, as cells ``(id, i, j, v)`` of both
    matrices."""
    from cellgrad.plans import tiled as TL

    x, a, t, n, e = (S.names(p, k) for p, k in zip("xatne", (net.n_in, *[net.n_out] * 4)))
    h, d = S.names("h", S.BLOCK), S.names("d", S.BLOCK)
    blocks = S.model(w.coalesce(VersionStore.files(net.cells)), net.n_in, net.n_hidden, net.n_out)
    out = forward_strips(strips, blocks, net, strips.columns)
    # An output without a target has no error.
    out_err = out.selectExpr(*x, *[f"coalesce(2D * ({k} * {p} - {q}) * {TL.slope(net, p)}, 0D) AS {c}"
                                   for k, p, q, c in zip(n, a, t, e)])
    rows = S.layer(S.joined(out_err, blocks), S.filled(x), S.into(net.n_in), h, TL.hidden_act(net))
    carried = S.product_bt(e, S.out_of(net.n_out))
    rows = S.added(rows, d, [f"({c}) * {TL.slope(net, p)}" for c, p in zip(carried, h)])
    return S.sum_strips(rows, net.n_hidden, S.filled(x), e)


def trained_columns(strips: DataFrame, net: Net) -> list[tuple[int, int]]:
    """``trained_rows`` of ``example_strips``."""
    columns = [(XH, j, c) for j, c in enumerate(S.names("x", net.n_in), 1)] + \
        [(HO, j, c) for j, c in enumerate(S.names("t", net.n_out), 1)]
    seen = strips.agg(*[F.expr(f"coalesce(bool_or({c} IS NOT NULL), false) AS {c}") for *_, c in columns]).first()
    return [(which, j) for which, j, c in columns if seen[c]]


# -------------------------------------------------------------------- loop
def train_relational(x: DataFrame, y: DataFrame, w0: DataFrame, net: Net, lr: float,
                     steps: int, limit: int | None = None, reduction: str = "sum",
                     n_train: int | None = None, sparse: bool = False, path: str | None = None) -> DataFrame:
    """Full-batch gradient descent; returns all versions ``(iter, id, i, j, v)``
    for iter 0..steps.

    ``x`` / ``y`` are feature and one-hot cells, ideally hash partitioned by
    ``i`` (see ``prepare``).  ``w0`` is the stacked start ``(id, i, j, v)``.
    ``limit`` keeps examples with ``i < limit``.  ``reduction`` "mean" divides
    the gradient by the number of labelled training examples.

    ``sparse``: feature cells that are zero are left out of every product (or
    need not be there at all) and weights that get no gradient stay; the
    versions are those of the dense run.  An example needs one feature cell to
    train.

    ``path``: a folder of the run's own in shared storage.  A later call with it
    goes on after the last complete step; a half-written step is done again.
    """
    if reduction not in ("sum", "mean"):
        raise ValueError("reduction must be 'sum' or 'mean'")
    spark = x.sparkSession
    store = VersionStore(spark, path=path)
    done = store.last_step() if path else -1
    with loop_settings(spark):
        x_t = first_rows(x, limit) if limit is not None else x
        divisor = 1.0
        if reduction == "mean" and done < steps:
            # Only labelled examples train.
            divisor = float(n_train if n_train is not None else
                            x_t.select("i").distinct().join(y.select("i").distinct(), "i", "left_semi").count())
        if sparse:
            x_t = nonzero(x_t)
        w = store.write(0, w0, net.cells) if done < 0 else store.read(done)
        strips = S.fits(net.n_in, net.n_hidden, net.n_out, 1, spark)
        kept: list = []
        if done < steps:
            kept = [t.persist() for t in ([example_strips(x_t, y, net)] if strips else example_tiles(x_t, y))]
            # Weights without a gradient cell: the input rows and the outputs that
            # no example has.
            used = trained_columns(*kept, net) if strips else [(r["id"], r["k"]) for r in trained_rows(*kept).collect()]
            in_use = F.when(F.col("id") == XH, F.col("i").isin([k for m, k in used if m == XH])).otherwise(
                F.col("j").isin([k for m, k in used if m == HO]))
        for step in range(max(done, 0) + 1, steps + 1):
            keep: list = []
            g = (strip_gradient(*kept, w, net) if strips else tile_gradient(*kept, w, net, keep)).where(in_use)
            w = store.write(step, update(w, g, lr, net, divisor or 1.0, keep_all=sparse), net.cells)
            for df in keep:
                df.unpersist()
        for df in kept:
            df.unpersist()
    return store.history(steps)


def nonzero(cells: DataFrame) -> DataFrame:
    """Sparse storage of a cell table."""
    return cells.where(F.col("v") != 0)


def cells_per_step(history: DataFrame) -> DataFrame:
    return history.groupBy("iter").agg(F.count(F.lit(1)).alias("count"))


def distinct_steps(history: DataFrame) -> DataFrame:
    return history.select("iter").distinct()
