"""Training and scoring over tiles, for one setting or a whole sweep at once.

A sweep trains many settings (hidden size, learning rate, row limit, number of
steps) together: weights carry the setting's ``w_id``, the examples are read
once per step for all of them, and the partial gradients of all settings go
through one exchange.  A setting that has done its steps leaves the loop.  One
setting is a sweep of one.

The example tiles are hash partitioned by block and persisted; each step is one
job that ends in the step's folder of the shared history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.operators import tiles as T
from cellgrad.operators.weights import HO, XH
from cellgrad.plans.relational import Net
from cellgrad.session import CELL_ROW_BYTES, VersionStore, bounded_broadcast, loop_settings, partitions_for

KEY = "w_id"
TILES = ", ".join(["w_id long", "id long", "bi long", "bj long", *[f"{c} double" for c in T.CELLS]])


@dataclass(frozen=True)
class Setting:
    """One run of a sweep; ``limit`` keeps examples with i < limit."""

    w_id: int
    n_hidden: int
    lr: float
    steps: int
    limit: int | None = None


def example_tiles(x: DataFrame, y: DataFrame, n_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature and one-hot cells as tiles, hash partitioned by block into a
    number of partitions that follows from the number of cells."""
    n = partitions_for(n_cells if n_cells is not None else x.count(), CELL_ROW_BYTES, x.sparkSession)
    return T.to_tiles(x, n_partitions=n), T.to_tiles(y.select("i", "j", "v"), n_partitions=n, fill=None)


# The presets' functions as SQL text (see ``relational.Net``).
def _sigmoid(s: str) -> str:
    return f"(1D / (1D + exp(-({s}))))"


def hidden_act(net: Net):
    return (lambda s: f"tanh({s})") if net.preset == "tanh_softmax" else _sigmoid


def out_act(net: Net):
    return None if net.preset == "tanh_softmax" else _sigmoid


def slope(net: Net, a: str) -> str:
    return f"(1D - {a} * {a})" if net.preset == "tanh_softmax" else f"({a} * (1D - {a}))"


def matrix(w: DataFrame, which: int) -> DataFrame:
    return T.filled(w.where(F.col("id") == which).drop("id"))


def _bounds(nets: Sequence[Net]) -> tuple[int, int]:
    """Tiles of all nets' input and output matrices."""
    return (sum(T.tiles_in(n.n_in, n.n_hidden) for n in nets), sum(T.tiles_in(n.n_hidden, n.n_out) for n in nets))


def forward(x: DataFrame, w_xh: DataFrame, w_ho: DataFrame, nets: Sequence[Net], key: str = KEY,
            only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hidden, output) tiles of all models ``key`` of the weights."""
    net, (xh, ho) = nets[0], _bounds(nets)
    hidden = T.matmul(x, w_xh, keys=[key], b_bound=xh, act=hidden_act(net), only=only)
    return hidden, output_layer(hidden, w_ho, net, ho, key)


def output_layer(hidden: DataFrame, w_ho: DataFrame, net: Net, bound: int, key: str | None = None,
                 gaps: bool = False) -> DataFrame:
    keys = [key] if key else []
    out = T.matmul(hidden, w_ho, keys=keys, b_bound=bound, act=out_act(net), gaps=gaps)
    return T.softmax_rows(out, net.n_out, keys) if net.preset == "tanh_softmax" else out


def _by_setting(values: dict[int, object], other: str) -> str:
    """The value of a row's setting, as SQL; a sweep's settings are a short list."""
    cases = " ".join(f"WHEN {KEY} = {k} THEN {v!r}{'D' if isinstance(v, float) else ''}" for k, v in values.items())
    return f"(CASE {cases} ELSE {other} END)" if cases else other


def step_gradient(x: DataFrame, y: DataFrame, w: DataFrame, nets: Sequence[Net],
                  limits: dict[int, int] | None = None, keep: list | None = None) -> DataFrame:
    """Gradient tiles ``(w_id, id, bi, bj, c0 ..)`` of all settings in ``w``; each
    sums over the examples below its limit (a setting without one: all).  With
    ``keep`` what is read twice is persisted and appended to it."""
    def kept(df: DataFrame) -> DataFrame:
        if keep is None:
            return df
        keep.append(df.persist())
        return keep[-1]

    net, (xh, ho) = nets[0], _bounds(nets)
    limit = _by_setting(limits, str(1 << 62)) if limits else None
    w_ho = matrix(w, HO)
    hidden = kept(T.matmul(x, matrix(w, XH), keys=[KEY], b_bound=xh, act=hidden_act(net),
                           only=f"{T.row_of(0)} < {limit}" if limits else None))
    out = output_layer(hidden, w_ho, net, ho, KEY)
    # A NULL target (no label cell, no such output) has no error, nor has an
    # example that a limit leaves out.
    loss = T.hadamard(out, y, lambda a, t: f"coalesce(2D * ({a} - {t}) * {slope(net, a)}, 0D)", [KEY])
    if limits:
        loss = loss.selectExpr(KEY, "bi", "bj", *[
            f"CASE WHEN {T.row_of(p)} < {limit} THEN {c} ELSE 0D END AS {c}" for p, c in enumerate(T.CELLS)])
    out_err = kept(loss)
    carried = T.matmul_bt(out_err, w_ho, keys=[KEY], b_bound=ho)
    hidden_err = T.hadamard(carried, hidden, lambda e, a: f"{e} * {slope(net, a)}", [KEY])

    def pairs(left: DataFrame, right: DataFrame, which: int) -> DataFrame:
        own = [k for k in (KEY,) if k in left.columns]
        both = left.selectExpr(*own, "bi AS _ex", f"{which}L AS id", "bj AS bi", *T.renamed("a")).join(
            right.selectExpr(KEY, "bi AS _ex", "bj", *T.renamed("b")), [*own, "_ex"])
        return both.select(KEY, "id", "bi", "bj", *[f"{s}{p}" for s in "ab" for p in T.PLACES])

    both = pairs(x, hidden_err, XH).unionByName(pairs(hidden, out_err, HO))
    return T.sum_products(both, [KEY, "id"], True, False)


def update(w: DataFrame, g: DataFrame, rate: str, bound: int) -> DataFrame:
    """``w - rate * g``; without any training example no weights are left, as
    with cells."""
    key = [KEY, "id", "bi", "bj"]
    key = [KEY, "id", "bi", "bj"]
    weights = bounded_broadcast(w.selectExpr(*key, *T.renamed("w")), bound, T.TILE_BYTES)
    return g.join(weights, key).selectExpr(*key, *[f"w{p} - {rate} * {c} AS {c}" for p, c in enumerate(T.CELLS)])


def labelled(x: DataFrame, y: DataFrame, limits: Sequence[int | None]) -> dict[int | None, int]:
    """Labelled training examples below each limit, in one pass."""
    ids = x.select("i").distinct().join(y.select("i").distinct(), "i", "left_semi")
    limits = sorted(set(limits), key=lambda k: (k is None, k))
    below = [F.count(F.when(F.col("i") < k, 1) if k is not None else F.lit(1)) for k in limits]
    return dict(zip(limits, ids.agg(*below).first()))


def train_sweep(x: DataFrame, y: DataFrame, w0: DataFrame, settings: Sequence[Setting], n_in: int, n_out: int,
                preset: str = "sigmoid", reduction: str = "sum") -> DataFrame:
    """Gradient descent of all ``settings`` at once; ``w0``: the start weights
    ``(w_id, id, i, j, v)``.  Returns ``(w_id, iter, id, i, j, v)``, for each
    setting the versions 0 to its number of steps."""
    if reduction not in ("sum", "mean"):
        raise ValueError("reduction must be 'sum' or 'mean'")
    if len({s.w_id for s in settings}) != len(settings):
        raise ValueError("settings need ids of their own")
    spark = x.sparkSession
    store = VersionStore(spark, TILES)
    nets = {s.w_id: Net(n_in, s.n_hidden, n_out, preset) for s in settings}
    bound = sum(_bounds(list(nets.values())))
    if all(s.limit is not None for s in settings):
        x = x.where(F.col("i") < max(s.limit for s in settings))
    with loop_settings(spark):
        divisor = {}
        if reduction == "mean":
            counts = labelled(x, y, [s.limit for s in settings])
            divisor = {s.w_id: counts[s.limit] for s in settings}
        xt, yt = (t.persist() for t in example_tiles(x, y))
        w = store.write(0, T.to_tiles(w0, [KEY, "id"], fill=None), bound)
        for step in range(1, max((s.steps for s in settings), default=0) + 1):
            active = [s for s in settings if s.steps >= step]
            w = w.where(F.col(KEY).isin([s.w_id for s in active]))
            rate = _by_setting({s.w_id: float(s.lr) / (float(divisor.get(s.w_id, 1)) or 1.0) for s in active}, "0D")
            limits = {s.w_id: s.limit for s in active if s.limit is not None}
            keep: list = []
            g = step_gradient(xt, yt, w, [nets[s.w_id] for s in active], limits, keep)
            w = store.write(step, update(w, g, rate, bound), bound)
            for df in keep:
                df.unpersist()
        xt.unpersist()
        yt.unpersist()
    return T.to_cells(store.history(), [KEY, "iter", "id"])


def train_tiled(x: DataFrame, y: DataFrame, w0: DataFrame, net: Net, lr: float, steps: int,
                limit: int | None = None, reduction: str = "sum") -> DataFrame:
    """``relational.train_relational`` over tiles: the same arguments and the
    same history ``(iter, id, i, j, v)``."""
    one = Setting(0, net.n_hidden, lr, steps, limit)
    start = w0.select(F.lit(0).cast("long").alias(KEY), "id", "i", "j", "v")
    return train_sweep(x, y, start, [one], net.n_in, net.n_out, net.preset, reduction).drop(KEY)


def score_versions(x: DataFrame, history: DataFrame, nets: Sequence[Net], key: str = "iter") -> DataFrame:
    """Output tiles ``(key, bi, bj, c0 ..)`` of every example under every version
    or model of ``history`` ``(key, id, i, j, v)``; ``nets``: one per key."""
    w = T.to_tiles(history.select(key, "id", "i", "j", "v"), [key, "id"])
    return forward(x, matrix(w, XH), matrix(w, HO), nets, key)[1]
