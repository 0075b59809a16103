"""Inference and evaluation on cell tables: scores for one model, for many
models, for every weight version at once; ranking; accuracy; error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrad.operators import strips as S
from cellgrad.operators import tiles as T
from cellgrad.operators.coo import contract_join
from cellgrad.operators.weights import HO, XH
from cellgrad.plans import tiled as TL
from cellgrad.plans.relational import Net, forward, forward_strips
from cellgrad.session import CELL_ROW_BYTES, partitions_for


def _keyed_layer(a: DataFrame, w: DataFrame, key: str, act, bound: int) -> DataFrame:
    """act(A·W) for many weight versions at once: join ``a.j = w.i`` (and the
    version key, when ``a`` already carries one), group by (key, i, j)."""
    right = w.select(key, F.col("i").alias("_k"), F.col("j").alias("_rj"), F.col("v").alias("_bv"))
    own = [key] if key in a.columns else []
    left = a.select(*own, F.col("i").alias("_ri"), F.col("j").alias("_k"), F.col("v").alias("_av"))
    return (contract_join(left, right, [*own, "_k"], bound, "_ri")
            .groupBy(key, F.col("_ri").alias("i"), F.col("_rj").alias("j"))
            .agg(act(F.sum(F.col("_av") * F.col("_bv"))).alias("v")))


def forward_keyed(x: DataFrame, w_xh: DataFrame, w_ho: DataFrame, net: Net, key: str,
                  xh_bound: int, ho_bound: int) -> DataFrame:
    """Output scores ``(key, i, j, v)`` for every model of the stores, which
    hold at most ``xh_bound`` and ``ho_bound`` cells.  Within the broadcast
    cap the example cells stream through without a shuffle."""
    hidden = _keyed_layer(x, w_xh, key, net.hidden_act, xh_bound)
    s = _keyed_layer(hidden, w_ho, key, net.out_act, ho_bound)
    if net.preset == "tanh_softmax":
        w = Window.partitionBy(key, "i")
        e = s.withColumn("_e", F.exp(F.col("v") - F.max("v").over(w)))
        s = e.select(key, "i", "j", (F.col("_e") / F.sum("_e").over(w)).alias("v"))
    return s


def score_strips(x: DataFrame, history: DataFrame, net: Net) -> DataFrame:
    """Scores of every example under every weight version as strips ``(iter, i,
    v1 .., o1 ..)``; ``o``: whether there is such a score, which is NULL for an
    example without any value."""
    rows = S.to_strips(x, net.n_in)
    rows = S.added(rows, ["_known"], [S.any_of(S.names("x", net.n_in))])
    out = forward_strips(rows, S.model(history, net.n_in, net.n_hidden, net.n_out, ["iter"]), net, ["iter", "i", "_known"])
    columns = range(1, net.n_out + 1)
    return out.selectExpr("iter", "i", *[f"CASE WHEN _known THEN a{j} END AS v{j}" for j in columns],
                          *[f"s{j} IS NOT NULL AS o{j}" for j in columns])


def forward_all_steps(x: DataFrame, history: DataFrame, net: Net, n_versions: int, strips: bool = False) -> DataFrame:
    """Scores ``(iter, i, j, v)`` of every example under every weight version,
    multiplied by strips for nets of few inputs and outputs, else by tiles.  What
    tiles do not tell apart from rows that are not there, examples without an id
    or without any value, goes by cells.  ``strips``: such a net gives its
    ``score_strips`` as they are, for ``accuracy_per_step``."""
    if S.fits(net.n_in, net.n_hidden, net.n_out, n_versions, x.sparkSession):
        rows = score_strips(x, history, net)
        return rows if strips else S.to_cells(rows, S.names("v", net.n_out), S.names("o", net.n_out), ["iter"])
    w_xh = history.filter(F.col("id") == XH).select("iter", "i", "j", "v")
    w_ho = history.filter(F.col("id") == HO).select("iter", "i", "j", "v")
    n = partitions_for(n_versions * x.count(), CELL_ROW_BYTES, x.sparkSession)
    xt = T.to_tiles(x, n_partitions=n, fill=None, add=True)
    hidden = T.matmul(xt, T.to_tiles(w_xh, ["iter"]), keys=["iter"], act=TL.hidden_act(net), gaps=True,
                      b_bound=n_versions * T.tiles_in(net.n_in, net.n_hidden))
    out = TL.output_layer(hidden, T.to_tiles(w_ho, ["iter"]), net,
                          n_versions * T.tiles_in(net.n_hidden, net.n_out), "iter", gaps=True)
    scores = T.to_cells(out, ["iter"], cols=net.n_out)
    void = x.where("i IS NOT NULL").groupBy("i").agg(F.count("v").alias("_n")).where("_n = 0")
    rest = x.where("i IS NULL").select("i", "j", "v").unionByName(
        void.select("i", F.lit(1).cast("long").alias("j"), F.lit(None).cast("double").alias("v")))
    return scores.unionByName(
        forward_keyed(rest, w_xh, w_ho, net, "iter", n_versions * net.xh_cells, n_versions * net.ho_cells))


def predict_scores(x: DataFrame, w_xh: DataFrame, w_ho: DataFrame, net: Net) -> DataFrame:
    """Scores ``(i, j, v)`` for one model."""
    return forward(x, w_xh, w_ho, net)[1]


def predict_models(x: DataFrame, w_xh_store: DataFrame, w_ho_store: DataFrame, n_in: int,
                   hidden_sizes, n_out: int, preset: str = "sigmoid") -> DataFrame:
    """Scores ``(w_id, i, j, v)`` for every model in a multi-size store, in
    one query (one pass over the examples instead of one per model)."""
    units = sum(hidden_sizes)
    net = Net(n_in, max(hidden_sizes), n_out, preset)
    return forward_keyed(x, w_xh_store, w_ho_store, net, "w_id", units * n_in, units * n_out)


def rank_scores(scores: DataFrame, by=("i",), value: str = "v") -> DataFrame:
    """``rank()`` of each cell within its row (and version), best first; ties
    share a rank."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc())
    return scores.withColumn("rank", F.rank().over(w).cast("long"))


def accuracy_per_step(scores: DataFrame, y: DataFrame, key: str = "iter") -> DataFrame:
    """Share of examples whose top-ranked class equals the top-ranked label,
    per version.  Ties in rank all count; the denominator is the number of
    distinct examples in ``y``; versions without a hit give no row.  ``scores``
    may be the strips of ``forward_all_steps``, ``y`` is one-hot then."""
    if "j" not in scores.columns:
        return _strip_accuracy(scores, y, key)
    pred = (rank_scores(scores, (key, "i")).filter(F.col("rank") == 1)
            .select(key, "i", F.col("j").alias("_pj")))
    test = (rank_scores(y.select("i", "j", F.col("v").cast("double").alias("v")), ("i",))
            .filter(F.col("rank") == 1).select("i", F.col("j").alias("_tj")))
    n = y.select(F.countDistinct("i").cast("double")).scalar()
    hits = (pred.join(test, "i").filter(F.col("_pj") == F.col("_tj"))
            .groupBy(key).agg(F.count(F.lit(1)).alias("_hits")))
    return hits.select(key, (F.col("_hits").cast("double") / n).alias("precision"))


def _strip_accuracy(scores: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """``accuracy_per_step`` of strips, one joined row for an example and version.
    Every version scores the same examples, so the labelled ones are those of any
    version and those without a score."""
    n = sum(c.startswith("o") for c in scores.columns)
    top = S.greatest(S.names("v", n))
    hits = " + ".join(f"CASE WHEN o{j} AND v{j} <=> {top} THEN m{j} ELSE 0L END" for j in range(1, n + 1))
    counts = (S.best_labels(y, n).join(scores, "i", "left").groupBy(key)
              .agg(F.expr(f"sum({hits}) AS _hits"), F.count(F.lit(1)).alias("_n")))
    over = Window.partitionBy(F.lit(0))
    labelled = (F.coalesce(F.max(F.when(F.col(key).isNotNull(), F.col("_n"))).over(over), F.lit(0))
                + F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))).over(over), F.lit(0)))
    share = counts.withColumn("_all", labelled)
    return share.where(f"{key} IS NOT NULL AND _hits > 0").select(
        key, (F.col("_hits").cast("double") / F.col("_all").cast("double")).alias("precision"))


def best_accuracy(acc: DataFrame) -> DataFrame:
    return acc.agg(F.max("precision").alias("precision"))


def mean_abs_error(scores: DataFrame, y: DataFrame, key: str = "iter") -> DataFrame:
    """Mean of |2(a - y)| over all output cells, per version."""
    lab = y.select("i", "j", F.col("v").cast("double").alias("_y"))
    return (scores.join(lab, ["i", "j"])
            .groupBy(key)
            .agg(F.avg(F.abs(F.lit(2.0) * (F.col("v") - F.col("_y")))).alias("error")))


def ordered(per_step: DataFrame, key: str = "iter") -> DataFrame:
    """A per-version result in version order, with each row's place."""
    return per_step.withColumn("place", F.row_number().over(Window.orderBy(key)).cast("long")).orderBy(key)


def best_share(counts: DataFrame, key: str = "id") -> DataFrame:
    """max over versions of (correct count / all counted), as a window total
    per version instead of a correlated subquery."""
    total = F.sum("count").over(Window.partitionBy(key))
    share = counts.withColumn("_total", total).filter(F.col("correct"))
    return share.agg(F.max(F.col("count").cast("double") / F.col("_total")).alias("precision"))
