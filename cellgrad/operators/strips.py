"""Matrix algebra over strips ``(i, x1 .. xn)``: a whole matrix row in one table
row, its cells as columns, for nets of few inputs and outputs.

A model is a table of blocks (``model``): a row for ``BLOCK`` hidden units with
all weights into and out of them.  A layer joins the strips with the blocks, which
are broadcast, and sums over the blocks of an example; the gradient joins them
once more and sums over the examples of a block.  The hidden values live within a
joined row only: they are neither stored nor sorted, as those of tiles are, and a
row of at most ``COLUMNS`` weights is small enough for compiled code.

Strips hold what the cells say: a cell that is stored several times counts with
its sum, a strip without any value has no activations, and cells beyond the net's
columns do not count.

Partitioning: strips are grouped by ``i``.  Cells that are hash partitioned by
id, before or after they were unfolded from rows, need no exchange for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrad.operators.weights import HO, XH
from cellgrad.session import broadcast_cap

BLOCK = 4
# Weights of a block.  Past about 8000 bytes of code the JVM does not compile the
# loop over the joined rows any more.
COLUMNS = 48


def blocks_in(n_hidden: int) -> int:
    return -(-n_hidden // BLOCK)


def fits(n_in: int, n_hidden: int, n_out: int, models: int, spark: SparkSession) -> bool:
    """Whether ``models`` models of this shape are multiplied by strips."""
    columns = (n_in + n_out) * BLOCK
    return 0 < columns <= COLUMNS and models * blocks_in(n_hidden) * (8 * columns + 64) <= broadcast_cap(spark)


def names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(1, n + 1)]


def into(n_in: int) -> list[list[str]]:
    """The weights of a block from each input to each unit."""
    return [[f"u{i}_{k}" for k in range(1, BLOCK + 1)] for i in range(1, n_in + 1)]


def out_of(n_out: int) -> list[list[str]]:
    """The weights of a block from each unit to each output."""
    return [[f"w{k}_{j}" for j in range(1, n_out + 1)] for k in range(1, BLOCK + 1)]


def filled(columns: Sequence[str]) -> list[str]:
    return [f"coalesce({c}, 0D)" for c in columns]


def any_of(columns: Sequence[str]) -> str:
    return f"({' OR '.join(f'{c} IS NOT NULL' for c in columns)})"


def greatest(columns: Sequence[str]) -> str:
    """The largest value, NULL only without any."""
    return f"greatest({', '.join(columns)})" if len(columns) > 1 else columns[0]


def to_strips(cells: DataFrame, cols: int, targets: DataFrame | None = None, target_cols: int = 0) -> DataFrame:
    """Cells ``(i, j, v)`` -> ``(i, x1 ..)``, NULL where nothing is stored.
    ``targets``: cells of the same examples, which become ``t1 ..`` and ``n1 ..``,
    the values stored per cell; an example in either has a strip."""
    def placed(df: DataFrame, n: int, before: int) -> DataFrame:
        return df.where(F.col("j").between(1, n)).select(
            "i", (F.col("j") + before).cast("int").alias("_p"), F.col("v").cast("double").alias("v"))

    def each(how: str, prefix: str, n: int, before: int) -> list:
        return [F.expr(f"{how}(CASE WHEN _p = {before + j} THEN v END) AS {c}") for j, c in enumerate(names(prefix, n), 1)]

    both, values = placed(cells, cols, 0), each("sum", "x", cols, 0)
    if targets is not None:
        both = both.unionByName(placed(targets, target_cols, cols))
        values += each("sum", "t", target_cols, cols) + each("count", "n", target_cols, cols)
    return both.groupBy("i").agg(*values)


def model(w: DataFrame, n_in: int, n_hidden: int, n_out: int, keys: Sequence[str] = ()) -> DataFrame:
    """Stacked weights ``(*keys, id, i, j, v)`` -> blocks ``(*keys, b, u.., w..,
    p1 ..)``: weights into and out of the units, zero where none is stored, and
    whether an output has weights here.  A model that lacks a matrix has no
    blocks."""
    unit = f"CASE WHEN id = {XH} THEN j ELSE i END - 1"
    placed = w.where(f"id IN ({XH}, {HO}) AND {unit} BETWEEN 0 AND {n_hidden - 1}").selectExpr(
        *keys, "id", f"({unit}) div {BLOCK} AS b", f"CAST(pmod({unit}, {BLOCK}) + 1 AS INT) AS k",
        f"CASE WHEN id = {XH} THEN i ELSE j END AS o", "v")
    weight = lambda which, o, k, c: F.expr(
        f"coalesce(max(CASE WHEN id = {which} AND o = {o} AND k = {k} THEN v END), 0D) AS {c}")
    cells = [weight(XH, i, k, c) for i, row in enumerate(into(n_in), 1) for k, c in enumerate(row, 1)] + \
        [weight(HO, j, k, c) for k, row in enumerate(out_of(n_out), 1) for j, c in enumerate(row, 1)]
    there = [F.expr(f"coalesce(bool_or(id = {HO} AND o = {j}), false) AS {c}") for j, c in enumerate(names("p", n_out), 1)]
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    blocks = placed.groupBy(*keys, "b").agg(*cells, *there, *[F.expr(f"count_if(id = {m}) AS _n{m}") for m in (XH, HO)])
    return blocks.withColumns({f"_n{m}": F.sum(f"_n{m}").over(whole) for m in (XH, HO)}).where(
        f"_n{XH} > 0 AND _n{HO} > 0").drop(f"_n{XH}", f"_n{HO}")


def joined(strips: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every strip beside every block."""
    return strips.crossJoin(F.broadcast(blocks))


def added(rows: DataFrame, columns: Sequence[str], exprs: Sequence[str]) -> DataFrame:
    return rows.selectExpr("*", *[f"{e} AS {c}" for c, e in zip(columns, exprs, strict=True)])


def product(a: Sequence[str], b: Sequence[Sequence[str]]) -> list[str]:
    """a·B; ``a`` has an expression for each row of the columns ``b``."""
    return [" + ".join(f"{x} * {y}" for x, y in zip(a, col, strict=True)) for col in zip(*b)]


def product_bt(a: Sequence[str], b: Sequence[Sequence[str]]) -> list[str]:
    """a·Bᵀ."""
    return product(a, [*zip(*b)])


def layer(rows: DataFrame, a: Sequence[str], b: Sequence[Sequence[str]], out: Sequence[str],
          act: Callable[[str], str]) -> DataFrame:
    """Adds ``act(a·B)`` as the columns ``out``."""
    return added(rows, out, [act(s) for s in product(a, b)])


def sum_blocks(rows: DataFrame, by: Sequence[str], a: Sequence[str], b: Sequence[Sequence[str]],
               there: Sequence[str], out: Sequence[str]) -> DataFrame:
    """a·B summed over the blocks of ``by``; NULL where no block has weights."""
    return rows.groupBy(*by).agg(*[F.expr(f"sum(CASE WHEN {p} THEN {s} END) AS {c}")
                                   for p, s, c in zip(there, product(a, b), out, strict=True)])


def softmax(rows: DataFrame, a: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Adds the softmax over the columns ``a``; a NULL has no share in it."""
    raised = added(rows, [f"_e{k}" for k in range(len(a))], [f"exp({x} - {greatest(a)})" for x in a])
    total = " + ".join(f"coalesce(_e{k}, 0D)" for k in range(len(a)))
    return added(raised, out, [f"_e{k} / nullif({total}, 0D)" for k in range(len(a))])


def sum_strips(rows: DataFrame, n_hidden: int, x: Sequence[str], err: Sequence[str]) -> DataFrame:
    """Gradient cells ``(id, i, j, v)`` of joined rows with hidden values ``h1 ..``
    and their errors ``d1 ..``: the sums over all examples of ``x_i * d_k`` and of
    ``h_k * err_j``."""
    h, d = names("h", BLOCK), names("d", BLOCK)
    sums = [(XH, f"{i}L", f"b * {BLOCK} + {k}", f"{p} * {q}") for i, p in enumerate(x, 1) for k, q in enumerate(d, 1)] + \
        [(HO, f"b * {BLOCK} + {k}", f"{j}L", f"{p} * {q}") for k, p in enumerate(h, 1) for j, q in enumerate(err, 1)]
    blocks = rows.groupBy("b").agg(*[F.expr(f"sum({s}) AS g{n}") for n, (*_, s) in enumerate(sums)])
    cells = ", ".join(f"named_struct('id', {m}L, 'i', {i}, 'j', {j}, 'v', g{n})" for n, (m, i, j, _) in enumerate(sums))
    unit = f"CASE WHEN id = {XH} THEN j ELSE i END"
    return blocks.selectExpr(f"inline(array({cells}))").where(f"v IS NOT NULL AND {unit} <= {n_hidden}")


def to_cells(strips: DataFrame, values: Sequence[str], there: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Strips -> cells ``(*keys, i, j, v)`` where the flags ``there`` say so."""
    cells = ", ".join(f"named_struct('j', {j}L, 'v', {v}, 'o', {o})" for j, (v, o) in enumerate(zip(values, there, strict=True), 1))
    return strips.selectExpr(*keys, "i", f"inline(array({cells}))").where("o").select(*keys, "i", "j", "v")


def best_labels(y: DataFrame, cols: int) -> DataFrame:
    """One-hot cells ``(i, j, v)`` -> ``(i, m1 ..)``: how often a class is among
    the best ranked of its example, which are the ones, or all classes of an
    example with zeros only.  A class beyond ``cols`` can be the best but has no
    column.  Other values than 0 and 1 are refused."""
    cells = y.where("i IS NOT NULL").select("i", F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    rows = cells.groupBy("i").agg(
        F.expr("count_if(v = 1D) AS _ones"), F.expr("count_if(coalesce(v NOT IN (0D, 1D), true)) AS _other"),
        *[F.expr(f"count_if(v = {v}D AND j = {j}) AS _{c}{j}") for v, c in ((1, "a"), (0, "b")) for j in range(1, cols + 1)])
    refused = "CASE WHEN _other > 0 THEN CAST(raise_error('labels are not one-hot') AS BIGINT)"
    return rows.selectExpr("i", *[f"{refused} WHEN _ones > 0 THEN _a{j} ELSE _b{j} END AS m{j}" for j in range(1, cols + 1)])
