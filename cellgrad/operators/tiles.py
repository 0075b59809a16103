"""Matrix algebra over tiles ``(bi, bj, c0 .. c15)``.

A tile is a dense block of ``SIZE`` x ``SIZE`` neighbouring cells in one row, its
cells as columns, row by row.  Block (bi, bj) holds the cells i in
bi * SIZE + 1 .. and j in bj * SIZE + 1 ..; a table has SIZE^2 times fewer rows
than its cells.  Cells that a matrix lacks (beyond its edge, or not stored) are
zeros where a tile is a factor; ``to_tiles(fill=None)`` keeps them NULL, which
weights and targets use: what is NULL there stays without a value.

A product joins two tile tables on the contracted block index and sums the block
products: every output cell of a block is one generated expression of SIZE
multiplications over plain columns, so a joined row does SIZE^3 of them in
compiled code, and joined rows fall by as much against the cell product.

Leading key columns (a model, a version) may be carried by either side.

Partitioning follows the cell encoding: example tiles are hash partitioned by
``bi``; products with broadcast weights, groups on (.., bi, bj) and tile-wise
joins then need no exchange, only contractions over examples end in one, over
partial sums of the model's size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrad.operators.coo import contract_join
from cellgrad.session import CELL_ROW_BYTES

# SIZE^2 sums of SIZE products each: small enough to be planned and compiled as
# one step.
SIZE = 4
PLACES = range(SIZE * SIZE)
CELLS = [f"c{p}" for p in PLACES]
TILE_BYTES = 16 + 8 * SIZE * SIZE + CELL_ROW_BYTES


def block(index: str) -> Column:
    """The block of a 1-based cell index."""
    return F.expr(f"({index} - 1) div {SIZE}")


def row_of(place: int) -> str:
    """The 1-based row of a place, from the block row ``bi``."""
    return f"(bi * {SIZE} + {place // SIZE + 1})"


def to_tiles(cells: DataFrame, keys: Sequence[str] = (), n_partitions: int | None = None,
             fill: float | None = 0.0, add: bool = False, counts: bool = False) -> DataFrame:
    """Cells ``(*keys, i, j, v)`` -> tiles, one shuffle; missing cells of a tile
    become ``fill``.  With ``n_partitions`` the tiles are hash partitioned by
    ``bi`` into as many partitions and sorted inside them.  ``add``: a cell that
    is stored several times counts with its sum.  ``counts`` adds n0 .. n15, the
    values stored per cell."""
    place = F.expr(f"pmod(i - 1, {SIZE}) * {SIZE} + pmod(j - 1, {SIZE})")
    placed = cells.select(*keys, block("i").alias("bi"), block("j").alias("bj"), place.alias("_p"),
                          F.col("v").cast("double").alias("v"))
    if n_partitions:
        placed = placed.repartition(n_partitions, "bi")
    one = lambda p: f"{'sum' if add else 'max'}(CASE WHEN _p = {p} THEN v END)"
    stored = [F.expr(f"count(CASE WHEN _p = {p} THEN v END)").alias(f"n{p}") for p in PLACES] if counts else []
    tiles = placed.groupBy(*keys, "bi", "bj").agg(*[
        F.expr(one(p) if fill is None else f"coalesce({one(p)}, {float(fill)}D)").alias(CELLS[p]) for p in PLACES],
        *stored)
    return tiles.sortWithinPartitions("bi", "bj") if n_partitions else tiles


def to_cells(tiles: DataFrame, keys: Sequence[str] = (), rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Tiles -> cells ``(*keys, i, j, v)`` without NULLs, and without what lies
    beyond ``rows`` and ``cols`` where these are given."""
    at = tiles.select(*keys, "bi", "bj", F.posexplode(F.array(*CELLS)).alias("_p", "v"))
    cells = at.where("v IS NOT NULL").select(
        *keys, F.expr(f"CAST(bi * {SIZE} + _p div {SIZE} + 1 AS BIGINT)").alias("i"),
        F.expr(f"CAST(bj * {SIZE} + _p % {SIZE} + 1 AS BIGINT)").alias("j"), "v")
    for name, end in (("i", rows), ("j", cols)):
        cells = cells if end is None else cells.where(F.col(name) <= end)
    return cells


def filled(tiles: DataFrame) -> DataFrame:
    """NULL cells as zeros, for use as a factor."""
    rest = [c for c in tiles.columns if c not in CELLS]
    return tiles.selectExpr(*rest, *[f"coalesce({c}, 0D) AS {c}" for c in CELLS])


def renamed(prefix: str) -> list[str]:
    """The cells as ``prefix0 ..``, as SQL text: a plan step with many columns is
    built in one call that way."""
    return [f"{c} AS {prefix}{p}" for p, c in enumerate(CELLS)]


def contract(a: DataFrame, b: DataFrame, a_sum: str, b_sum: str, *, keys: Sequence[str] = (),
             b_bound: int | None = None, act: Callable[[str], str] | None = None,
             only: str | None = None, gaps: bool = False) -> DataFrame:
    """General product of two tile tables; ``a_sum`` / ``b_sum`` name the index
    ("i" or "j") of each side that is summed over.  ``keys`` are key columns of
    ``b``; those that ``a`` has too are joined on.  ``b_bound``: the proven bound
    of b's tiles (see ``coo.contract_join``).  ``act`` is applied to the sums
    (SQL text to SQL text); ``only`` filters joined rows by the keys and ``bi``,
    the kept block of a.  ``gaps``: see ``sum_products``."""
    own = [k for k in keys if k in a.columns]
    a_keep, b_keep = ("bj" if a_sum == "i" else "bi"), ("bj" if b_sum == "i" else "bi")
    left = a.selectExpr(*own, f"{a_keep} AS bi", f"b{a_sum} AS _k", *renamed("a"))
    right = b.selectExpr(*keys, f"b{b_sum} AS _k", f"{b_keep} AS bj", *renamed("b"))
    if b_bound is not None:
        joined = contract_join(left, right, [*own, "_k"], b_bound, "bi", TILE_BYTES)
    else:
        joined = left.join(right, [*own, "_k"])
    if only is not None:
        joined = joined.where(only)
    return sum_products(joined, keys, a_sum == "i", b_sum == "j", act, gaps)


def sum_products(joined: DataFrame, keys: Sequence[str], a_turned: bool, b_turned: bool,
                 act: Callable[[str], str] | None = None, gaps: bool = False) -> DataFrame:
    """The block products of ``a0 ..`` and ``b0 ..`` (each turned or not) summed
    by (*keys, bi, bj).  ``gaps``: cells of a may be NULL; they add nothing, and a
    row of a without any value has NULL for its products, as with cells."""
    at = lambda side, row, col, turned: f"{side}{col * SIZE + row if turned else row * SIZE + col}"

    def cell(p: int) -> Column:
        row, col = divmod(p, SIZE)
        left = [at("a", row, k, a_turned) for k in range(SIZE)]
        terms = " + ".join(f"{f'coalesce({a}, 0D)' if gaps else a} * {at('b', k, col, b_turned)}"
                           for k, a in enumerate(left))
        total = f"sum(CASE WHEN coalesce({', '.join(left)}) IS NOT NULL THEN {terms} END)" if gaps else f"sum({terms})"
        return F.expr(f"{act(total) if act else total} AS {CELLS[p]}")

    return joined.groupBy(*keys, "bi", "bj").agg(*map(cell, PLACES))


def matmul(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    """A·B over tiles."""
    return contract(a, b, "j", "i", **kw)


def matmul_bt(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    """A·Bᵀ over tiles."""
    return contract(a, b, "j", "j", **kw)


def matmul_at(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    """Aᵀ·B over tiles; contracts the examples."""
    return contract(a, b, "i", "i", **kw)


def hadamard(a: DataFrame, b: DataFrame, fn: Callable[[str, str], str] | None = None,
             keys: Sequence[str] = ()) -> DataFrame:
    """Tile-wise ``fn(a, b)`` (SQL text, default the product) over the tiles
    both have; ``keys`` are key columns of ``a``, those that ``b`` has are joined
    on."""
    fn = fn or (lambda x, y: f"{x} * {y}")
    own = [k for k in keys if k in b.columns]
    both = a.selectExpr(*keys, "bi", "bj", *renamed("a")).join(
        b.selectExpr(*own, "bi", "bj", *renamed("b")), [*own, "bi", "bj"])
    return both.selectExpr(*keys, "bi", "bj", *[f"{fn(f'a{p}', f'b{p}')} AS {CELLS[p]}" for p in PLACES])


def softmax_rows(a: DataFrame, cols: int, keys: Sequence[str] = ()) -> DataFrame:
    """Softmax over each matrix row of ``cols`` cells, over all its blocks;
    what lies beyond is zero; a row without any value stays without."""
    w = Window.partitionBy(*keys, "bi")
    here = lambda c, expr: f"CASE WHEN bj * {SIZE} + {c} < {cols} THEN {expr} END"
    row = lambda r: [(CELLS[r * SIZE + c], c) for c in range(SIZE)]
    tops = {f"_m{r}": F.max(F.expr("greatest(" + ", ".join(here(c, x) for x, c in row(r)) + ")")).over(w)
            for r in range(SIZE)}
    rest = [*keys, "bi", "bj"]
    raised = a.withColumns(tops).selectExpr(*rest, *[
        f"coalesce({here(p % SIZE, f'exp({CELLS[p]} - _m{p // SIZE})')}, 0D) AS {CELLS[p]}" for p in PLACES])
    sums = {f"_s{r}": F.sum(F.expr(" + ".join(x for x, _ in row(r)))).over(w) for r in range(SIZE)}
    return raised.withColumns(sums).selectExpr(*rest, *[f"{CELLS[p]} / nullif(_s{p // SIZE}, 0D) AS {CELLS[p]}" for p in PLACES])


def tiles_in(rows: int, cols: int) -> int:
    """Number of tiles of a rows x cols matrix."""
    return -(-rows // SIZE) * -(-cols // SIZE)
