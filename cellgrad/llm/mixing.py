"""Mixing sources to target weights by Pfair scheduling.

Each source is cut, in document order, into blocks of ``block_rows`` rows.
With integer target weights w_s and W = sum of w_s, the k-th block of a source
(k from 1) may not run before slot floor((k-1) * W / w_s) and has to have run
by slot ceil(k * W / w_s).  Serving the released block with the earliest
deadline in each slot keeps every source less than one block from its target
share after any number of slots.  The windows repeat every W slots, so the
schedule of one period, computed from the weights alone, gives every slot in
closed form: block k runs at ((k-1) div w_s) * W + offset_s[(k-1) mod w_s].

Sources differ in size.  When one has run its last block, the others go on
with the weights that are left: a new phase with a schedule of its own, with
at most as many phases as sources.  No row is dropped or repeated.

Only DataFrame functions touch rows.  The driver sees one count per source
(the sources and their weights are parameters of the job) and the schedule of
a period; the row order within a source comes from a range-partitioned sort
and per-partition counts, so a source that holds a third of all rows is spread
over many tasks.

Defined cases: rows with a null source are a source of their own (key null);
a source without a target weight, or with weight 0, is served after all
others; ties in the document id are broken by a hash of the whole row, equal
rows are interchangeable; an empty table gives an empty result; input columns
named like a result column give way to it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrad.llm import text as X
from cellgrad.session import bounded_broadcast, materialize

BLOCK_ROWS = 16
PERIOD = 1000


def period_schedule(weights: Mapping[str | None, int], blocks: Mapping[str | None, int] | None = None) -> dict:
    """Slots 0..W-1 of one period: source -> list of its slots, ascending.
    Ties in the deadline go to the source named first in ``weights``.  With
    ``blocks``, the schedule ends after the slot in which a source has run all
    of its blocks, if that is within the period."""
    total = sum(weights.values())
    names = list(weights)
    waiting = [(0, -(-total // weights[s]), i, 1) for i, s in enumerate(names)]  # release, deadline, source, k
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: dict = {s: [] for s in names}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, due, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, k))
        _, i, k = heapq.heappop(ready)
        s, w = names[i], weights[names[i]]
        slots[s].append(t)
        if blocks is not None and k == blocks[s]:
            break
        if k < w:
            heapq.heappush(waiting, (k * total // w, -(-(k + 1) * total // w), i, k + 1))
    return slots


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, int]) -> list[dict]:
    """Phases in order, each {start, total, weights, runs: {source: (first block,
    number of blocks, slots)}}.  A phase ends with the slot in which one of its
    sources runs out; it holds the slots of one period, or fewer where it is
    shorter than a period, and only sources that get a block in it."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        w = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        shared = math.gcd(*w.values())
        w = {s: n // shared for s, n in w.items()}
        total, slots = sum(w.values()), period_schedule(w, left)
        end = min((left[s] - 1) // w[s] * total + slots[s][(left[s] - 1) % w[s]]
                  for s in w if len(slots[s]) == min(w[s], left[s])) + 1
        runs = {}
        for s in w:
            n = end // total * w[s] + sum(x < end % total for x in slots[s])
            if n:
                runs[s] = (done[s], n, slots[s][:n])
            done[s] += n
            left[s] -= n
        out.append({"start": start, "total": total, "weights": w, "runs": runs})
        start += end
        left = {s: n for s, n in left.items() if n > 0}
    return out


def ranked_in_source(df: DataFrame, source: str, order: list[str]) -> tuple[DataFrame, dict]:
    """``df`` with ``_row``, the row's place within its source from 0, and the
    number of rows per source.

    The rows are range-partitioned and sorted by source and ``order`` and
    written out once, so counts and places come from the same partitions.  A
    partition holds a contiguous range, so there are fewer (partition, source)
    pairs than partitions plus sources: that bounds the broadcast of starts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(parts, source, *order).sortWithinPartitions(source, *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(source, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy(source).orderBy("_part")
                              .rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(counts.withColumn("_before", F.coalesce(before, F.lit(0))), "source-starts")
    sizes = {r[0]: r[1] for r in sorted(
        starts.groupBy(source).agg(F.sum("_n")).collect(), key=lambda r: (r[0] is None, r[0] or ""))}
    pairs = bounded_broadcast(starts.drop("_n"), starts.count(), 64)
    rows = (ranged.alias("r").join(pairs.alias("c"), (F.col("r._part") == F.col("c._part"))
                                   & F.col(f"r.{source}").eqNullSafe(F.col(f"c.{source}")))
            .select("r.*", (F.col("_at") - F.col("_from") + F.col("_before")).alias("_row")).drop("_at", "_part"))
    return rows, sizes


def natural_weights(counts: Mapping[str | None, int], temperature: float = 0.7,
                    period: int = PERIOD) -> dict:
    """Target weights in 1/period: counts to the power ``temperature``, at
    least 1 each."""
    total = sum(n ** temperature for n in counts.values()) or 1.0
    return {s: max(1, round(period * n ** temperature / total)) for s, n in counts.items()}


def schedule(df: DataFrame, source: str, order: list[str],
             weights: Mapping[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with _block, _phase, _slot and _position along the mixture."""
    spark = df.sparkSession
    rows, counts = ranked_in_source(df, source, order)
    if weights is None:
        weights = natural_weights(counts)
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, weights)
    runs, offsets = [], []
    for p, ph in enumerate(plan):
        for s, (first, n, slots) in ph["runs"].items():
            runs.append((s, p, first, first + n, ph["start"], ph["total"], ph["weights"][s]))
            offsets += [(s, p, j, t) for j, t in enumerate(slots)]
    runs_df = spark.createDataFrame(runs, "_s string, _phase long, _first long, _end long, _start long, "
                                          "_total long, _w long")
    offsets_df = spark.createDataFrame(offsets, "_s string, _phase long, _j long, _t long")
    # At most a period per source, and no more than there are blocks; past the cap the joins shuffle.
    runs_df = bounded_broadcast(runs_df, len(runs), 96)
    offsets_df = bounded_broadcast(offsets_df, len(offsets), 64)
    rows = rows.withColumn("_block", F.floor(F.col("_row") / block_rows).cast("long"))
    at = (rows.alias("r").join(runs_df.alias("p"), F.col(f"r.{source}").eqNullSafe(F.col("p._s"))
                               & (F.col("r._block") >= F.col("_first")) & (F.col("r._block") < F.col("_end")))
          .select("r.*", "_phase", "_start", "_total", "_w", (F.col("_block") - F.col("_first")).alias("_k")))
    at = (at.alias("a").join(offsets_df.alias("o"), F.col(f"a.{source}").eqNullSafe(F.col("o._s"))
                             & (F.col("a._phase") == F.col("o._phase")) & (F.col("_k") % F.col("_w") == F.col("_j")))
          .select("a.*", "_t"))
    slot = F.col("_start") + F.floor(F.col("_k") / F.col("_w")).cast("long") * F.col("_total") + F.col("_t")
    return (at.withColumn("_slot", slot)
            .withColumn("_position", F.col("_slot") * block_rows + F.col("_row") % block_rows)
            .drop("_start", "_total", "_w", "_k", "_t", "_row"))


def _held_rows(docs: DataFrame, source_col: str, id_col: str, keep: bool) -> tuple[X.Held, DataFrame]:
    """The rows to schedule with _source, _id and a hash of the whole row."""
    held = X.Held(docs)
    row = [F.to_json(F.struct(c)) if "map" in t or t == "variant" else F.col(c) for c, t in held.df.dtypes]
    own = [held(source_col).cast("string").alias("_source"), held(id_col).alias("_id"),
           F.xxhash64(*row).alias("_tie")]
    return held, held.df.select(*([F.col(c) for c in held.df.columns] if keep else []), *own)


def mix(docs: DataFrame, weights: Mapping[str | None, int] | None = None, source_col: str = "source",
        id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, block, phase, slot, position), a row for each of
    ``docs``; position ascends along the mixture, ``weights`` None takes
    ``natural_weights``."""
    _, rows = _held_rows(docs, source_col, id_col, keep=False)
    return schedule(rows, "_source", ["_id", "_tie"], weights, block_rows).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_block").alias("block"),
        F.col("_phase").alias("phase"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


def mixed_documents(docs: DataFrame, weights: Mapping[str | None, int] | None = None,
                    source_col: str = "source", id_col: str = "doc_id",
                    block_rows: int = BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """``docs`` in mixture order: range-partitioned (to ``parts``) and sorted by
    position, so files written from it hold the mixture one after the other.  A
    scan of these files takes them by size; applied to the reread rows, this
    gives the same order again, as it depends on the rows alone."""
    held, rows = _held_rows(docs, source_col, id_col, keep=True)
    rows = schedule(rows, "_source", ["_id", "_tie"], weights, block_rows)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionByRange(parts, "_position").sortWithinPartitions("_position")
            .select(*held.back()))
