"""Line dedup over levelled, sorted runs of line hashes.

``LineRuns`` keeps every line key seen so far as immutable sorted runs of
``(h1, h2, first_doc)``, written to the shared checkpoint folder.  A new batch
is merge-anti-joined with the runs and its unseen keys become a run of level
0; when a level holds ``fanout`` runs they are merged into one run of the next
level.  Keys are disjoint between runs, so a merge never has to reconcile.

A run is bucketed by its key, with a sorted file per bucket and one number of
buckets for all runs.  The anti-join shuffles and sorts the keys of the new
batch alone and streams the runs' files past them, and a merge streams two runs
past each other, whatever their size.

A line is dropped when its key (stripped, A-Z lower-cased, at least
``min_chars`` code points) belongs to a smaller document.  Batches have to
arrive in ascending document order for "smaller" to hold across batches;
``dedup_lines`` cuts a table that way.

Defined cases: a null or empty text is one empty line and stays; repeats of a
line inside its first document all stay; rows without a doc_id come after all
others and count as one document, as do rows that share a doc_id; an empty
table gives an empty result; columns of the input other than the id and the
text are returned untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrad.llm import text as X
from cellgrad.session import ensure_checkpoint_dir, materialize, partitions_for, settings

MIN_CHARS = 10
KEY = ["_h1", "_h2"]
DOC = ["_doc", "_th"]
RUN = "_h1 long, _h2 long, _first long"
RUN_ROW_BYTES = 48
# A bucket is one sorted file, so a scan by bucket is in key order.
IN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def _identified(held: X.Held, id_col: str, text_col: str) -> DataFrame:
    """Adds the document's rank and a hash of its text: together they name a
    row (or rows that are equal in all that matters here)."""
    return held.df.withColumns({
        "_doc": F.coalesce(held(id_col).cast("long"), F.lit(X.MAX_LONG)),
        "_th": F.xxhash64(held(text_col))})


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS) -> DataFrame:
    """One slim row per line that can be a duplicate: (_doc, _th, _pos, _h1, _h2)."""
    held = X.Held(docs)
    lines = (_identified(held, id_col, text_col)
             .select(*DOC, F.posexplode(X.lines_of(held(text_col))).alias("_pos", "_line"))
             .select(*DOC, "_pos", X.line_key(F.col("_line")).alias("_key"))
             .where(F.length("_key") >= min_chars))
    h1, h2 = X.hash128(F.col("_key"))
    return lines.select(*DOC, "_pos", h1.alias("_h1"), h2.alias("_h2"))


class Run:
    """One run: ``sorted`` is read by bucket and in order, ``rows`` as plain
    files, for joins that have to split hot keys."""

    def __init__(self, keys: DataFrame, buckets: int, level: int):
        spark = keys.sparkSession
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cellgrad/{name}"
        (keys.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
         .option("path", path).saveAsTable(name))
        self.sorted = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name only: the folder is the run's own
        self.rows = spark.read.schema(RUN).parquet(path)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one: no key is in both, so the full join lists them in turn,
    each bucket in the task that reads it."""
    both = a.alias("a").join(b.alias("b").hint("merge"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY], "full")
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*KEY, "_first"]])


class LineRuns:
    """The levelled runs.  ``levels[k]`` lists the runs of level k, over files
    that are never rewritten, so frames handed out stay valid.  ``buckets``:
    the files of a run, a sorted stretch of keys each."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark = spark
        self.fanout = fanout
        self.buckets = buckets or partitions_for(0, RUN_ROW_BYTES, spark)
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def frame(self) -> DataFrame:
        """Every key so far with its first document (after the first add)."""
        first, *more = self.runs()
        out = first.rows
        for run in more:
            out = out.unionByName(run.rows)
        return out

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The keys of a batch that no run has yet, with their first document."""
        keys = lines.groupBy(*KEY).agg(F.min("_doc").alias("_first"))
        for run in self.runs():
            keys = keys.join(run.sorted.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys.repartition(self.buckets, *KEY)

    def add(self, lines: DataFrame) -> None:
        """Add the unseen keys of a batch as a run, then compact."""
        with settings(self.spark, IN_ORDER):
            run = Run(self.unseen(lines), self.buckets, 0)
            level = 0
            while True:
                while len(self.levels) <= level:
                    self.levels.append([])
                self.levels[level].append(run)
                if len(self.levels[level]) < self.fanout:
                    return
                run, *more = self.levels[level]
                for other in more:
                    run = Run(merged(run.sorted, other.sorted), self.buckets, level + 1)
                self.levels[level] = []
                level += 1

    def dropped(self, lines: DataFrame) -> DataFrame:
        """Lines of an added batch whose key belongs to a smaller document."""
        first = self.frame()
        return (lines.join(first, KEY).where(F.col("_first") < F.col("_doc"))
                .select(*DOC, "_pos"))


def id_batches(docs: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """The table cut at ``n`` quantiles of the id, ascending; rows without an
    id go with the last batch."""
    cuts = sorted(set(docs.approxQuantile(id_col, [k / n for k in range(1, n)], 0.01))) if n > 1 else []
    c = F.col(id_col)
    edges = [None, *[int(x) for x in cuts], None]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = c > lo
        if hi is not None:
            cond = cond & (c <= hi)
        else:
            cond = cond | c.isNull()
        out.append(docs.where(cond))
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the text replaced by the kept lines, plus ``n_lines`` and
    ``n_dropped`` (long)."""
    spark = docs.sparkSession
    store = drops = None
    for batch in id_batches(docs, id_col, batches):
        lines = materialize(line_table(batch, id_col, text_col, min_chars), "lines")
        if store is None:
            # By all lines to come: the batches are about equal.
            store = LineRuns(spark, fanout, partitions_for(batches * lines.count(), RUN_ROW_BYTES, spark))
        store.add(lines)
        d = store.dropped(lines)
        drops = d if drops is None else drops.unionByName(d)
    # Rows equal in id and text list a position once each.
    per_doc = drops.groupBy(*DOC).agg(F.collect_set("_pos").alias("_drops"))
    held = X.Held(docs)
    text = held(text_col)
    joined = (_identified(held, id_col, text_col).join(per_doc, DOC, "left")
              .withColumn("_lines", X.lines_of(text))
              .withColumn("_n", F.size("_lines")))
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_drops"))
    # `_lines` is named twice, so the optimizer keeps it as one computed column.
    kept = (F.when(F.col("_drops").isNull(), F.coalesce(text, F.lit("")))
            .otherwise(F.array_join(F.transform(
                stay, lambda k: F.get(F.col("_lines"), k)), "\n")))
    return joined.select(*held.back(
        {text_col: kept},
        {"n_lines": F.col("_n").cast("long"),
         "n_dropped": F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long")}))
