"""An append-only store of models, read by the ids that a table wants.

An append has a name of its own and a folder under the store's path, partitioned
by model id.  It counts once the writer's marker is there: the same append made
again does nothing, a half-written one is written over, and readers see complete
appends only.  So a job that is started again after a failure adds no model
twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "w_id"
DONE = "_SUCCESS"
PREFIX = "part="


class ModelStore:
    """Weight cells ``(w_id, id, i, j, v)`` by append and model id.

    Model ids should be one append's own; an id of two appends has the cells of
    both, as rows that are inserted twice would."""

    SCHEMA = "id long, i long, j long, v double, part string, w_id long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> str:
        if not name or not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError("the name of an append has letters, digits, - and _ only")
        return f"{self.path}/{PREFIX}{name}"

    def _file_system(self):
        sc = self.spark.sparkContext
        base = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return base, base.getFileSystem(sc._jsc.hadoopConfiguration())

    def complete(self, name: str) -> bool:
        _, fs = self._file_system()
        return fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder(name)}/{DONE}"))

    def appends(self) -> list[str]:
        """Names of the complete appends, sorted; one entry per append."""
        base, fs = self._file_system()
        if not fs.exists(base):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory()]
        return sorted(n for n in (f[len(PREFIX):] for f in found if f.startswith(PREFIX)) if self.complete(n))

    def append(self, models: DataFrame, name: str) -> bool:
        """Adds ``models``; False where this append was complete already."""
        if self.complete(name):
            return False
        cells = models.select(*[F.col(c).cast("long").alias(c) for c in (KEY, "id", "i", "j")],
                              F.col("v").cast("double").alias("v"))
        # A model's cells in one file, whatever the partitions they come from.
        cells.repartition(KEY).write.mode("overwrite").partitionBy(KEY).parquet(self._folder(name))
        return True

    def read(self) -> DataFrame:
        """All models of the complete appends."""
        folders = [self._folder(n) for n in self.appends()]
        if not folders:
            return self.spark.createDataFrame([], "w_id long, id long, i long, j long, v double")
        return (self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*folders)
                .select(KEY, "id", "i", "j", "v"))

    def wanted(self, ids: DataFrame, col: str = KEY) -> DataFrame:
        """The models whose ids ``ids`` holds (repeats and nulls do not matter).

        A semi-join on the partition column: Spark plans dynamic partition
        pruning for a filtered ``ids`` that it broadcasts, so folders of other
        models are not read."""
        want = ids.select(F.col(col).cast("long").alias("_want"))
        return self.read().join(want, F.col(KEY) == F.col("_want"), "left_semi")
