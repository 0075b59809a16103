"""Session construction and the few runtime settings the plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a training loop's own plans are built under (see ``loop_settings``).
LOOP_CONF = {
    # Joins on (i, j) of two sides hash partitioned by i need no exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A step's shapes are known beforehand; without re-planning, cached cells
    # report their partitioning and order before they are filled.
    "spark.sql.adaptive.enabled": "false",
}

# Upper bound, in bytes, for a side we broadcast on the strength of its shape.
BROADCAST_CAP_CONF = "cellgrad.broadcast.maxBytes"
DEFAULT_BROADCAST_CAP = 256 * 1024 * 1024
# Bytes we budget per broadcast cell row (two longs, one double, row overhead).
CELL_ROW_BYTES = 48
# What a task of a training loop holds of the examples.
PARTITION_BYTES = 128 * 1024 * 1024


def build_session(master: str | None = None, app: str = "cellgrad",
                  shuffle_partitions: int = 8, driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.default.parallelism": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": driver_memory,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """``conf`` while a block builds and runs its plans; the caller's settings
    are back afterwards, so no later plan depends on it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def loop_settings(spark: SparkSession):
    """``LOOP_CONF`` while a training loop builds and runs its steps."""
    return settings(spark, LOOP_CONF)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cellgrad`` importable in executor Python workers (the Arrow
    batch functions live in it): zip the package once per SparkContext and
    add it with ``addPyFile``, which distributes it to every executor."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="cellgrad-pkg-")
    path = os.path.join(out_dir, "cellgrad.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where unset.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; a machine-local folder is accepted only for a
    local master (tests, the bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir() or named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for it")
    base = os.environ.get("TMPDIR", "/tmp")
    path = tempfile.mkdtemp(prefix="cellgrad-ckpt-", dir=base)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` as parquet under the shared checkpoint folder
    and read it back.  One job computes and writes (``Dataset.checkpoint``
    computes its input twice unless it is cached), and the files survive the
    loss of any executor."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cellgrad/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.parquet(path)


_WRITTEN: list[list[str]] = []


@contextmanager
def written_tables():
    """The folders that ``materialize`` writes within the block, in order: a job
    can drop its intermediate tables once those who read them are done."""
    _WRITTEN.append([])
    try:
        yield _WRITTEN[-1]
    finally:
        _WRITTEN.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``materialize`` wrote.  Frames that still read them
    fail from then on."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class VersionStore:
    """Weight versions ``(iter, *columns)`` in one shared folder with a
    sub-folder per step, so a history of any length is read by one scan.

    A step counts once its folder has the marker that the writer leaves when
    all its files are there.  With a ``path`` of its own a store is found again
    by a later run: ``last_step`` is the last step up to which all are complete,
    and a half-written one is written over."""

    CELLS = "id long, i long, j long, v double"
    DONE = "_SUCCESS"

    def __init__(self, spark: SparkSession, columns: str = CELLS, path: str | None = None):
        self.spark = spark
        self.columns = columns
        self.names = [c.split()[0] for c in columns.split(", ")]
        self.path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/cellgrad/history-{uuid.uuid4().hex}").rstrip("/")

    def _step(self, step: int) -> str:
        return f"{self.path}/iter={step}"

    @staticmethod
    def files(cells: int) -> int:
        return -(-cells // 500_000) or 1

    def write(self, step: int, weights: DataFrame, cells: int) -> DataFrame:
        """``cells``: the model's size, a file for each half million.  The cells
        are dealt anew: a coalesced task would run the final aggregate of every
        shuffle partition itself, with the memory of all their hash maps."""
        weights.select(*self.names).repartition(self.files(cells)).write.mode("overwrite").parquet(self._step(step))
        return self.read(step)

    def read(self, step: int) -> DataFrame:
        return self.spark.read.schema(self.columns).parquet(self._step(step))

    def complete(self, step: int) -> bool:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self._step(step)}/{self.DONE}")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def last_step(self) -> int:
        """The last step of an unbroken row of complete ones, -1 for none."""
        step = -1
        while self.complete(step + 1):
            step += 1
        return step

    def history(self, steps: int | None = None) -> DataFrame:
        """All versions, those up to ``steps`` where it is given."""
        kept = self.spark.read.schema(f"{self.columns}, iter long").parquet(self.path).select("iter", *self.names)
        return kept if steps is None else kept.where(F.col("iter") <= steps)


def broadcast_cap(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_CAP_CONF, str(DEFAULT_BROADCAST_CAP)))


def bounded_broadcast(df: DataFrame, max_rows: int,
                      row_bytes: int = CELL_ROW_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its proven row bound fits the cap.

    ``max_rows`` must come from the shape of the data (matrix dimensions,
    number of models, number of partitions), never from sampling.  Above the
    cap the side is returned as is and the planner shuffles both sides.
    """
    if max_rows is not None and max_rows * row_bytes <= broadcast_cap(df.sparkSession):
        return F.broadcast(df)
    return df


def partitions_for(rows: int, row_bytes: int, spark: SparkSession) -> int:
    """Partitions of about ``PARTITION_BYTES`` for a table of known size, as
    many as the session shuffles into at least."""
    return max(shuffle_partitions(spark), -(-rows * row_bytes // PARTITION_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
