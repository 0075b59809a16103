"""Sharding by vector bin packing over bytes, tokens and rows.

Documents with equal texts form a group and stay together unless the group is
large against a shard.

1. One pass measures every document: size (UTF-8 bytes plus ``ROW_BYTES``),
   words, and a 128-bit hash of the text that names its group.
2. Groups above 1/``GRAIN`` of a shard in any dimension are items of their
   own; those above 1/``SPLIT`` of a shard are cut by document into pieces of
   about 1/``PIECE`` of a shard.  All other groups are dealt by hash into shards *
   ``GRAIN`` bundles.  There can be at most 3 * shards * ``GRAIN`` large
   groups and 6 * shards * ``PIECE`` pieces, so the items are bounded by the
   parameters, whatever the corpus.
3. The items, largest share first, go each to the shard where the dot product
   of the item with the shard's residual capacity is highest, all in shares of
   a shard's capacity.  This runs on the driver over the bounded item list.
4. Every document takes its item's shard (a broadcast of bounded size) and a
   gapless slot in it: numbered within small buckets of the shard, plus the
   sizes of the buckets before.  The buckets grow in number with the rows.

Defined cases: a null text has no bytes and no words and forms a group
with other null texts; repeated rows each get a
slot; a null doc_id is kept and sorts last; fewer documents than shards leave
shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrad.llm import text as X
from cellgrad.session import materialize

SHARDS = 24
ROW_BYTES = 8
GRAIN = 256
SPLIT = 2
PIECE = 64
WEIGHTS = (1.0, 0.1, 0.1)  # bytes, tokens, rows: bytes are to come out nearly equal
BUCKET_ROWS = 4096
MIN_BUCKETS = 64
DIMS = ["_size", "_words", "_rows"]


def place(items: np.ndarray, shards: int, capacity: np.ndarray, weights=None) -> np.ndarray:
    """Shard of each item (rows: items, columns: dimensions): largest weighted
    share of a capacity first, each to the highest weighted dot product with
    the residual (the first of equal shards)."""
    share = items / np.maximum(capacity, 1e-12)
    w = np.ones(items.shape[1]) if weights is None else np.asarray(weights, float)
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for k in np.lexsort((np.arange(len(items)), -share.sum(axis=1), -(share * w).max(axis=1))):
        best = int(np.argmax((residual * w) @ share[k]))
        out[k] = best
        residual[best] -= share[k]
    return out


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    g1, g2 = X.hash128(F.col(text_col).isNull(), text)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("_size"),
        X.n_words(F.col(text_col)).alias("_words"), F.lit(1).cast("long").alias("_rows"),
        F.crc32(text.cast("binary")).alias("_crc"), g1.alias("_g1"), g2.alias("_g2"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  grain: int = GRAIN, weights=WEIGHTS) -> DataFrame:
    """(doc_id, size, n_words, text_crc32, shard, slot) for each of ``docs``."""
    spark = docs.sparkSession
    slim = materialize(measured(docs, id_col, text_col), "sizes")
    totals = slim.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMS]).first()
    capacity = np.array([totals[c] / shards for c in DIMS])
    group = ["_g1", "_g2"]
    groups = slim.groupBy(*group).agg(*[F.sum(c).alias(c) for c in DIMS])
    share = F.greatest(*[F.col(c) / max(float(k), 1e-12) for c, k in zip(DIMS, capacity)])
    pieces = F.when(share > 1 / SPLIT, F.ceil(share * PIECE)).otherwise(1).cast("long")
    large = groups.where(share * grain > 1).select(*group, pieces.alias("_pieces"))
    large = F.broadcast(materialize(large, "large-groups"))  # at most 3 * shards * grain rows
    bundles = shards * grain
    # Items: bundles of small groups by the group's hash, pieces of large ones.
    item = F.when(F.col("_pieces").isNull(), F.struct(
        F.lit(0).cast("long").alias("a"), F.pmod(F.col("_g1"), F.lit(bundles)).alias("b"), F.lit(0).cast("long").alias("c"))) \
        .otherwise(F.struct(F.col("_g1").alias("a"), F.col("_g2").alias("b"),
                            (F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.col("_pieces"))).alias("c")))
    items = slim.join(large, group, "left").withColumn("_item", item)
    loads = items.groupBy("_item").agg(*[F.sum(c).alias(c) for c in DIMS]).collect()
    loads.sort(key=lambda r: tuple(r["_item"]))
    at = place(np.array([[r[c] for c in DIMS] for r in loads], float).reshape(-1, len(DIMS)), shards, capacity, weights)
    chosen = [(*r["_item"], int(s)) for r, s in zip(loads, at)]
    where = F.broadcast(spark.createDataFrame(chosen, "_a long, _b long, _c long, shard int"))
    placed = items.withColumns({"_a": F.col("_item.a"), "_b": F.col("_item.b"), "_c": F.col("_item.c")}) \
        .join(where, ["_a", "_b", "_c"])
    buckets = max(MIN_BUCKETS, -(-int(totals["_rows"]) // (shards * BUCKET_ROWS)))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_g1"), F.lit(buckets)))
    key = ["shard", "_bucket"]
    numbered = placed.withColumn("_at", F.row_number().over(
        Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last(), *group)) - 1)
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    return numbered.join(starts.drop("_n"), key).select(
        "doc_id", F.col("_size").alias("size"), F.col("_words").alias("n_words"), F.col("_crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"), (F.col("_at") + F.col("_before")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """``docs`` as Parquet in one folder per shard, rows in slot order within
    a file."""
    # Repeats of a row go together, to the first of their slots.
    at = assign_shards(docs, shards, id_col, text_col).groupBy("doc_id", "text_crc32", "size").agg(
        F.min(F.struct("shard", "slot")).alias("_at"))
    held = X.Held(docs)
    rows = held.df.withColumns({"_id": held(id_col).cast("long")})
    text = F.coalesce(held(text_col), F.lit(""))
    rows = rows.withColumns({"_crc": F.crc32(text.cast("binary")),
                             "_size": (F.octet_length(text) + ROW_BYTES).cast("long")})
    joined = rows.join(at, rows["_id"].eqNullSafe(at["doc_id"]) & (rows["_crc"] == at["text_crc32"])
                       & (rows["_size"] == at["size"]))
    placed = joined.repartition(F.col("_at.shard"), F.floor(F.col("_at.slot") / BUCKET_ROWS)) \
        .sortWithinPartitions("_at.shard", "_at.slot")
    placed.select(*held.back({}, {"shard": F.col("_at.shard")})).write.partitionBy("shard").parquet(path)
