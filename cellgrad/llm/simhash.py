"""SimHash near-dedup by the generalised pigeonhole principle.

1. Fingerprints: 3-word shingles of the A-Z-lower-cased text, hashed with
   XXH64 (seed 42); a bit is set if it is set in more than half of the hashes.
2. Distinct fingerprints are kept with their smallest document, so copies cost
   one row from here on.
3. The 64 bits are grouped into parts of correlated bits, from the bit
   correlations over all distinct fingerprints.
4. Two fingerprints within ``radius`` bits agree up to t_i bits in some part i
   whenever the thresholds t_i (-1: part not probed) add up to
   radius - parts + 1.  Each fingerprint gets the thresholds that a dynamic
   programme over the parts finds cheapest, from estimated candidate counts:
   how many fingerprints hold the part value and its neighbours.  A crowded
   part value is thus left out, or probed through a wider ball elsewhere.
5. Fingerprints are indexed under each part value, probes meet them in an equi
   join, and pairs within ``radius`` bits are links.
6. Connected components of the links; each document gets the smallest doc_id
   of its component.

Estimates come from a table of the crowded part values, those held by more
than ``CROWDED`` times the average; there are at most 2^bits / CROWDED of
them and at most n / (average * CROWDED), which bounds the broadcast.  They
steer cost only; any thresholds of the right sum give the same links.

Defined cases: a null, empty or blank text has fingerprint zero and links like
any other; fewer words than the shingle length make one shingle of all words;
repeated rows each get a row; rows without a doc_id get the component's
smallest id, null if none has one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.llm.components import components
from cellgrad.llm.text import MAX_LONG, Held
from cellgrad.session import materialize, ship_package

SHINGLE = 3
RADIUS = 2
SEED = 42
CROWDED = 4


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text in UTF-8.  On bytes, lower() and
    split() know just A-Z and the six ASCII white-space characters."""
    import xxhash
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined = b" ".join(words)
    starts = [0, *ends]
    count, votes = len(words) - shingle + 1, np.zeros(64, np.int64)
    for lo in range(0, count, 65536):  # bounded memory for very long texts
        hi = min(count, lo + 65536)
        hashes = np.fromiter((digest(joined[starts[k]:ends[k + shingle - 1] - 1], SEED)
                              for k in range(lo, hi)), np.uint64, hi - lo)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2).cast(pa.binary())),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


# ------------------------------------------------------------------ parts
def bit_counts(fps: DataFrame) -> np.ndarray:
    """65 x 64 numbers: how often two bits are set together, and the total in
    the last row; summed in Spark from one small table per task."""
    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8)
            bits = np.unpackbits(values.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for lo in range(0, len(bits), 65536):
                part = bits[lo:lo + 65536]
                total += part.T @ part
            n += len(bits)
        if n:
            cells = np.append(total.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], ["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(65 * 64)
    for r in sums:
        out[r["cell"]] = r["n"]
    return out.reshape(65, 64)


def bit_parts(counts: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of (nearly) equal size: each group
    starts with the free bit that has most correlation left and takes the free
    bits most correlated with it."""
    n = max(1.0, counts[64, 0])
    mean = np.diag(counts[:64]) / n
    cov = counts[:64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for p in range(parts):
        size = len(free) // (parts - p)
        group = [max(free, key=lambda k: (corr[k, free].sum(), -k))]
        while len(group) < size:
            group.append(max((k for k in free if k not in group), key=lambda k: (corr[k, group].sum(), -k)))
        out.append(sorted(group))
        free = [k for k in free if k not in group]
    return out


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as one number."""
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


@lru_cache(maxsize=64)
def ball(width: int, radius: int) -> np.ndarray:
    """Masks that flip up to ``radius`` of ``width`` bits, none first."""
    return np.array([sum(1 << k for k in c) for r in range(radius + 1)
                     for c in combinations(range(width), r)], np.uint64)


def part_count(n: int) -> int:
    """Parts so that a part value is held by about one of n fingerprints."""
    return int(min(4, max(2, round(64 / max(1.0, np.log2(max(n, 2)))))))


def thresholds(cost: np.ndarray, radius: int) -> np.ndarray:
    """cost[i, t + 1, row]: cost of threshold t (-1 .. radius) in part i.
    Returns (row, part) thresholds of least total cost that add up to
    radius - parts + 1, by dynamic programming over the parts."""
    parts, levels, rows = cost.shape
    # A state is the sum of t + 1 so far, from 0 to radius + 1.
    best = np.full((radius + 2, rows), np.inf)
    best[0] = 0
    choice = np.zeros((parts, radius + 2, rows), np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for s in range(radius + 2):
            for level in range(min(levels - 1, s) + 1):
                total = best[s - level] + cost[i, level]
                better = total < new[s]
                new[s][better] = total[better]
                choice[i, s][better] = level
        best = new
    out = np.zeros((rows, parts), np.int64)
    state = np.full(rows, radius + 1)
    for i in reversed(range(parts)):
        level = choice[i, state, np.arange(rows)]
        out[:, i] = level - 1
        state = state - level
    return out


def estimated(values: np.ndarray, width: int, radius: int, known: np.ndarray, held: np.ndarray,
              usual: float) -> np.ndarray:
    """Estimated holders of the values within ``radius`` flips of each value."""
    masks = ball(width, radius)
    total = np.full(len(values), usual * len(masks))
    for mask in masks if len(known) else ():
        near = values ^ mask
        at = np.minimum(np.searchsorted(known, near), len(known) - 1)
        hit = known[at] == near
        total[hit] += held[at[hit]] - usual
    return total


def probe_costs(fps: np.ndarray, parts: list[list[int]], crowd: list, n: int, radius: int) -> np.ndarray:
    """cost[i, t + 1, row]: probes plus estimated candidates."""
    cost = np.zeros((len(parts), radius + 2, len(fps)))
    for i, bits in enumerate(parts):
        values, width, usual = part_values(fps, bits), len(bits), n / 2.0 ** len(bits)
        known, held = crowd[i]
        for t in range(radius + 1):
            cost[i, t + 1] = len(ball(width, t)) + estimated(values, width, t, known, held, usual)
    return cost


def probes(fps: np.ndarray, parts: list[list[int]], levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, value, fp) of every probe."""
    out: list[tuple] = []
    for i, bits in enumerate(parts):
        values = part_values(fps, bits)
        for t in range(levels[:, i].max(initial=-1) + 1):
            at = np.flatnonzero(levels[:, i] == t)
            masks = ball(len(bits), t)
            near = (values[at][:, None] ^ masks[None, :]).ravel()
            out.append((np.full(len(near), i, np.int32), near, np.repeat(fps[at], len(masks))))
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


SLICE = 4096


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints (column fp) within ``radius`` bits."""
    spark = fps.sparkSession
    n = fps.count()
    parts = bit_parts(bit_counts(fps), part_count(n))
    names = ["part", "value", "fp"]

    def rows(i: np.ndarray, values: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(values.view(np.int64)), pa.array(f.view(np.int64))],
                                          names)

    def read(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(values), SLICE):
                yield values[lo:lo + SLICE]

    def index(batches):
        for f in read(batches):
            for i, bits in enumerate(parts):
                yield rows(np.full(len(f), i, np.int32), part_values(f, bits), f)

    indexed = materialize(fps.select("fp").mapInArrow(index, "part int, value long, fp long"), "simhash-index")
    usual = [n / 2.0 ** len(b) for b in parts]
    least = [max(2.0, CROWDED * u) for u in usual]
    limit = F.element_at(F.array(*[F.lit(x) for x in least]), F.col("part") + 1)
    heavy = indexed.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    # At most n / least values per part can be that crowded; past 2^16 of them
    # only the most crowded steer.
    found = heavy.orderBy(F.desc("n"), "part", "value").limit(1 << 16).collect()
    crowd = []
    for i in range(len(parts)):
        own = sorted((r["value"] & (1 << 64) - 1, r["n"]) for r in found if r["part"] == i)
        crowd.append((np.array([v for v, _ in own], np.uint64), np.array([c for _, c in own], np.float64)))
    shared = spark.sparkContext.broadcast(crowd)

    def probe(batches):
        for f in read(batches):
            levels = thresholds(probe_costs(f, parts, shared.value, n, radius), radius)
            yield rows(*probes(f, parts, levels))

    probing = fps.select("fp").mapInArrow(probe, "part int, value long, fp long")
    pairs = (probing.withColumnRenamed("fp", "_p").join(indexed.withColumnRenamed("fp", "_q"),
                                                        ["part", "value"])
             .where((F.col("_p") != F.col("_q"))
                    & (F.bit_count(F.col("_p").bitwiseXOR(F.col("_q"))) <= radius)))
    return pairs.select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b")).distinct()


def _groups(marked: DataFrame, radius: int) -> DataFrame:
    """The materialized ``marked`` with component_id and _first, whether the
    row is its component's first: smallest id (none: last), then text hash."""
    first = F.struct(F.coalesce("doc_id", F.lit(MAX_LONG)).alias("id"), F.col("text_hash").alias("th"))
    classes = materialize(marked.groupBy("fp").agg(F.min(first).alias("_least")), "fingerprint-classes")
    label = components(links(classes, radius)).withColumnRenamed("node", "fp")
    named = classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("_least").alias("_top"))
    by_fp = materialize(named.join(least, "label").select("fp", "_top"), "fingerprint-components")
    return marked.join(by_fp, "fp").select(
        "doc_id", "text_hash", "fp", F.when(F.col("_top.id") != MAX_LONG, F.col("_top.id")).alias("component_id"),
        (first == F.col("_top")).alias("_first"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each of ``docs``."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return _groups(marked, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component left, the one with the
    smallest id; of several rows with this id and text, the one whose row hash
    is smallest.  Column names may be any."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    keep = (_groups(marked, radius).where("_first").groupBy(F.col("doc_id").alias("_kid"), F.col("text_hash").alias("_kth"))
            .agg(F.count("*").alias("_rows")))
    keep = materialize(keep, "kept-ids")
    held = Held(docs)
    rows = held.df.withColumns({"_id": held(id_col).cast("long"), "_th": F.xxhash64(held(text_col))})
    same = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_th") == F.col("_kth"))
    stay = rows.join(keep.where("_rows = 1"), same, "left_semi").select(*held.df.columns)
    if not keep.where("_rows > 1").isEmpty():
        again = rows.join(keep.where("_rows > 1"), same, "left_semi")
        hashable = [c for c, t in held.df.dtypes if not t.startswith(("map", "variant"))]
        one = again.groupBy("_id", "_th").agg(F.min_by(F.struct(*held.df.columns), F.xxhash64(*hashable)).alias("_one"))
        stay = stay.unionByName(one.select("_one.*"))
    return stay.select(*held.back())
