"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies its operator, with production parameters, to the whole of
its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrad.llm import decontaminate, license_scan, line_dedup, mixing, packing, quality, sharding, simhash
from cellgrad.llm import periodic_runs, token_counts, toxicity, url_filter, whitening
from cellgrad.llm import text as X
from cellgrad.llm.oracle import ORACLE  # noqa: F401
from cellgrad.llm.text import table

UNIGRAM_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf, "documents"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), token_counts.read_vocabulary(UNIGRAM_VOCABULARY))


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "n_words")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf, "documents"))


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source"))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), packing.read_ranks(BYTE_RANKS))


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return quality.quality_rules(docs).drop("text", "source")


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def with_tail(docs: DataFrame) -> DataFrame:
    """One document in ten gets a repeating tail: from word a on, a stretch of
    p words over and over (both numbers from the id)."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, n = F.col("_words"), F.size("_words")
    g = F.floor(crc / 10)
    cut = docs.withColumns({"_words": X.words_of(F.col("text")), "_hit": crc % 10 == 0, "_g": g})
    cut = cut.withColumn("_a", (F.col("_g") % F.greatest(n, F.lit(1))).cast("int"))
    cut = cut.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    block = F.slice(words, F.col("_a") + 1, F.col("_p"))
    times, rest = F.floor((n - F.col("_a")) / F.col("_p")).cast("int"), (n - F.col("_a")) % F.col("_p")
    tailed = F.concat(F.slice(words, F.lit(1), F.col("_a")), F.flatten(F.array_repeat(block, times)),
                      F.slice(words, F.col("_a") + 1, rest))
    return cut.select("doc_id", F.when(F.col("_hit") & (n > 0), F.array_join(tailed, " "))
                      .otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_tail(table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("_top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"),
        F.col("_top.length").alias("length"), (-F.col("_top.period")).alias("period"),
        F.expr("1000 * _top.length div -_top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained"))
                        .alias("_at", "_c")).select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_license_scan, op3_line_dedup, op4_token_counts, op5_sharding,
                            op6_simhash, op7_mixing, op8_packing, op9_quality, op10_url_filter,
                            op11_toxicity, op12_periodic_runs, op13_whitening)}


