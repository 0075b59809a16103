"""The corpus pipeline: five stages from documents to packed token rows.

Each stage takes (spark, docs, sf_dir); ``run`` writes each result as Parquet
in the shared checkpoint folder and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrad.llm import decontaminate, mixing, packing, quality, simhash
from cellgrad.llm.queries import BYTE_RANKS
from cellgrad.llm.text import table
from cellgrad.session import drop_tables, materialize, written_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Text for a packing task: about one block of tokens.
PACK_BYTES = 4 * packing.BLOCK_TOKENS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits go from the others."""
    kept = quality.quality_rules(docs).where("kept")
    changed = F.col("n_common_lines") > 0
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.near_dedup(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in mixture order."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the packed id matrix, from consecutive documents of the mixture:
    the scan of the last stage's files loses their order, so it is made again."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    mixed = mixing.mixed_documents(docs, parts=max(1, -(-size // PACK_BYTES)))
    return packing.pack(mixed, packing.read_ranks(BYTE_RANKS))


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", packing_stage),
]

# SimHash fingerprints and the packing have no SQL form; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage.  Once a stage's result is written, its input and the
    tables it wrote on the way are dropped, so that two copies of the corpus lie in
    the checkpoint folder at most; those of the last stage stay, as its rows are
    read after the call."""
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with written_tables() as written:
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_tables(spark, [*done, *written[:-1]])
        done = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
