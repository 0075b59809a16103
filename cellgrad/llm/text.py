"""Column helpers shared by the text operators (all JVM-side expressions).

White space is the ASCII class ``[\\x20\\x09-\\x0D]`` everywhere and only A-Z
are lower-cased, so results do not depend on a locale or Unicode version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS_CHARS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_LONG = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z.  ``lower`` does just that on an all-ASCII value, and
    quickly; other values take the per-character ``translate``."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)) \
        .otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def line_key(c: Column) -> Column:
    """The form under which two lines count as equal."""
    return lower_ascii(strip_ws(c))


def lines_of(text: Column) -> Column:
    """The text cut at each \\n; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def words_of(text: Column) -> Column:
    """Words of the text, in order; null and blank texts have none."""
    t = strip_ws(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different chained seeds: 128 bits keep the
    chance of a clash among 10^13 values below 10^-12."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def doc_order(c: str = "doc_id") -> Column:
    """Documents in ascending id, rows without an id after all others."""
    return F.coalesce(F.col(c).cast("long"), F.lit(MAX_LONG))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, in place.  They come out of a
    one-row generator, which filters are not pushed through: a predicate on an
    ordinary column is rewritten over the column's expression, and with array
    lambdas that means evaluating a whole array again for each element."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__fixed")
    names = [c for c in df.columns if c not in columns]
    return df.select(*names, row).select(*names, *[F.col(f"__fixed.{n}").alias(n) for n in columns])


class Held:
    """A table whose columns are renamed by position while an operator adds
    its own, so no input name can clash; ``back`` restores the names.  An
    input column that has the name of a result column gives way to it."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"__c{k}" for k in range(len(self.names))])

    def __call__(self, name: str) -> Column:
        return F.col(f"__c{self.names.index(name)}")

    def back(self, replaced: dict[str, Column] | None = None,
             added: dict[str, Column] | None = None) -> list[Column]:
        replaced, added = replaced or {}, added or {}
        kept = [replaced.get(n, F.col(f"__c{k}")).alias(n)
                for k, n in enumerate(self.names) if n not in added]
        return kept + [c.alias(n) for n, c in added.items()]
