"""Quality rules by cross-document line frequency.

Every normalised line (stripped, A-Z lower-cased, with at least one word) is
hashed; for each host the distinct documents that hold it are counted, copies of
one text each.  A line held by more than ``min_docs`` documents of a host is
boilerplate and is removed, whatever the host's size; a document left with less
than ``min_left_pct`` of its words is depleted and rejected.  Documents are also
rejected by plain measures of their own text (``base_failed``).

Everything is DataFrame functions.  Only hashes, counts and measures are
shuffled, never texts.

Defined cases: a null text has no words and fails; an empty text likewise;
rows without a host form one host of their own; repeated rows (equal id and text;
rows without an id are told apart by their text) count once and each get the same
verdict; an empty table gives an empty result; input columns
named like a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrad.llm import text as X
from cellgrad.session import materialize

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
MIN_DOCS = 20
MIN_LEFT_PCT = 30
LINE = ["_host", "_h1", "_h2"]


def with_measures(df: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    n_repeat_words counts the words in windows of ``WINDOW`` words found twice
    or more in the text.  Windows are compared by 64-bit hashes of their word
    hashes; equal neighbours in sorted order are repeats, and the words they
    cover are counted over their sorted starts: n log n for a long text."""
    t = F.coalesce(text, F.lit(""))
    df = (df.withColumn("_words", X.words_of(text))
          .withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
          .withColumn("_lines", F.filter(X.lines_of(text), lambda x: X.strip_ws(x) != "")))
    wh, n = F.col("_wh"), F.size("_wh")
    # Each array below is named at least twice where it is used: the optimizer
    # then keeps it as a computed column instead of redoing it per element.
    df = df.withColumn("_win", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda k: F.xxhash64(F.slice(wh, k, WINDOW)))))
    win = F.col("_win")
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.array_sort(F.transform(win, lambda x, k: F.struct(x.alias("x"), k.alias("k"))))))
    s, m = F.col("_sorted"), F.size("_sorted")
    same = lambda a, b: F.coalesce(F.get(s, a)["x"] == F.get(s, b)["x"], F.lit(False))
    df = df.withColumn("_starts", F.when(s.isNotNull(), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), m - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
        lambda k: F.get(s, k)["k"]))))
    st = F.col("_starts")
    covered = F.aggregate(
        F.transform(st, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(st, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return X.fixed(df, **{
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(X.WS_CLASS))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(st.isNull(), F.lit(0)).otherwise(covered).cast("long"),
    }).drop("_words", "_wh", "_lines", "_win", "_sorted", "_starts")


def _host(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("\x00none"))


ROW = ["_host", "_doc", "_th"]


def _identified(held: X.Held, host_col: str, text_col: str, id_col: str) -> DataFrame:
    """Adds host, document rank and text hash, which together name a row."""
    return held.df.withColumns({"_host": _host(held(host_col)),
                                "_doc": F.coalesce(held(id_col).cast("long"), F.lit(X.MAX_LONG)),
                                "_th": F.xxhash64(F.coalesce(held(text_col), F.lit("")))})


def _lines(held: X.Held, host_col: str, text_col: str, id_col: str) -> DataFrame:
    """One row per line with a word: its row, position, key hash and words."""
    lines = (_identified(held, host_col, text_col, id_col)
             .select(*ROW, F.posexplode(X.lines_of(held(text_col))).alias("_pos", "_line"))
             .select(*ROW, "_pos", X.line_key(F.col("_line")).alias("_key"),
                     X.n_words(F.col("_line")).alias("_lw")).where(F.col("_key") != ""))
    h1, h2 = X.hash128(F.col("_key"))
    return lines.select(*ROW, "_pos", h1.alias("_h1"), h2.alias("_h2"), "_lw")


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_host, _h1, _h2) of the lines above the limit."""
    held_by = lines.select(*LINE, "_doc", "_th").distinct().groupBy(*LINE).agg(F.count("*").alias("_n"))
    return held_by.where(F.col("_n") > min_docs).select(*LINE)


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                  id_col: str = "doc_id",
                  min_docs: int = MIN_DOCS, min_left_pct: int = MIN_LEFT_PCT, clean_text: bool = True) -> DataFrame:
    """``docs`` with the measures, ``n_common_lines`` and ``n_common_words``
    (lines above the limits and their words), ``base_failed`` and ``kept``;
    with ``clean_text`` the common lines are gone from the text."""
    held = X.Held(docs)
    text = held(text_col)
    lines = materialize(_lines(held, host_col, text_col, id_col), "quality-lines")
    # Written out, so that its size is known to the planner and the hot lines,
    # which are just these, are a plain join side that can be split.
    common = materialize(common_lines(lines, min_docs), "common-lines")
    hits = (lines.join(common, LINE).dropDuplicates([*ROW, "_pos"])
            .groupBy(*ROW).agg(F.sum("_lw").alias("_cw"), F.collect_list("_pos").alias("_cpos")))
    df = with_measures(_identified(held, host_col, text_col, id_col), text)
    df = df.join(hits, ROW, "left")
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    cut = F.coalesce(F.col("_cw"), F.lit(0))
    left = n - cut
    base_failed = (n < MIN_WORDS) | (rep * 100 > n * MAX_REPEAT_PCT)
    depleted = left * 100 < n * min_left_pct
    replaced = {}
    if clean_text:
        df = df.withColumn("_lines", F.when(F.col("_cpos").isNotNull(), X.lines_of(text)))
        stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cpos"))
        replaced[text_col] = F.when(F.col("_cpos").isNull(), text).otherwise(
            F.array_join(F.transform(stay, lambda k: F.get(F.col("_lines"), k)), "\n"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(*held.back(replaced, {
        **{c: F.col(c) for c in names},
        "n_common_lines": F.when(F.col("_cpos").isNull(), 0).otherwise(F.size("_cpos")).cast("long"),
        "n_common_words": cut.cast("long"),
        "base_failed": base_failed, "kept": ~base_failed & ~depleted}))
