"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

1. Sample.  Labelled rows that may be learnt from are taken in hash order up to
   ``TOXIC_ROWS`` and ``CLEAN_ROWS`` (a documented bound of the fit, nothing
   else is bounded); equal texts with one label count once.
2. Lexicon.  Every word of the sample, and its first 4, 5 and 6 letters, is a
   term; a term is an entry if ``MIN_TOXIC`` toxic texts hold it and its log
   odds reach ``MIN_ODDS``.  The ``LEXICON`` entries with the most evidence
   stay, weighted by their log odds.  Words of any language and stems with
   endings never seen are found this way.
3. Features of a whole text, all rates: lexicon densities and weights, lexicon
   hits under disguise (digits and symbols for letters, letters set apart),
   second-person words and how near they stand to hits, capitals, punctuation,
   and rates of disguised, stretched and letter-by-letter words.
4. Trees (``GBTClassifier``) learn from features in which a text's lexicon comes
   from the other half of the sample, so a text's own label is never in them;
   every document is scored with the lexicon of the whole sample.
5. Calibration.  Probabilities of the sample's quarter that the trees have not
   seen, summed into ``BINS`` bins by class weight, give an isotonic regression.
   Where it is flat, ``TIE`` of the score is the tree's own probability, so
   scores keep the trees' order.

Texts are read once per pass in Arrow batches and only features and counts
leave a task; documents are not shuffled.  The lexicon, the trees and the
calibration are bounded by parameters.  A lost task is run again.

Defined cases: null, empty and blank texts have all-zero features and get the
score of those; repeated rows score the same; a null id is not held out, has no
label and stays; several labels of one id count as toxic if any is; a null label
is none; with fewer than ``MIN_CLASS`` texts of either class every score is the
share of toxic labels; an empty table gives an empty result; labels, language,
source and id are in no score, and columns of other names are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrad.session import materialize, ship_package

TOXIC_ROWS = 8_000
CLEAN_ROWS = 12_000
LEXICON = 512
MIN_TOXIC = 3
MIN_ODDS = 2.5
PREFIXES = (4, 5, 6)
NEAR = 5
TREES, DEPTH, RATE, TREE_BINS = 20, 3, 0.3, 64
BINS = 1000
TIE = 0.001
MIN_CLASS = 5
CALIBRATION_CLASS = 20
THRESHOLD = 0.3
TABLE_ENTRIES = 200_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Words that address the reader (en, de, fr, es).
SECOND_PERSON = frozenset((
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu toi te ton ta tes vous votre vos "
    "tú ti tus contigo usted ustedes vosotros").split())
# What stands for which letter in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
FEATURES = ["log_words", "hit_density", "top_weight", "weight_density", "log_hits", "disguised_density",
            "second_person_density", "second_person_near", "capitals", "capital_words", "exclamations",
            "punctuation", "disguise_rate", "stretched_rate", "letter_rate"]
STRETCHED = re.compile(r"([^\W\d_])\1\1")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LEADS = bytes(range(0xC2, 0xF5))  # first bytes of non-ASCII characters


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def core_of(token: bytes) -> str:
    return token.decode("utf-8", "replace").strip(PUNCTUATION).lower()


def terms_of(core: str) -> list[str]:
    return [core] + [core[:k] + "*" for k in PREFIXES if len(core) > k]


class Reader:
    """Features of texts under one lexicon; what is known about a token is
    kept in a bounded table, since tokens repeat."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {t.rstrip("*")[:PREFIXES[0]] for t in lexicon}  # most words begin like no entry
        self.table: dict[bytes, tuple] = {}

    def weight(self, core: str) -> float:
        if core[:PREFIXES[0]] not in self.heads:
            return 0.0
        return max(self.lexicon.get(t, 0.0) for t in terms_of(core))

    def token(self, token: bytes) -> tuple:
        """(weight, weight under disguise, second person, capitals, disguised,
        stretched, one letter)"""
        got = self.table.get(token)
        if got is None:
            core = core_of(token)
            weight, hidden, odd, plain = self.weight(core), 0.0, False, core
            if not core.isalpha():
                plain = "".join(c for c in core if c.isalpha())
                odd = bool(plain)
                if odd and not weight:
                    bare = core.translate(DISGUISE)
                    hidden = max(self.weight(plain), self.weight("".join(c for c in bare if c.isalpha())))
            stretched = STRETCHED.search(core) is not None
            if stretched and not weight and not hidden:
                hidden = self.weight("".join(c for c, d in zip(core, " " + core) if c != d))
            got = (weight, hidden, core in SECOND_PERSON, len(plain) > 1 and token.isupper(), odd, stretched,
                   len(plain) == len(core) == 1)
            if len(self.table) < TABLE_ENTRIES:
                self.table[token] = got
        return got

    def features(self, raw: bytes | None) -> list[float]:
        words = raw.split() if raw else []
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        hits = hidden = you = shouted = odd = stretched = letters = 0
        top = total = 0.0
        for token, c in Counter(words).items():
            w, h, second, caps, o, s, one = self.token(token)
            if w or h:
                best = w or h
                hits, hidden, total, top = hits + c, hidden + c * (not w), total + c * best, max(top, best)
            you, shouted, odd, stretched, letters = you + c * second, shouted + c * caps, odd + c * o, \
                stretched + c * s, letters + c * one
        near = 0
        if letters > 2:  # words spelt letter by letter
            spelt = self.spelt(words)
            hits, hidden = hits + len(spelt), hidden + len(spelt)
            total, top = total + sum(spelt), max([top, *spelt])
        if hits and you:
            marks = [k for k, t in enumerate(words) if self.token(t)[2]]
            at = 0
            for k, t in enumerate(words):
                if any(self.token(t)[:2]):
                    while at < len(marks) and marks[at] < k - NEAR:
                        at += 1
                    near += at < len(marks) and marks[at] <= k + NEAR
        size = len(raw)
        upper = size - len(raw.translate(None, UPPER))
        alpha = upper + size - len(raw.translate(None, LOWER + LEADS))
        marks_of = lambda chars: size - len(raw.translate(None, chars))
        return [math.log1p(n), hits / n, top, total / n, math.log1p(hits), hidden / n, you / n, near / max(hits, 1),
                upper / max(alpha, 1), shouted / n, marks_of(b"!?") / n, marks_of(PUNCTUATION.encode()) / size,
                odd / n, stretched / n, letters / n]

    def spelt(self, words: list[bytes]) -> list[float]:
        """Weights of lexicon words made of three or more single letters."""
        found, run = [], ""
        for t in [*words, b""]:
            if self.token(t)[6]:
                run += core_of(t)
            else:
                if len(run) > 2 and (w := self.weight(run)):
                    found.append(w)
                run = ""
        return found


# ------------------------------------------------------------------- fitting
def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic, fold, seen) of the rows to learn from; ``fold`` halves
    them for the lexicon, ``seen`` false marks the calibration quarter."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")) \
        .where(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_id"))) \
        .groupBy("_id").agg(F.max("toxic").alias("toxic"))
    drawn = lambda toxic, n: ids.where(F.col("toxic") > 0 if toxic else F.col("toxic") <= 0) \
        .orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = drawn(True, TOXIC_ROWS).unionByName(drawn(False, CLEAN_ROWS))
    chosen = F.broadcast(materialize(chosen, "toxicity-ids"))  # at most the two bounds
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    th = F.xxhash64("text")
    return materialize(rows.join(chosen, "_id").withColumn("_th", th).dropDuplicates(["_th", "toxic"]).select(
        "text", F.least("toxic", F.lit(1)).alias("toxic"), F.pmod(F.col("_th"), F.lit(2)).cast("int").alias("fold"),
        (F.pmod(F.xxhash64("_th"), F.lit(4)) > 0).alias("seen")), "toxicity-sample")


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, fold, toxic, clean): texts that hold a term, by class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                cores = {core_of(t) for t in set(text.split())}
                counts.update((term, fold, toxic) for term in {t for c in cores if c for t in terms_of(c)})
        found = list(counts.items())
        for k in range(0, len(found), 100_000):
            part = found[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([t for (t, _, _), _ in part]), pa.array([f for (_, f, _), _ in part], pa.int32()),
                pa.array([c if y else 0 for (_, _, y), c in part], pa.int64()),
                pa.array([0 if y else c for (_, _, y), c in part], pa.int64())], ["term", "fold", "toxic", "clean"])

    parts = sample.select("text", "toxic", "fold").mapInArrow(run, "term string, fold int, toxic long, clean long")
    return parts.groupBy("term", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon_of(counts: DataFrame, folds: list[int], toxic: int, clean: int) -> dict[str, float]:
    """term -> log odds, at most ``LEXICON`` entries."""
    summed = counts.where(F.col("fold").isin(folds)).groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= MIN_TOXIC)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    rows = summed.withColumn("w", odds).where(F.col("w") >= MIN_ODDS) \
        .orderBy(F.desc(F.col("w") * F.col("t")), "term").limit(LEXICON).collect()
    return {r["term"]: float(r["w"]) for r in rows}


def with_features(rows: DataFrame, text_col: str, lexicons: list[dict[str, float]], which: Column) -> DataFrame:
    """``rows`` without the text, with ``features``; ``which``: the number of
    a row's lexicon."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)
    names = [c for c in rows.columns if c != text_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != text_col) + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in shared.value]
        for batch in batches:
            got = [readers[w].features(t.as_py()) for t, w in zip(batch.column(0), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(got, pa.list_(pa.float64()))],
                                             [*names, "features"])

    return rows.select(F.col(text_col).cast("binary"), which.cast("int").alias("_which"), *names).mapInArrow(run, schema)


class Model:
    """A fitted lexicon, trees and calibration."""

    def __init__(self, base: float, lexicon: dict[str, float] | None = None, trees=None, calibration=None):
        self.base, self.lexicon, self.trees, self.calibration = base, lexicon, trees, calibration

    def probability(self, featured: DataFrame) -> DataFrame:
        made = self.trees.transform(featured.withColumn("_vector", array_to_vector("features")))
        keep = [c for c in featured.columns if c != "features"]
        return made.select(*keep, F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.0)), F.lit(1.0)).alias("_p"))

    def score(self, rows: DataFrame, text_col: str) -> DataFrame:
        """``rows`` without the text, with ``score``."""
        keep = [c for c in rows.columns if c != text_col]
        if self.trees is None:
            return rows.select(*keep, F.lit(self.base).alias("score"))
        scored = self.calibration.transform(self.probability(with_features(rows, text_col, [self.lexicon], F.lit(0))))
        return scored.select(*keep, (F.col("_calibrated") * (1 - TIE) + F.col("_p") * TIE).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    sample = sample_of(docs, labels, id_col, text_col, label_col)
    sizes = {(r["fold"], r["seen"], r["toxic"]): r["n"] for r in
             sample.groupBy("fold", "seen", "toxic").agg(F.count("*").alias("n")).collect()}
    size = lambda **at: sum(n for k, n in sizes.items() if all(
        dict(zip(("fold", "seen", "toxic"), k))[a] == x for a, x in at.items()))
    total = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).agg(
        F.sum((F.col(label_col) > 0).cast("long")), F.count("*")).first()
    base = float(total[0] or 0) / total[1] if total[1] else 0.0
    if min(size(seen=True, toxic=1), size(seen=True, toxic=0)) < MIN_CLASS:
        return Model(base)
    counts = materialize(term_counts(sample), "toxicity-terms")
    halves = [lexicon_of(counts, [f], size(fold=f, toxic=1), size(fold=f, toxic=0)) for f in (1, 0)]
    lexicon = lexicon_of(counts, [0, 1], size(toxic=1), size(toxic=0))
    rows = materialize(with_features(sample, "text", halves, F.col("fold")), "toxicity-features")
    rows = rows.coalesce(max(1, sum(sizes.values()) // 4000))
    gbt = GBTClassifier(featuresCol="_vector", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE,
                        maxBins=TREE_BINS, seed=20)
    trees = gbt.fit(rows.where("seen").withColumn("_vector", array_to_vector("features")))
    model = Model(base, lexicon, trees)
    enough = min(size(seen=False, toxic=1), size(seen=False, toxic=0)) >= CALIBRATION_CLASS
    unseen = rows.where("not seen") if enough else rows
    n_toxic, n_clean = (size(seen=False, toxic=y) if enough else size(toxic=y) for y in (1, 0))
    weight = F.when(F.col("toxic") == 1, F.lit(base / n_toxic)).otherwise(F.lit((1 - base) / n_clean))
    binned = model.probability(unseen).withColumn("_w", weight) \
        .groupBy(F.round(F.col("_p") * BINS).alias("_bin")).agg(
            (F.sum(F.col("_p") * F.col("_w")) / F.sum("_w")).alias("_p"),
            (F.sum(F.col("toxic") * F.col("_w")) / F.sum("_w")).alias("_share"), F.sum("_w").alias("_w"))
    binned = materialize(binned.select("_p", "_share", "_w"), "toxicity-bins")
    model.calibration = IsotonicRegression(featuresCol="_p", labelCol="_share", weightCol="_w",
                                           predictionCol="_calibrated").fit(binned)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for each of ``docs``."""
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return model.score(rows, "_text").select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
