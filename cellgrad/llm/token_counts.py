"""Token counts of a unigram tokenizer, without building the tokens.

Spaces become marks, and a text that does not begin with one gets one.  The text
is searched whole; it is cut only where that cannot matter: before a mark that
follows another character, if no entry goes across such a place and the mark is
an entry itself.  A run of marks stays with the word behind it, so entries of
several marks match.  An Aho-Corasick automaton enumerates the vocabulary entries that
end at each character; dynamic programming carries, for each end, the best
score and the number of pieces on the way there.  Ties follow the tokenizer:
candidates for an end are met from the longest entry to the shortest and only
a strictly better one replaces the last, and where no entry covers a single
character the unknown piece is tried last, at ``UNKNOWN`` below the lowest
score.  Unknown characters count as their UTF-8 bytes if the vocabulary has
all byte pieces, else a run of them counts once.

Counts of short pieces are kept in a bounded table per worker, since words
repeat; nothing is shuffled and the vocabulary is the only thing broadcast.

Defined cases: null and empty texts have no tokens; a text of spaces has a
token for each piece of marks; a long text without spaces is one piece, whose
lists take some 100 bytes a character; repeated rows each get a row; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.session import ship_package

MARK = "▁"
PIECES = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN = 10.0
TABLE_ENTRIES = 200_000
TABLE_CHARS = 48


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(entry, score) by id, from a sentencepiece model file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of texts; holds the automaton and the table."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], unknown_id: int = 0):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for entry, score in vocabulary:
            if entry:
                self.automaton.add_word(entry, (len(entry), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        entries = {entry for entry, _ in vocabulary}
        self.bytes_known = all(f"<0x{b:02X}>" in entries for b in range(256))
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN
        self.cut = MARK in entries and not any(
            b == MARK != a for entry in entries for a, b in zip(entry, entry[1:]))
        self.table: dict[str, tuple[int, float]] = {}

    def best(self, piece: str) -> tuple[int, float]:
        """(number of pieces, score) of the best segmentation of one piece."""
        size = len(piece)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        loose = [False] * (size + 1)  # the best way here ends with an unknown
        found: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        if len(self.automaton):
            for end, entry in self.automaton.iter(piece):
                found[end].append(entry)
        for end in range(size):
            top, pieces, single, unk = None, 0, False, False
            for length, value in found[end]:  # longest first
                at = end + 1 - length
                total = score[at] + value
                single = single or length == 1
                if top is None or total > top:
                    top, pieces = total, count[at] + 1
            if not single:
                total = score[end] + self.unknown
                if top is None or total > top:
                    top, unk = total, True
                    if self.bytes_known:
                        pieces = count[end] + len(piece[end].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[end] + (0 if loose[end] else 1)
            score[end + 1], count[end + 1], loose[end + 1] = top, pieces, unk
        return count[size], score[size]

    def of(self, piece: str) -> tuple[int, float]:
        got = self.table.get(piece)
        if got is None:
            got = self.best(piece)
            if len(piece) <= TABLE_CHARS and len(self.table) < TABLE_ENTRIES:
                self.table[piece] = got
        return got

    def count(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a text."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        pieces = PIECES.findall(marked) if self.cut else [marked]
        total, score = 0, 0.0
        for n, s in map(self.of, pieces):
            total += n
            score += s
        return total, score


_COUNTERS: dict[str, Counter] = {}


def counter_of(shared, key: str) -> Counter:
    """One counter per worker process and vocabulary."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(shared.value)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) for each of ``docs``.  ``vocabulary`` is a
    tokenizer's, thousands of entries whatever the corpus."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(list(vocabulary))
    key = f"{spark.sparkContext.applicationId}-{hash(tuple(vocabulary))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(shared, key)
        for batch in batches:
            got = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in got], pa.int64()),
                 pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, score double")
