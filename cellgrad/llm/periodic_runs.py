"""Periodic run detection: repeated stretches inside a text, found on diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least ``max(min_length, 2 q)`` words that no neighbouring
word extends keeping the period.  It overlaps itself at lag q in at least
``max(min_length - q, q)`` words, which gives the length of a seed:

1. Index.  Lags are taken in levels, the first up to ``min_length - 1``, each
   following one twice as far.  For a level's lags the overlap is guaranteed to
   hold one k-gram, k the level's least lag (half ``min_length`` on the first).
   Grams are named by 64-bit hashes, each level's from two of the level before;
   a level without a gram that comes back ends the search.
2. Pairs.  Occurrences of one gram within one document, at a distance among the
   level's lags, are seed pairs.  Where occurrences follow each other at half a
   gram or less the text is periodic on the spot.  Two of one such series lie
   in one run, whose period divides their lag; a stretch that lies in two series
   starts where one of them starts.  So a pair is listed only if it is not of
   one series and one of its two is the first of its own.  That leaves a number
   of pairs in proportion to the text, also for one word repeated.
3. Extension.  Seeds go in order of lag and place.  A table holds for each lag
   how far it is covered; a seed inside is suppressed, any other is checked and
   extended word by word (in growing blocks) to both sides, which also proves it.
4. Of runs over the same words the one of the smallest lag is kept.

Everything happens inside one document, so there is no shuffle.  Arrow batches
are worked in slices of at most ``SLICE_WORDS`` words (or one document), so a
task holds its batch and some arrays of a slice.  A lost task is run again and
gives the same rows.

Defined cases: null, empty and blank texts have no words, no runs and an empty
collapsed text; a text shorter than ``min_length`` words has no run; every
repeated row gets its own result; a null id stays null; an empty table gives an
empty result; other input columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.session import ship_package

MIN_LENGTH = 12
SLICE_WORDS = 1 << 20
FIRST_BLOCK = 64
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values (splitmix constants)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of the grams that consist of a left and a right part."""
    return _mixed(left * np.uint64(3) + _mixed(right))


def _pairs(names: np.ndarray, last: np.ndarray, low: int, high: int, gram: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(place, lag) of seed pairs with low <= lag < high; None if no gram
    comes back at all.  ``last``: the final place of each place's document."""
    order = np.argsort(names, kind="stable")
    sorted_names, place = names[order], order.astype(np.int64)
    alike = sorted_names[1:] == sorted_names[:-1]
    keep = np.zeros(len(place), bool)
    keep[1:] |= alike
    keep[:-1] |= alike
    if not keep.any():
        return None
    sorted_names, place = sorted_names[keep], place[keep]
    fits = place + gram - 1 <= last[place]
    sorted_names, place = sorted_names[fits], place[fits]
    new = np.ones(len(place), bool)
    new[1:] = sorted_names[1:] != sorted_names[:-1]
    # One ascending key for gram and place: ranges of places are ranges of it.
    group = (np.cumsum(new) - 1) * np.int64(len(names) + 2 * high)
    key = group + place
    follows = np.zeros(len(place), bool)  # an occurrence half a gram before
    if low > 1:
        gap = place[1:] - place[:-1]
        follows[1:] = ~new[1:] & (2 * gap <= gram) & (place[1:] <= last[place[:-1]])
    head = np.flatnonzero(~follows)
    at, to = _ranges(head, key, group, place, low, high)
    back_at, back_to = _ranges(head, key, group, place, 1 - high, 1 - low)
    behind = follows[back_to]
    left = np.concatenate([at, back_to[behind]])
    right = np.concatenate([to, back_at[behind]])
    series = np.cumsum(~follows)
    own = (series[left] != series[right]) & (place[right] <= last[place[left]])
    left, right = place[left[own]], place[right[own]]
    return left, right - left


def _ranges(head: np.ndarray, key: np.ndarray, group: np.ndarray, place: np.ndarray,
            low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (of a head, of an occurrence of its gram) for all occurrences
    low <= distance < high away."""
    # Never back into the gram before; places leave `high` free behind a gram.
    first, end = (np.searchsorted(key, np.maximum(key[head] + d, group[head])) for d in (low, high))
    many = end - first
    total = int(many.sum())
    at = np.repeat(head, many)
    to = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return at, to


def _reach(words: np.ndarray, at: int, lag: int, bound: int, way: int) -> int:
    """How many words from ``at`` on (way 1, up to ``bound``, exclusive) or
    back (way -1, down to ``bound``) equal the one ``lag`` later."""
    count, block = 0, FIRST_BLOCK
    while True:
        if way > 0:
            lo, hi = at + count, min(at + count + block, bound)
        else:
            lo, hi = max(at - count - block + 1, bound), at - count + 1
        if lo >= hi:
            return count
        differ = np.flatnonzero(words[lo:hi] != words[lo + lag:hi + lag])
        if len(differ):
            return count + int(differ[0] if way > 0 else hi - lo - 1 - differ[-1])
        count += hi - lo
        block *= 2


def runs_of(words: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document of a slice, by start, then
    period.  ``words``: the documents' word numbers, one after the other;
    ``ends``: where each document ends."""
    ends = np.asarray(ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    sizes = ends - starts
    if not len(words) or sizes.max() < min_length:
        return out
    owner = np.repeat(np.arange(len(ends)), sizes)
    last = ends[owner] - 1
    gram = max(1, min_length // 2)
    names = _mixed(words.astype(np.uint64))
    one, size = names, 1
    while size < gram:  # a gram of `size` words and the next single word
        names, size = _joined(names[:-1], one[size:]), size + 1
        if not len(names):
            return out
    low, high, longest = 1, max(2, min_length), int(sizes.max())
    best: dict[tuple[int, int, int], int] = {}
    while 2 * low <= longest and len(names):
        found = _pairs(names, last, low, high, gram)
        if found is None:
            break
        at, lag = found
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # A seed right behind another one of its lag lies on the same stretch.
        first = np.ones(len(at), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for place, q in zip(at[first].tolist(), lag[first].tolist()):
            if place < covered.get(q, 0):
                continue
            doc = int(owner[place])
            ahead = _reach(words, place, q, int(ends[doc]) - q, 1)
            if not ahead:  # names clash, words differ
                continue
            back = _reach(words, place - 1, q, int(starts[doc]), -1)
            covered[q] = place + ahead
            length = back + ahead + q
            if length >= max(min_length, 2 * q):
                key = (doc, place - back - int(starts[doc]), length)
                best[key] = min(best.get(key, q), q)
        # Grams twice as long for lags twice as far.
        low, high = high, 2 * high
        if low > gram:
            names = _joined(names[:-gram], names[gram:]) if len(names) > gram else names[:0]
            gram *= 2
    for (doc, start, length), q in best.items():
        out[doc].append((start, length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first ``period`` words."""
    if not runs:
        return words
    kept, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if start > at:
            kept += words[at:start]
        at = max(at, end)
    return kept + words[at:]


def _slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for t in texts:
        # Without an argument split cuts at exactly space and \x09-\x0D.
        words = t.split() if t else []
        if held and size + len(words) > SLICE_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH) -> DataFrame:
    """(id_col, n_words, runs, collapsed) for each of ``docs``: all runs by
    start, then period, and the text without the words that only repeat."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = 0
            for held in _slices((t.as_py() for t in batch.column(1))):
                numbers: dict[bytes, int] = {}
                flat = np.array([numbers.setdefault(w, len(numbers)) for words in held for w in words], np.int64)
                runs = runs_of(flat, np.cumsum([len(w) for w in held]), min_length)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(held)), pa.array([len(w) for w in held], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs], kind),
                    pa.array([b" ".join(kept_words(w, own)).decode("utf-8", "replace") for w, own in zip(held, runs)],
                             pa.string())], ["_id", "n_words", "runs", "collapsed"])
                at += len(held)

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    found = slim.mapInArrow(run, f"_id {dict(docs.dtypes)[id_col]}, {RESULT}")
    return found.toDF(id_col, *found.columns[1:])
