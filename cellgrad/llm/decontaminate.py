"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised to their letters and digits, lower-cased.  A benchmark
item contaminates a document when some window of the item (half of it, 50
characters at least and 200 at most, the whole of a shorter item) lies within ``rate`` edits
per character of some stretch of the document.

1. Filter: for a window of w characters and e edits, two such regions share at
   least w + 1 - q * (e + 1) q-grams, and all shared ones lie on diagonals
   (document position - item position) that differ by at most e.  Diagonals
   are cut into bands of a fixed width that overlap by e, so some band holds
   all of them; bands below the bound are discarded, also when no stretch of
   the window's length in the band reaches it.
2. Verify: banded alignment of the item's windows around the retained region
   with the document, within the edit budget, then grown to the whole item if
   that keeps to the rate.

Items without a usable bound (shorter than q) are searched as a whole.

The benchmark is read in blocks of at most ``block_chars`` characters, each
block a pass over the documents, so what a task holds is bounded whatever the
benchmark's size.  Documents are processed in slices of ``SLICE`` characters;
nothing is shuffled.

Defined cases: null and empty texts and items match nothing; texts without a
letter or digit likewise; repeated rows each get a row; an empty benchmark or
empty documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.llm import text as X
from cellgrad.session import materialize, ship_package

Q = 10
RATE = 0.05
MIN_WINDOW = 50
MAX_WINDOW = 200
BLOCK_CHARS = 2_000_000
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
MATCH = "doc_id long, item_id long, edits int, item_start int, item_end int, doc_start long, doc_end long"
SPAN = ["doc_id", "item_id", "edits", "item_start", "item_end", "doc_start", "doc_end"]

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> whether it is a letter or digit; built once per worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(k).isalnum() for k in range(0x110000)])
    return _LETTER


# The same, as byte tables, for texts within Latin-1.
LATIN_LOWER = bytes(ord(chr(k).lower()) if len(chr(k).lower()) == 1 and ord(chr(k).lower()) < 256 else k
                    for k in range(256))
LATIN_OTHER = bytes(k for k in range(256) if not chr(k).isalnum())


def normalised(text: str | None, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of the letters and digits, lower-cased, and their places in
    the text.  Characters whose lower case is longer than one keep themselves."""
    text = text or ""
    if not places:
        try:
            latin = text.encode("latin-1").translate(LATIN_LOWER, LATIN_OTHER)
            return np.frombuffer(latin, np.uint8).astype(np.uint32), None
        except UnicodeEncodeError:
            pass
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _letters()[codes]
    return codes[keep], np.flatnonzero(keep) if places else None


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    powers = {1: codes.astype(np.uint64) + np.uint64(1)}
    size = 1
    while 2 * size <= q:
        h, mult = powers[size], np.uint64(pow(BASE, size, 1 << 64))
        powers[2 * size] = h[:-size] * mult + h[size:]
        size *= 2
    out, done = powers[size], size
    for part in sorted(powers, reverse=True):
        while done + part <= q:
            n = len(codes) - (done + part) + 1
            out = out[:n] * np.uint64(pow(BASE, part, 1 << 64)) + powers[part][done:done + n]
            done += part
    return out ^ (out >> np.uint64(29))


class Benchmark:
    """A block of items and the postings of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE,
                 min_window: int = MIN_WINDOW):
        self.q, self.rate = q, rate
        self.ids, self.codes, self.window, self.edits, self.bound, self.short = [], [], [], [], [], []
        hashes, owner, place = [], [], []
        for item_id, text in items:
            codes, _ = normalised(text)
            if not len(codes):
                continue
            if len(codes) < q:
                self.short.append((item_id, "".join(map(chr, codes))))
                continue
            w = min(len(codes), max(min_window, min(-(-len(codes) // 2), MAX_WINDOW)))
            e = min(int(rate * w), w // q - 1)
            k = len(self.ids)
            self.ids.append(item_id)
            self.codes.append(codes)
            self.window.append(w)
            self.edits.append(e)
            self.bound.append(w + 1 - q * (e + 1))
            h = grams(codes, q)
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int64))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, np.int64)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        # A bit table of 16 to 32 slots per gram answers most look-ups.
        self.shift = np.uint64(64 - max(10, int(len(self.keys)).bit_length() + 4))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self._slot(self.keys)] = True
        self.band = np.array([1 << max(4, int(e).bit_length()) for e in self.edits], np.int64)
        self.edits_of = np.array(self.edits, np.int64)
        self.bound_of = np.array(self.bound, np.int64)
        self.window_of = np.array(self.window, np.int64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(BASE)) >> self.shift

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document position, item position) of every shared q-gram."""
        out = []
        for lo in range(0, max(1, len(codes) - self.q + 1), SLICE):
            h = grams(codes[lo:lo + SLICE + self.q - 1], self.q)
            at = np.flatnonzero(self.maybe[self._slot(h)])
            if not len(at) or not len(self.keys):
                continue
            key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            sure = self.keys[key] == h[at]
            at, key = at[sure], key[sure]
            n = self.count[key]
            entry = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append((self.owner[entry], np.repeat(at + lo, n), self.place[entry]))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Regions that reach the bound: (item, item from, to, diagonal).
        Bands overlap, so a region may be found twice."""
        item, pos, place = self.hits(codes)
        if not len(item):
            return []
        # Few shared q-grams on any diagonal are dismissed together.
        diag = pos - place + len(codes)  # shifted to be positive
        width, e = self.band[item], self.edits_of[item]
        band = diag // width
        again = (diag % width < e) & (band > 0)  # also lies in the band below
        item, pos, place, band = (np.concatenate([x, y[again]]) for x, y in (
            (item, item), (pos, pos), (place, place), (band, band - 1)))
        order = np.lexsort((pos, band, item))
        item, pos, place, band = item[order], pos[order], place[order], band[order]
        edge = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]), True])
        out = []
        size = np.diff(edge)
        for g in np.flatnonzero(size >= self.bound_of[item[edge[:-1]]]):
            lo, hi = edge[g], edge[g + 1]
            k = int(item[lo])
            need, reach = self.bound[k], self.window[k] + self.edits[k] - self.q
            p = pos[lo:hi]
            # Hit j starts a dense stretch if the need-th hit from it is near.
            near = np.flatnonzero(p[need - 1:] - p[:len(p) - need + 1] <= reach)
            if not len(near):
                continue
            dense = np.zeros(len(p) + 1, np.int64)
            np.add.at(dense, near, 1)
            np.add.at(dense, near + need, -1)
            inside = np.flatnonzero(np.cumsum(dense)[:-1] > 0)
            # Stretches further apart than a window are regions of their own.
            for run in np.split(inside, np.flatnonzero(np.diff(p[inside]) > reach) + 1):
                own = place[lo:hi][run]
                diags, votes = np.unique(p[run] - own, return_counts=True)
                out.append((k, int(own.min()), int(own.max()) + self.q, int(diags[votes.argmax()])))
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int, int]]:
        """(item id, edits, item from, to, document from, to), the document's
        places counted in characters of the text; per item the verified region
        with the longest item part (then fewest edits, then first)."""
        codes, _ = normalised(text)
        best: dict[int, tuple] = {}
        for k, i0, i1, diag in self.regions(codes) if len(codes) >= self.q else ():
            if k in best and best[k][0][:2] == (-len(self.codes[k]), 0) and best[k][0][2] <= diag:
                continue  # the whole item was found without edits, no later
            slack = int(self.band[k]) + self.edits[k]
            found = verified(self.codes[k], codes, i0, i1, diag, slack, self.window[k], self.edits[k],
                             self.rate, self.q)
            if found:
                edits, a0, a1, b0, b1 = found
                rank = (-(a1 - a0), edits, b0)
                if k not in best or rank < best[k][0]:
                    best[k] = (rank, (self.ids[k], edits, a0, a1, b0, b1))
        out = [x for _, x in best.values()]
        if self.short and len(codes):
            squeezed = "".join(map(chr, codes))
            for item_id, s in self.short:
                at = squeezed.find(s)
                if at >= 0:
                    out.append((item_id, 0, 0, len(s), at, at + len(s)))
        if out:
            _, places = normalised(text, places=True)
            out = [(i, e, a, b, int(places[c]), int(places[d - 1]) + 1) for i, e, a, b, c, d in out]
        return sorted(out, key=lambda m: (m[0] is None, m[0] or 0, m[4]))


def best_placed(part: np.ndarray, doc: np.ndarray, at: int, slack: int, budget: int) -> tuple[int, int, int] | None:
    """Banded alignment of the whole ``part`` with a stretch of ``doc`` that
    starts within ``slack`` of ``at``: (edits, from, to) with the fewest edits,
    None beyond ``budget``.  A row holds the diagonals within slack + budget."""
    far = budget + 1
    off = np.arange(-slack - budget, slack + budget + 1)
    step = np.arange(len(off))
    start = at + off
    cost = np.where((np.abs(off) <= slack) & (start >= 0) & (start <= len(doc)), 0, far)
    for i in range(len(part)):
        pos = at + i + off
        inside = (pos >= 0) & (pos < len(doc))
        sub = np.where(inside, cost + (doc[np.clip(pos, 0, len(doc) - 1)] != part[i]), far)
        drop = np.append(cost[1:], far) + 1
        new = np.where(sub <= drop, sub, drop)
        begin = np.where(sub <= drop, start, np.append(start[1:], 0))
        lead = new - step  # inserts move along the row at a cost of one each
        low = np.minimum.accumulate(lead)
        since = np.maximum.accumulate(np.where(lead == low, step, 0))
        cost, start = low + step, begin[since]
        cost = np.where((pos + 1 >= 0) & (pos + 1 <= len(doc)), np.minimum(cost, far), far)
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), at + len(part) + int(off[end])


def verified(item: np.ndarray, doc: np.ndarray, i0: int, i1: int, diag: int, slack: int, window: int,
             edits: int, rate: float, q: int) -> tuple[int, int, int, int, int] | None:
    """A window of the item that can hold the region's shared q-grams and
    aligns within ``edits``, grown to the whole item or to the region if that
    keeps to the rate: (edits, item from, to, document from, to)."""
    size = len(item)
    if 0 <= diag <= len(doc) - size and np.array_equal(doc[diag:diag + size], item):
        return 0, 0, size, diag, diag + size  # the whole item on one diagonal
    likely = max(0, min(i0, size - window))
    lows = range(max(0, i0 - window + q), max(0, min(i1 - q, size - window)) + 1)
    for a0 in sorted({likely, *lows}, key=lambda k: (abs(k - likely), k)):
        found = best_placed(item[a0:a0 + window], doc, diag + a0, slack, edits)
        if found is None:
            continue
        a1 = a0 + window
        for c0, c1 in ((0, size), (min(a0, i0), max(a1, i1))):
            grown = best_placed(item[c0:c1], doc, diag + c0, slack, max(edits, int(rate * (c1 - c0))))
            if grown:
                return grown[0], c0, c1, grown[1], grown[2]
        return found[0], a0, a1, found[1], found[2]
    return None


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list]:
    """The benchmark, item by item, in blocks; one block at a time is held."""
    block, chars = [], 0
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.length(text_col) > 0)
    for r in rows.orderBy(id_col, text_col).toLocalIterator():
        if block and chars + len(r[1]) > block_chars:
            yield block
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1])
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE,
                   min_window: int = MIN_WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: the edits, the item's part
    (in normalised characters) and the document's part (in characters)."""
    return _found(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                  benchmark, item_id, item_text, q, rate, min_window, block_chars)


def _found(slim: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", q: int = Q,
           rate: float = RATE, min_window: int = MIN_WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The matches of rows ``(doc_id, text)``; ``doc_id`` may be any long."""
    spark = slim.sparkSession
    ship_package(spark)
    out = spark.createDataFrame([], MATCH)
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)  # at most block_chars and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Benchmark(shared.value, q, rate, min_window)
            schema = pa.schema([(n, pa.int64()) for n in SPAN[:2]] + [(n, pa.int32()) for n in SPAN[2:5]]
                               + [(n, pa.int64()) for n in SPAN[5:]])
            for batch in batches:
                found = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1))
                         for m in index.matches(t.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 7, schema)], schema=schema)

        out = out.unionByName(slim.mapInArrow(run, MATCH))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Whether a row goes depends on its text alone, so rows are told by a
    64-bit hash of the text (a clash with one of the leaks has a chance of rows x
    leaks / 2^64): a row without an id, or
    with the id of another, stays or goes by its own text.  Column names may be
    any; ``id_col`` is not read."""
    held = X.Held(docs)
    text = held(text_col)
    rows = held.df.withColumn("_h", F.xxhash64(text))
    hits = _found(rows.select(F.col("_h").alias("doc_id"), text.alias("text")), benchmark, **options)
    leaks = materialize(hits.select(F.col("doc_id").alias("_h")).distinct(), "leaks")
    return rows.join(leaks, "_h", "left_anti").select(*held.back())
