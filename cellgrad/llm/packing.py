"""Token-ID output: tokenize, split, pack, write.

Documents are tokenized and closed with an end token.  A document longer than
``length`` is split losslessly into full rows and a rest.  Rests are packed by
best fit decreasing: longest first, each into the row with the least room that
still holds it, found by a segment tree over the capacities.  Packing works on
blocks of ``BLOCK_TOKENS`` tokens of consecutive documents, so a task's memory
is bounded, an input in mixture order stays mixed, and nothing is shuffled: a
lost task is redone from its own input split.

A result row is a row of the id matrix: ``ids`` holds ``length`` little-endian
ids (2 bytes each where the vocabulary fits, else 4), filled up with the end
token; ``cu_seqlens`` the cumulative segment lengths, from 0 to the number of
tokens in use; ``reset_at`` where position ids start again at 0 (each
segment's start); ``doc_ids`` and ``doc_offsets`` each segment's document and
its first token's place in that document.

Defined cases: a null or empty text is one end token; a null doc_id stays
null; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.session import ship_package

LENGTH = 2048
BLOCK_TOKENS = 4_000_000
TABLE_ENTRIES = 400_000
TABLE_CHARS = 40
# Fixed value: how byte_bpe_50k cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW = ("row_id long, n_tokens int, ids binary, cu_seqlens array<int>, reset_at array<int>, "
       "doc_ids array<long>, doc_offsets array<long>")
SCHEMA = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                    ("cu_seqlens", pa.list_(pa.int32())), ("reset_at", pa.list_(pa.int32())),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}


class Encoder(dict):
    """Text to packed ids.  The mapping holds the ids of pieces cut before
    single spaces: the tokenizer's pattern always parts a text before a space
    that a non-space follows, so pieces can be encoded one by one and reused.
    At most ``TABLE_ENTRIES`` short pieces are kept."""

    def __init__(self, ranks: dict[bytes, int], end: int | None = None):
        super().__init__()
        import tiktoken
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values(), default=-1) + 1 if end is None else end
        self.dtype = np.dtype("<u2") if max(self.end, max(ranks.values(), default=0)) < 1 << 16 else np.dtype("<u4")
        self.end_bytes = np.array([self.end], self.dtype).tobytes()

    def _plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self._plain(" " + piece)
        if len(piece) <= TABLE_CHARS and len(self) < TABLE_ENTRIES:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of the text, without an end token."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if all(p and not p[0].isspace() for p in rest):
            return self._plain(first) + b"".join(map(self.__getitem__, rest))
        # White-space runs: join the pieces that the pattern may not part.
        out, held, single = [], first, False
        for p in rest:
            if p and not p[0].isspace():
                out.append(self[held] if single else self._plain(held))
                held, single = p, True
            else:
                held, single = (" " + held if single else held) + " " + p, False
        out.append(self[held] if single else self._plain(held))
        return b"".join(out)


class Capacities:
    """A segment tree over 0..size: which capacities have an open row."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = capacity + self.leaves
        while k:
            self.any[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity >= need, and that capacity."""
        k = need + self.leaves
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k == 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        row = self.rows[capacity].pop()
        while k:
            self.any[k] -= 1
            k >>= 1
        return row, capacity


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of item indices; sizes are between 1 and ``length``."""
    open_rows, rows = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        got = open_rows.take(sizes[k])
        if got is None:
            rows.append([])
            got = len(rows) - 1, length
        row, capacity = got
        rows[row].append(k)
        if capacity > sizes[k]:
            open_rows.add(capacity - sizes[k], row)
    return rows


def packed_rows(docs: Iterator[tuple[int | None, bytes]], encoder: Encoder, length: int,
                block_tokens: int = BLOCK_TOKENS) -> Iterator[list[tuple[int | None, int, bytes]]]:
    """Rows of segments (document, offset, ids) from (document, ids) pairs."""
    width = encoder.dtype.itemsize
    step, held, rests = length * width, 0, []

    def flush():
        for row in best_fit_decreasing([len(r[2]) // width for r in rests], length):
            yield [rests[k] for k in row]

    for doc, ids in docs:
        ids += encoder.end_bytes
        full = len(ids) // step * step
        for at in range(0, full, step):
            yield [(doc, at // width, ids[at:at + step])]
        if full < len(ids):
            rests.append((doc, full // width, ids[full:]))
            held += (len(ids) - full) // width
        if held >= block_tokens:
            yield from flush()
            rests, held = [], 0
    yield from flush()


def _record(row_id: int, row: list, encoder: Encoder, length: int) -> tuple:
    width = encoder.dtype.itemsize
    ends = np.cumsum([len(s[2]) // width for s in row]).tolist()
    ids = b"".join(s[2] for s in row)
    ids += encoder.end_bytes * (length - ends[-1])
    return (row_id, ends[-1], ids, [0, *ends], [0, *ends[:-1]], [s[0] for s in row], [s[1] for s in row])


_ENCODERS: dict = {}


def encoder_of(shared, key: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def pack(docs: DataFrame, ranks: dict[bytes, int], length: int = LENGTH, id_col: str = "doc_id",
         text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The packed rows of ``docs`` (see the module text for the columns)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary's size
    key = f"{spark.sparkContext.applicationId}-{len(ranks)}-{hash(frozenset(ranks.items()))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared, key)
        base = TaskContext.get().partitionId() << 40
        ids = ((d.as_py(), encoder.encode(t.as_py())) for b in batches for d, t in zip(b.column(0), b.column(1)))
        out = []
        for k, row in enumerate(packed_rows(ids, encoder, length, block_tokens)):
            out.append(_record(base + k, row, encoder, length))
            if len(out) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, ROW)


def write_packed(packed: DataFrame, path: str) -> None:
    """The rows as Parquet files, one id-matrix row each."""
    packed.write.mode("errorifexists").parquet(path)


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """The position of each token of a row within its segment; 0 in the fill."""
    out = np.zeros(length, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out
