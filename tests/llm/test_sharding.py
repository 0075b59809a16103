import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from cellgrad.llm.sharding import assign_shards, place, write_shards


def checked(rows, source, shards):
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["text_crc32"]) for r in rows))) == sorted(
        map(repr, ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in source)))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards and sorted(v) == list(range(len(v))) for s, v in slots.items())


def test_small_table(docs001, rows001):
    rows = assign_shards(docs001, 6).collect()  # no group holds half a shard
    checked(rows, rows001, 6)
    loads = np.zeros((6, 3))
    for r in rows:
        loads[r["shard"]] += (r["size"], r["n_words"], 1)
    assert (loads.max(axis=0) <= loads.mean(axis=0) * (1.03, 1.06, 1.06)).all()
    where = defaultdict(set)
    for r in rows:
        where[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())  # equal texts stay together


def test_a_group_with_most_rows_is_split(spark):
    rows = [(k, "the same text again") for k in range(3000)] + [(9000 + k, "x" * (k % 90)) for k in range(2000)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    checked(got, rows, 8)
    loads = np.zeros(8)
    for r in got:
        loads[r["shard"]] += r["size"]
    assert loads.max() <= 1.03 * loads.mean()


def test_place_takes_the_highest_dot_product():
    items = np.array([[4.0, 1.0], [1.0, 4.0], [4.0, 1.0], [1.0, 4.0]])
    at = place(items, 2, np.array([5.0, 5.0]))
    assert at[0] != at[2] and at[1] != at[3]


def test_odd_and_empty_rows(odd, empty):
    checked(assign_shards(odd, 3).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 3)
    assert assign_shards(empty).collect() == []


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    write_shards(odd.drop("kept"), path, 3)
    got = spark.read.parquet(path)
    assert got.columns == [*odd.drop("kept").columns, "shard"]
    assert sorted(map(repr, got.drop("shard").collect())) == sorted(map(repr, odd.drop("kept").collect()))


def test_clashing_names_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", f"s{k}", k) for k in range(50)], "doc_id long, text string, shard string, _slot long")
    write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r["shard"] for r in back.collect()} == {0, 1, 2} and "_slot" in back.columns


def signed(data, seed=42):
    h = xxhash.xxh64_intdigest(data, seed)
    return h, h - (1 << 64) if h >> 63 else h


def plain_shards(rows, shards, grain=256, split=2, piece=64, weights=(1, Fraction(1, 10), Fraction(1, 10))):
    """Shard of each row by the stated rules, one row at a time in exact
    fractions: items are pieces of large groups and bundles of small ones, the
    largest share goes first, each to the highest dot product."""
    def size(text):
        return np.array([len((text or "").encode()) + 8, len((text or "").split()), 1], dtype=object)

    def group(text):
        null = (text is None).to_bytes(4, "little")
        first = signed((text or "").encode(), signed(null)[0])[1]
        second = signed((text or "").encode(), signed(null, signed(b"second")[0])[0])[1]
        return first, second

    capacity = [Fraction(int(t), shards) for t in sum(size(t) for _, t in rows)]
    groups = defaultdict(lambda: 0)
    for _, t in rows:
        groups[group(t)] = groups[group(t)] + size(t)
    items, of_row = defaultdict(lambda: 0), []
    for k, t in rows:
        g = group(t)
        share = max(n / c for n, c in zip(groups[g], capacity))
        if share * grain <= 1:
            item = (0, g[0] % (shards * grain), 0)
        else:
            pieces = -(-share * piece // 1) if share > Fraction(1, split) else 1
            item = (*g, 1 + signed(k.to_bytes(8, "little", signed=True))[1] % int(pieces))
        of_row.append(item)
        items[item] = items[item] + size(t)
    shares = {i: [n / c for n, c in zip(items[i], capacity)] for i in sorted(items)}
    residual = [[Fraction(1)] * 3 for _ in range(shards)]
    at = {}
    for i in sorted(shares, key=lambda i: (-max(x * w for x, w in zip(shares[i], weights)), -sum(shares[i]), i)):
        dots = [sum(r * w * x for r, w, x in zip(left, weights, shares[i])) for left in residual]
        at[i] = dots.index(max(dots))
        residual[at[i]] = [r - x for r, x in zip(residual[at[i]], shares[i])]
    return [at[i] for i in of_row]


@pytest.mark.parametrize("shards", [3, 8])
def test_shards_are_those_of_a_plain_placement(spark, shards):
    # Sizes with no common measure, so that no two dot products are equal;
    # one group over half a shard, some large ones, many small ones, nulls.
    rows = [(k, "one text that many hold " * 3) for k in range(0, 400, 2)]
    rows += [(1000 + k, "w " * (k * k % 89) + "x" * (k * 37 % 1013)) for k in range(300)]
    rows += [(2000 + k, f"large group {k % 3} " * (90 + 7 * (k % 3))) for k in range(9)] + [(3000, None), (3001, None)]
    got = {r["doc_id"]: r["shard"] for r in assign_shards(
        spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()}
    assert [got[k] for k, _ in rows] == plain_shards(rows, shards)
