import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellgrad.llm import simhash as S
from cellgrad.llm.components import components


def plain_fingerprint(text, n=3):
    ws, words, cur = set(" \t\n\x0b\f\r"), [], ""
    for c in text or "":
        if c in ws:
            words += [cur] if cur else []
            cur = ""
        else:
            cur += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words += [cur] if cur else []
    if not words:
        return 0
    shingles = [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    """rows: (doc_id, fingerprint); smallest id within links, per row."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1:]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {(i, f"{f:016x}", least.get(root(f))) for i, f in rows}


def test_groups_equal_brute_force(docs001, rows001):
    got = [tuple(r) for r in S.simhash_groups(docs001).collect()]
    assert len(got) == len(rows001)
    assert set(got) == plain_components([(i, plain_fingerprint(t)) for i, t in rows001])


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [tuple(r) for r in S.simhash_groups(odd).collect()]
    assert len(got) == len(rows)
    assert set(got) == plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert S.simhash_groups(empty).collect() == []


@pytest.mark.parametrize("n", [40, 700])
def test_links_of_crowded_fingerprints(spark, n):
    """Random fingerprints, and clusters that vary in few bits."""
    rng = random.Random(n)
    fps = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(3):
        centre, bits = rng.getrandbits(64), rng.sample(range(64), 12)
        for _ in range(n // 2):
            f = centre
            for b in rng.sample(bits, rng.randrange(0, 6)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(r) for r in S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = set()
    for k, a in enumerate(fps):
        for j in range(k + 1, len(fps)):
            if (a ^ fps[j]).bit_count() <= 2:
                want.add((min(signed[k], signed[j]), max(signed[k], signed[j])))
    assert got == want


def test_thresholds_have_the_right_sum_and_least_cost():
    rng = np.random.default_rng(1)
    for parts in (2, 3, 4):
        cost = rng.integers(1, 100, (parts, 4, 50)).astype(float)
        cost[:, 0] = 0
        levels = S.thresholds(cost, 2)
        assert (levels.sum(axis=1) == 2 - parts + 1).all()
        every = [c for c in np.ndindex(*[4] * parts) if sum(c) - parts == 2 - parts + 1]
        for row in range(50):
            own = sum(cost[i, levels[row, i] + 1, row] for i in range(parts))
            assert own == min(sum(cost[i, c[i], row] for i in range(parts)) for c in every)


def test_parts_cover_every_bit_once():
    counts = np.zeros((65, 64))
    for parts in (2, 3, 4):
        got = S.bit_parts(counts, parts)
        assert sorted(b for g in got for b in g) == list(range(64))


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(300, 299)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got[160] == 100 and got[259] == 5 and got[300] == 299 and len(got) == 61 + 61 + 2


def test_near_dedup_keeps_one_of_each_group(spark, docs001, rows001, odd):
    groups = plain_components([(i, plain_fingerprint(t)) for i, t in rows001])
    got = S.near_dedup(docs001)
    assert got.columns == docs001.columns
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {c for _, _, c in groups}
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    kept = [tuple(r) for r in S.near_dedup(odd.select("doc_id", "text")).collect()]
    groups = {plain_fingerprint(t): c for i, t in rows for j, f, c in plain_components(
        [(k, plain_fingerprint(x)) for k, x in rows]) if f == f"{plain_fingerprint(t):016x}"}
    assert sorted((i for i, _ in kept), key=str) == sorted(set(groups.values()), key=str) and len(set(kept)) == len(kept)
    assert S.near_dedup(docs001.where(F.lit(False))).collect() == []


def test_near_dedup_keeps_the_same_row_under_any_partitioning(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, f"src{k}", k, {"a": k}) for k in range(6)] + [(None, "other words entirely here", "x", 9, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _th long, _kid map<string,long>")
    kept = {tuple((r["doc_id"], r["_id"]) for r in S.near_dedup(docs.repartition(n)).orderBy("_id").collect()) for n in (1, 3, 8)}
    assert len(kept) == 1 and len(next(iter(kept))) == 2
    assert S.near_dedup(docs).columns == docs.columns
