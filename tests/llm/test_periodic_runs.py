import hashlib
import random
import zlib

import numpy as np

from cellgrad.llm import periodic_runs as P
from cellgrad.llm import queries

from .conftest import SF001


def plain_runs(words, least=12):
    """Every lag, every stretch of equal words."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w, found = np.array([number[x] for x in words], np.int64), {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], (w[:-q] == w[q:]).astype(np.int8), [0]])
        step = np.diff(same)
        for start, end in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if end - start + q >= max(least, 2 * q):
                found.setdefault((int(start), int(end - start + q)), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def fibonacci(n):
    a, b = "x", "xy"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_equal_all_lags():
    rnd = random.Random(7)
    for turn in range(400):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            n = rnd.choice([0, 5, 11, 12, 13, 30, 80, 200])
            w = [str(rnd.randrange(rnd.choice([1, 2, 3, 50]))) for _ in range(n)]
            for _ in range(rnd.randint(0, 3)):
                if n > 4:
                    i, p = rnd.randrange(n), rnd.randint(1, max(1, n // rnd.choice([3, 4, 8])))
                    for j in range(i + p, min(n, i + p * rnd.randint(2, 6) + rnd.randint(0, p))):
                        w[j] = w[j - p]
            docs.append(fibonacci(n) if turn % 20 == 0 else w)
        least = rnd.choice([12, 12, 7, 2])
        number = {}
        flat = np.array([number.setdefault(x, len(number)) for d in docs for x in d], np.int64)
        got = P.runs_of(flat, np.cumsum([len(d) for d in docs]), least)
        assert got == [plain_runs(d, least) for d in docs]


def test_very_periodic_texts_take_time_in_proportion():
    for words in (np.zeros(200_000, np.int64), np.tile([0, 1], 100_000), np.array([c == "x" for c in fibonacci(50_000)], np.int64)):
        got = P.runs_of(words, np.array([len(words)]))[0]
        assert got
    assert P.runs_of(np.zeros(200_000, np.int64), np.array([200_000])) == [[(0, 200_000, 1)]]


def test_query_equals_brute_force(spark, rows001):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF001).collect()}
    assert len(got) == len(rows001)
    planted = 0
    for doc, text in rows001:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs, r = plain_runs(words), got[doc]
        assert r["n_runs"] == len(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == top
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


def test_odd_and_empty_rows(odd, empty, spark):
    got = P.periodic_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == odd.count()
    by = {(r["doc_id"], r["n_words"]): r for r in got.collect()}
    assert by[(9, 24)]["collapsed"] == "a b" and by[(1, 0)]["collapsed"] == "" and by[(3, 0)]["runs"] == []
    assert [tuple(r) for r in by[(9, 24)]["runs"]] == [(0, 24, 2)]
    assert by[(None, 0)]["runs"] == []
    assert P.periodic_runs(empty).collect() == []
    clash = spark.createDataFrame([(1, "u v " * 9, "s")], "runs long, collapsed string, n_words string")
    row = P.periodic_runs(clash, "runs", "collapsed").toDF("a", "b", "c", "d").first()
    assert row["a"] == 1 and row["b"] == 18 and row["d"] == "u v"
