import random

import numpy as np
import pytest

from cellgrad.llm import decontaminate as D


def edits_within(part, doc):
    """Fewest edits of the whole part against any stretch of the document."""
    row = np.zeros(len(doc) + 1, int)
    step = np.arange(len(doc) + 1)
    doc = np.array([ord(c) for c in doc])
    for c in part:
        sub = np.append(row[0] + 1, row[:-1] + (doc != ord(c)))
        row = np.minimum.accumulate(np.minimum(sub, row + 1) - step) + step
    return row.min()


def squeezed(t):
    return "".join(map(chr, D.normalised(t)[0]))


def brute(text, items):
    out, doc = set(), squeezed(text)
    for i, t in items:
        s = squeezed(t)
        if not s:
            continue
        if len(s) < D.Q:
            out |= {i} if s in doc else set()
            continue
        w = min(len(s), max(D.MIN_WINDOW, -(-len(s) // 2)))
        e = min(int(D.RATE * w), w // D.Q - 1)
        if any(edits_within(s[a:a + w], doc) <= e for a in range(len(s) - w + 1)):
            out.add(i)
    return out


@pytest.fixture(scope="module")
def benchmark_rows(spark):
    from .conftest import SF001
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[k] = rng.choice("abcxyz")
        elif kind == 1:
            text.insert(k, rng.choice("abcxyz "))
        else:
            del text[k]
    return "".join(text)


def test_edited_and_cut_items_equal_brute_force(benchmark_rows, rows001):
    rng = random.Random(5)
    items = benchmark_rows[:12] + [(900, "abc"), (901, ""), (902, None), (903, "A b-c d. E f g h!"), (904, "é" * 30)]
    index = D.Benchmark(items)
    cases = ["", None, "abc", "xx a-b c yy", "abcdefgh", "é" * 40, "a" * 500]
    for k in range(40):
        item = items[k % 12][1]
        lo = rng.randrange(0, len(item) // 2)
        part = item[lo:] if k % 3 else item
        cases.append(rows001[k][1][:600] + " " + changed(rng, part, rng.randrange(0, 14)).upper() + " " + rows001[k + 40][1][:300])
    for text in cases:
        got = index.matches(text)
        assert {m[0] for m in got} == brute(text, items), text
        for item, edits, i0, i1, d0, d1 in got:
            whole = squeezed(dict(items)[item])
            assert edits_within(whole[i0:i1], squeezed(text[d0:d1])) == edits


def test_every_planted_item_is_found_and_nothing_else(spark, docs001, benchmark_rows):
    from .conftest import SF001
    got = D.contaminations(docs001, spark.read.parquet(f"{SF001}/benchmark.parquet")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    docs = {r["doc_id"]: squeezed(r["text"]) for r in docs001.collect()}
    whole = {(d, i) for d, t in docs.items() for i, b in benchmark_rows if squeezed(b) in t}
    assert whole and whole <= pairs
    assert all(brute(docs[d], [x for x in benchmark_rows if x[0] == i]) == {i} for d, i in pairs)


def test_blocks_and_slices_do_not_change_the_result(spark, docs001, monkeypatch):
    from .conftest import SF001
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = sorted(map(tuple, D.contaminations(docs001, bench).collect()))
    assert sorted(map(tuple, D.contaminations(docs001, bench, block_chars=2000).collect())) == want
    text = docs001.where("doc_id = 39").first()["text"] or ""
    index = D.Benchmark([(r["item_id"], r["text"]) for r in bench.collect()])
    before = index.matches(text)
    monkeypatch.setattr(D, "SLICE", 64)
    assert index.matches(text) == before


def test_odd_and_empty_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "Common footer"), (None, "École É line of text")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminations(odd, bench).collect()}
    assert got == {(i, 3) for i in (5, 6, 7, 11, None)} | {(7, None)}
    left = D.decontaminate(odd, bench)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in left.collect()) == sorted(
        (r["doc_id"] or -1, r["text"] or "") for r in odd.collect()
        if "common footer" not in (r["text"] or "").lower())
    assert D.contaminations(empty, bench).collect() == []
    assert D.contaminations(odd, bench.where("false")).collect() == []
    assert D.decontaminate(odd, bench.where("false")).count() == odd.count()


@pytest.mark.parametrize("size", [600, 4000])
def test_a_partial_passage_of_a_long_item_is_found(size):
    rng = random.Random(size)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=5)) for _ in range(n))
    item = words(size // 5)
    index = D.Benchmark([(7, item)])
    for lo in (0, 37, size * 6 // 5 - 300):
        passage = item[lo:lo + 300]  # 250 letters
        got = index.matches(f"{words(80)} {passage} {words(40)}")
        assert [m[0] for m in got] == [7] and got[0][3] - got[0][2] >= 200
        assert index.matches(f"{words(80)} {changed(rng, passage, 4)} {words(40)}")
        assert index.matches(f"{words(80)} {passage[:150]} {words(40)}") == []


def test_rows_go_by_their_own_text(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards box with liquor jugs in the evening"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "an entirely different text about gardens and rivers that shares nothing with any question at all"
    rows = [(None, "see: " + item, 1, "a", 0), (None, clean, 2, "b", 0), (7, item + " indeed", 3, "c", 0),
            (7, clean, 4, "d", 0), (8, None, 5, "e", 0), (9, clean, 6, "f", 0), (9, clean, 6, "f", 0), (None, None, 7, "g", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leak long, _h string, _c0 long")
    got = D.decontaminate(docs, bench)
    assert got.columns == docs.columns
    assert sorted(r["_leak"] for r in got.collect()) == [2, 4, 5, 6, 6, 7]
    assert D.decontaminate(docs.where("false"), bench).collect() == []
    assert D.decontaminate(docs, bench.where("false")).count() == 8
