from collections import defaultdict

import pytest

from cellgrad.llm.line_dedup import IN_ORDER, LineRuns, dedup_lines, line_table, merged
from cellgrad.session import settings

WS = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, least=10):
    rank = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                first[key(x)] = min(first.get(key(x), rank(i)), rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] >= rank(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("batches", [1, 3])
def test_odd_rows(odd, batches):
    got = dedup_lines(odd, batches=batches)
    assert got.columns == ["doc_id", "text", "source", "_doc", "kept", "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_small_table_with_every_fanout(docs001, rows001):
    for fanout, batches in ((2, 5), (3, 4)):
        got = dedup_lines(docs001, batches=batches, fanout=fanout)
        rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
        assert sorted(map(repr, rows)) == brute(rows001)


def test_runs_are_levelled_sorted_and_disjoint(spark, docs001):
    store = LineRuns(spark, fanout=2)
    for lo in range(0, 200, 40):
        store.add(line_table(docs001.where(f"doc_id >= {lo} and doc_id < {lo + 40}")))
    assert [len(level) for level in store.levels] == [1, 0, 1]  # five batches, in twos
    keys = [tuple(r) for r in store.frame().select("_h1", "_h2").collect()]
    assert len(keys) == len(set(keys))
    for run in store.runs():
        by_file = defaultdict(list)
        for r in run.rows.selectExpr("input_file_name() f", "_h1", "_h2").collect():
            by_file[r["f"]].append((r["_h1"], r["_h2"]))
        assert all(v == sorted(v) for v in by_file.values())
        assert len(by_file) <= store.buckets  # a file per bucket
        assert sorted(map(repr, run.sorted.collect())) == sorted(map(repr, run.rows.collect()))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [4, 8])
def test_the_runs_are_neither_shuffled_nor_sorted_again(spark, docs001, buckets):
    store = LineRuns(spark, fanout=9, buckets=buckets)
    for lo in (0, 40, 80):
        store.add(line_table(docs001.where(f"doc_id >= {lo} and doc_id < {lo + 40}")))
    a, b, c = store.runs()
    conf = {**IN_ORDER, "spark.sql.adaptive.enabled": "false"}
    with settings(spark, conf):
        plan = physical(merged(a.sorted, b.sorted))
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        plan = physical(store.unseen(line_table(docs001.where("doc_id >= 120"))))
    assert plan.count("SortMergeJoin") == 3 and plan.count("Sort [") == 1
    # The new batch's keys alone, once more where its partitions are not the buckets.
    assert plan.count("Exchange hash") <= 2 and plan.count("Bucketed: true") == 3


def test_empty(empty):
    assert dedup_lines(empty).collect() == []
