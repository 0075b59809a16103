import math
import random
from fractions import Fraction

import pytest

from cellgrad.llm.mixing import mix, mixed_documents, period_schedule, phases


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 997, "b": 1, "c": 2}, {"x": 1},
                                     {s: k + 1 for k, s in enumerate("abcdefghijkl")}])
def test_schedule_stays_within_one_block(weights):
    slots = period_schedule(weights)
    total = sum(weights.values())
    assert sorted(t for s in slots.values() for t in s) == list(range(total))
    for s, w in weights.items():
        served = 0
        for t in range(total):
            served += t in slots[s]
            assert abs(served - Fraction(w * (t + 1), total)) < 1
        for k, t in enumerate(slots[s]):
            assert k * total // w <= t < -(-(k + 1) * total // w)


def test_phases_use_every_block_once():
    blocks, weights = {"a": 7, "b": 40, "c": 3, None: 2, "zero": 4}, {"a": 2, "b": 1, "c": 1, None: 3}
    done = dict.fromkeys(blocks, 0)
    slot = 0
    for p in phases(blocks, weights):
        assert p["start"] == slot
        for s, (first, n, _) in p["runs"].items():
            assert first == done[s]
            done[s] += n
        slot += sum(n for _, n, _ in p["runs"].values())
    assert done == blocks


def slot_by_slot(blocks, weights):
    """The whole schedule by looking at every source in every slot: [(source, block)]."""
    done, out = dict.fromkeys(blocks, 0), []
    while any(done[s] < blocks[s] for s in blocks):
        w = {s: weights.get(s, 0) for s in blocks if done[s] < blocks[s] and weights.get(s, 0) > 0} \
            or {s: 1 for s in blocks if done[s] < blocks[s]}
        share = {s: Fraction(n, sum(w.values())) for s, n in w.items()}
        served, t, over = dict.fromkeys(w, 0), 0, False
        while not over:
            released = [s for s in w if math.floor(served[s] / share[s]) <= t]
            s = min(released, key=lambda s: (math.ceil((served[s] + 1) / share[s]), list(w).index(s)))
            out.append((s, done[s]))
            served[s] += 1
            done[s] += 1
            t += 1
            for x in w:
                assert abs(served[x] - share[x] * t) < 1
            over = done[s] == blocks[s]
    return out


def spread(plan):
    """The schedule that phases stand for: [(source, block)] by slot."""
    out = {}
    for p in plan:
        for s, (first, n, slots) in p["runs"].items():
            w = p["weights"][s]
            assert len(slots) == min(w, n)
            for k in range(n):
                slot = p["start"] + k // w * p["total"] + slots[k % w]
                assert slot not in out
                out[slot] = (s, first + k)
    assert sorted(out) == list(range(len(out)))
    return [out[t] for t in sorted(out)]


@pytest.mark.parametrize("blocks,weights", [
    ({"a": 7, "b": 40, "c": 3, None: 2, "zero": 4}, {"a": 2, "b": 1, "c": 1, None: 3}),
    ({"a": 3, "b": 3, "c": 3}, {"a": 1, "b": 1, "c": 1}),
    ({"a": 500, "b": 90, "c": 1, "d": 35}, {"a": 10, "b": 30, "c": 20, "d": 40}),
    ({"a": 8, "b": 16}, {"a": 8, "b": 16}),
    ({s: 5 + 3 * k for k, s in enumerate("abcdefghijkl")}, {s: 40 - 3 * k for k, s in enumerate("abcdefghijkl")}),
])
def test_phases_are_the_earliest_deadline_schedule(blocks, weights):
    assert spread(phases(blocks, weights)) == slot_by_slot(blocks, weights)


def test_phases_on_random_sizes():
    pick = random.Random(5)
    for _ in range(60):
        names = "abcdefgh"[:pick.randint(1, 8)]
        blocks = {s: pick.randint(0, 60) for s in names}
        weights = {s: pick.choice([0, 1, 2, 3, 7, 20, 50]) for s in names}
        assert spread(phases(blocks, weights)) == slot_by_slot(blocks, weights)


def test_slots_do_not_outgrow_the_blocks():
    # 300 sources of a few blocks each: a period would be thousands of slots.
    blocks = {f"h{k}": 1 + k % 4 for k in range(300)}
    plan = phases(blocks, {s: 10 + k for k, s in enumerate(blocks)})
    assert sum(len(r[2]) for p in plan for r in p["runs"].values()) <= sum(blocks.values())


def test_rows_follow_the_schedule_through_all_phases(spark):
    sizes = {"a": 50, "b": 9, None: 23, "zero": 6, "d": 1}
    rows = [(k, s) for s, n in sizes.items() for k in range(n)]
    weights = {"a": 3, "b": 4, None: 2, "d": 1}
    got = mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=2).collect()
    # Ties in the deadline: sources by name, none last.
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = slot_by_slot({s: -(-sizes[s] // 2) for s in order}, weights)
    assert {(r["slot"], r["source"], r["block"]) for r in got} == {(t, *sb) for t, sb in enumerate(want)}
    assert len(got) == len(rows)


def test_rows_follow_the_schedule(spark, docs001):
    weights = {f"src{k}": k + 1 for k in range(20)}
    got = mix(docs001, weights, block_rows=2).orderBy("position").collect()
    assert len(got) == docs001.count() and len({r["doc_id"] for r in got}) == len(got)
    slots = sorted({r["slot"] for r in got})
    assert slots == list(range(len(slots)))
    for s in ("src0", "src19"):
        own = [r["doc_id"] for r in got if r["source"] == s]
        assert own == sorted(own)  # a source is served in document order
    first = [r for r in got if r["phase"] == 0]
    end = max(r["slot"] for r in first) + 1
    for t in range(1, end + 1):
        for k in range(20):
            served = len({r["slot"] for r in first if r["source"] == f"src{k}" and r["slot"] < t})
            assert abs(served - Fraction((k + 1) * t, 210)) < 1


def test_documents_come_in_mixture_order(docs001):
    order = [r["doc_id"] for r in mix(docs001).orderBy("position").collect()]
    got = mixed_documents(docs001)
    assert got.columns == docs001.columns
    assert [r["doc_id"] for r in got.collect()] == order


def test_odd_and_empty_rows(odd, empty):
    assert mix(odd).count() == odd.count()
    got = mixed_documents(odd)
    assert got.columns == odd.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, odd.collect()))
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []
