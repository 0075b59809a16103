"""The pipeline's stages, against plain Python."""

import re
from collections import Counter

import corpus_pipeline as C
from cellgrad.llm import decontaminate as D
from cellgrad.llm import mixing as M
from cellgrad.llm import packing as P
from cellgrad.llm import quality as Q
from cellgrad.llm.queries import BYTE_RANKS

from .conftest import SF001
from .test_simhash import plain_components, plain_fingerprint
from .test_tokens import unpacked

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(rows):
    hosts = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    for i, t, s in rows:
        held = hosts.setdefault(s, {})
        for x in t.split("\n"):
            if WORD.search(x):
                held.setdefault(key(x), set()).add(i)
    out = {}
    for i, t, s in rows:
        held = hosts[s]
        words = WORD.findall(t)
        wins = {}
        for k in range(len(words) - 7):
            wins.setdefault(tuple(words[k:k + 8]), []).append(k)
        rep = {p for ks in wins.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
        lines = t.split("\n")
        common = [k for k, x in enumerate(lines) if WORD.search(x) and len(held[key(x)]) > Q.MIN_DOCS]
        cut = sum(len(WORD.findall(lines[k])) for k in common)
        left = len(words) - cut
        if len(words) < 20 or 100 * len(rep) > 30 * len(words):
            continue
        if 100 * left < Q.MIN_LEFT_PCT * len(words):
            continue
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in common) if common else t
    return out


def test_stages_equal_plain_python(spark, docs001, tmp_path):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs001.collect()]
    docs, want = docs001, None
    for k, (_, stage) in enumerate(C.STAGES):
        got = stage(spark, docs, SF001)
        if k < 4:
            assert got.columns == docs001.columns
        path = str(tmp_path / str(k))
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        if k == 0:
            want = quality(rows)
        elif k == 1:
            groups = plain_components([(i, plain_fingerprint(t)) for i, t in want.items()])
            want = {i: t for i, t in want.items() if i in {c for _, _, c in groups}}
        elif k == 2:
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
            index = D.Benchmark(bench)
            want = {i: t for i, t in want.items() if not index.matches(t)}
        if k < 4:
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"])
    encoder = P.Encoder(P.read_ranks(BYTE_RANKS))
    assert unpacked(docs.collect(), encoder, P.LENGTH) == {
        i: encoder.encoding.encode_ordinary(t) + [encoder.end] for i, t in want.items()}


def test_run_returns_the_packed_rows(spark):
    got = C.run(spark, SF001)
    assert got.columns == [f.name for f in P.SCHEMA] and got.count() > 0


def test_run_keeps_what_its_rows_read(spark, monkeypatch):
    written, dropped = [], []
    write, drop = C.materialize, C.drop_tables

    def materialize(df, label):
        written.append(label)
        return write(df, label)

    monkeypatch.setattr(C, "materialize", materialize)
    monkeypatch.setattr(C, "drop_tables", lambda spark, paths: (dropped.append(paths), drop(spark, paths)))
    rows = C.run(spark, SF001)
    assert rows.count() == rows.count() > 0
    gone = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for paths in dropped for p in paths]
    assert [n for n in gone if n.startswith("stage-")] == written[:-1]


def test_packed_rows_follow_the_mixture(spark, docs001, tmp_path, monkeypatch):
    # Unequal files, which a scan takes in the order of their sizes.
    monkeypatch.setattr(C, "PACK_BYTES", 60_000)
    path = str(tmp_path / "mixed")
    C.mixing_stage(spark, docs001, SF001).write.parquet(path)
    want = M.mix(docs001).orderBy("position").collect()
    place = {r["doc_id"]: k for k, r in enumerate(want)}
    task = {}
    for r in C.packing_stage(spark, spark.read.parquet(path), SF001).collect():
        for d in r["doc_ids"]:
            task.setdefault(r["row_id"] >> 40, set()).add(d)
    assert len(task) > 3
    done = set()
    sources = {r["doc_id"]: r["source"] for r in want}
    counts = Counter(sources.values())
    weights = M.natural_weights(counts)
    plan = M.phases({s: -(-n // M.BLOCK_ROWS) for s, n in counts.items()}, weights)[0]
    for t in sorted(task):
        done |= task[t]
        assert {place[d] for d in done} == set(range(len(done)))  # a prefix of the mixture
        if {r["phase"] for r in want[:len(done)]} == {0}:
            slots = want[len(done) - 1]["slot"] + 1
            for s in plan["runs"]:
                served = sum(sources[d] == s for d in done) / M.BLOCK_ROWS
                assert abs(served - slots * weights[s] / plan["total"]) < 2  # the last slot may be half done
