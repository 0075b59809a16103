import zlib

import pytest

from cellgrad.llm import toxicity as T


def test_words_and_their_disguises():
    r = T.Reader({"idiot": 4.0, "vequ*": 3.0})
    at = dict(zip(T.FEATURES, range(len(T.FEATURES))))
    f = lambda text: r.features(text.encode())
    plain = f("what an Idiot, you see")
    assert plain[at["hit_density"]] == 0.2 and plain[at["top_weight"]] == 4.0
    assert plain[at["second_person_near"]] == 1.0 and plain[at["disguised_density"]] == 0
    assert f("idiot " + "word " * 9 + "you")[at["second_person_near"]] == 0
    for hidden in ("1d1ot", "i.d.i.o.t", "id*iot", "idiooot", "i d i o t here"):
        got = f(hidden + " and so on")
        assert got[at["top_weight"]] == 4.0 and got[at["disguised_density"]] > 0, hidden
    assert f("vequxyz a")[at["top_weight"]] == 3.0 and f("vequ a")[at["top_weight"]] == 0
    assert f("DON'T shout NOW!!")[at["exclamations"]] == 2 / 3
    assert r.features(None) == r.features(b"") == r.features(b" \n") == [0.0] * len(T.FEATURES)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    own = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(p and y for _, p, y in own)
    assert hit >= 0.85 * sum(y for *_, y in own) and hit >= 0.95 * sum(p for _, p, _ in own)
    assert sum((s - y) ** 2 for s, _, y in own) / len(own) < 0.02


@pytest.fixture(scope="module")
def made(spark):
    """Clean and abusive texts; labels by id, some of them null or repeated."""
    texts = [(k, f"w{k % 50} calm n{k} of the day" if k % 3 else f"w{k % 50} scum n{k} of the day") for k in range(400)]
    texts += [(1000, None), (1001, ""), (None, "scum again"), (7, "w7 calm n7 of the day"), (1002, "scum " * 40000)]
    docs = spark.createDataFrame([(i, t, 1.0, "p") for i, t in texts], "doc_id long, text string, score double, probability string")
    marks = [(k, int(k % 3 == 0)) for k in range(400)] + [(3, None), (None, 1), (5000, 1), (6, 0), (6, 1)]
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_odd_rows(made):
    docs, labels = made
    rows = T.toxicity(docs, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    got = rows.collect()
    assert len(got) == 405
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[7]) == 2 and by[7][0] == by[7][1]
    assert by[None][0]["predicted"] == 1 and by[None][0]["held_out"] is False
    assert by[1002][0]["predicted"] == 1 and by[1000][0]["predicted"] == by[1001][0]["predicted"] == 0
    assert by[1000][0]["score"] == by[1001][0]["score"]
    assert all(by[k][0]["predicted"] == int(k % 3 == 0) for k in range(400))


def test_held_out_labels_do_not_matter(spark, made):
    docs, labels = made
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    a = sorted((r["doc_id"] or -1, r["score"]) for r in T.toxicity(docs, labels).collect())
    b = sorted((r["doc_id"] or -1, r["score"]) for r in T.toxicity(docs, flipped).collect())
    assert a == b


def test_too_few_labels_and_empty(made):
    docs, labels = made
    got = T.toxicity(docs, labels.where("doc_id = 1 or doc_id = 3")).collect()
    assert len(got) == 405 and len({r["score"] for r in got}) == 1
    assert {r["score"] for r in T.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert T.toxicity(docs.where("false"), labels).collect() == []
