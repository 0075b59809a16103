import random

import numpy as np
import pytest
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from cellgrad.llm import packing as P
from cellgrad.llm import token_counts as T
from cellgrad.llm.queries import BYTE_RANKS, UNIGRAM_VOCABULARY


def reference(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(list(vocabulary), unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=T.MARK, prepend_scheme="always", split=False)
    t.decoder = decoders.ByteFallback()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return T.read_vocabulary(UNIGRAM_VOCABULARY)


def test_counts_equal_the_tokenizer(spark, docs001, rows001, vocabulary):
    t = reference(vocabulary, True)
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs001, vocabulary).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows001}


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_unknowns_equal_the_tokenizer(fallback):
    rng = random.Random(3)
    for _ in range(60):
        entries = {"<unk>": 0.0}
        if fallback:
            entries |= {f"<0x{b:02X}>": -9.0 for b in range(256)}
        for _ in range(rng.randrange(1, 25)):
            entries["".join(rng.choice("ab▁é") for _ in range(rng.randrange(1, 5)))] = -float(rng.randrange(1, 4))
        vocab = list(entries.items())
        ref, own = reference(vocab, fallback), T.Counter(vocab)
        for _ in range(40):
            text = "".join(rng.choice("aabbé  c\n") for _ in range(rng.randrange(0, 14)))
            assert own.count(text)[0] == len(ref.encode(text, add_special_tokens=False).ids), (vocab, text)


def test_runs_of_spaces_equal_the_tokenizer(vocabulary):
    ref, own = reference(vocabulary, True), T.Counter(vocabulary)
    assert own.cut
    texts = [" " * 8 + "return the value", "a" + " " * 5 + "b", "  ", " ", "x  y   z    ", "\n    if a:\n        b = 1",
             "wordwithoutspaces" * 300, "▁▁ a ▁", "tab\t  two"]
    for text in texts:
        assert own.count(text)[0] == len(ref.encode(text, add_special_tokens=False).ids), text
    assert own.count(" " * 8 + "return the value")[0] == 8  # 15 when cut at every space


def test_odd_counts(odd, empty, vocabulary):
    got = T.token_counts(odd, vocabulary)
    assert got.columns == ["doc_id", "n_tokens", "score"] and got.count() == odd.count()
    assert {r["n_tokens"] for r in got.where("doc_id in (2) or doc_id = 1").collect()} == {0}
    assert T.token_counts(empty, vocabulary).collect() == []


@pytest.fixture(scope="module")
def ranks():
    return P.read_ranks(BYTE_RANKS)


def unpacked(rows, encoder, length):
    """Document -> its ids, put together from the segments."""
    parts = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], encoder.dtype)
        assert len(ids) == length and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= length
        assert r["reset_at"] == r["cu_seqlens"][:-1] and (ids[r["n_tokens"]:] == encoder.end).all()
        places = P.position_ids(r["cu_seqlens"], length)
        assert all(places[a] == 0 for a in r["reset_at"])
        for d, off, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts.setdefault(d, []).append((off, ids[a:b].tolist()))
    out = {}
    for d, segments in parts.items():
        whole = []
        for off, ids in sorted(segments):
            assert off == len(whole)
            whole += ids
        out[d] = whole
    return out


def test_packing_is_a_round_trip(docs001, rows001, ranks):
    encoder = P.Encoder(ranks)
    rows = P.pack(docs001, ranks, length=256).collect()
    assert len({r["row_id"] for r in rows}) == len(rows)
    assert unpacked(rows, encoder, 256) == {
        i: encoder.encoding.encode_ordinary(t or "") + [encoder.end] for i, t in rows001}
    used = sum(r["n_tokens"] for r in rows)
    assert used / (256 * len(rows)) > 0.97


def test_pieces_are_encoded_as_the_whole(ranks):
    encoder, rng = P.Encoder(ranks), random.Random(9)
    texts = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "\n\n a\t b  c\u00a0 d \u2003e", "x\x1c y", "don't 's  's"]
    texts += ["".join(rng.choice("ab1.,'s \n\té\u00a0") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), encoder.dtype).tolist() == encoder.encoding.encode_ordinary(t), repr(t)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.choice([1, 2, 7, 16, 100])
        sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(0, 60))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= s]
            best = min(fits) if fits else length
            if fits:
                rooms.remove(best)
            rooms.append(best - s)
        rows = P.best_fit_decreasing(sizes, length)
        assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[k] for k in r) for r in rows) == sorted(rooms)


def test_blocks_bound_what_is_held(ranks):
    encoder = P.Encoder(ranks)
    docs = [(k, encoder.encode("word " * (k % 7))) for k in range(100)]
    rows = list(P.packed_rows(iter(docs), encoder, 8, block_tokens=20))
    assert sum(len(s[2]) for r in rows for s in r) == sum(len(d[1]) + 2 for d in docs)


def test_odd_packing(odd, empty, ranks):
    rows = P.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), ranks, length=64).collect()
    encoder = P.Encoder(ranks)
    want = {r["doc_id"]: encoder.encoding.encode_ordinary(r["text"] or "") + [encoder.end]
            for r in odd.collect() if r["doc_id"] is not None}
    assert unpacked(rows, encoder, 64) == want
    assert sum(len(r["doc_ids"]) for r in P.pack(odd, ranks, length=1 << 20).collect()) == odd.count()
    assert P.pack(empty, ranks).collect() == []
