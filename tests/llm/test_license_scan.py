import re

from cellgrad.llm import license_scan as L


def brute(rows, templates):
    def shingles(t):
        w = re.sub("[^A-Za-z0-9]+", " ", t or "").strip().lower().split()
        return w, [" ".join(w[k:k + 5]) for k in range(len(w) - 4)] or ([" ".join(w)] if w else [])
    out = set()
    for tid, _, t in templates:
        own = set(shingles(t)[1])
        if not own:
            continue
        span = -(-len(own) * 5 // 4)
        for i, text in rows:
            w, sh = shingles(text)
            found = [(len(own & set(sh[p:p + span])), -p) for p, s in enumerate(sh) if s in own]
            if found and max(found)[0] >= 0.8 * len(own):
                n, p = max(found)
                last = max(q for q in range(-p, min(-p + span, len(sh))) if sh[q] in own)
                out.add((i, tid, n, -p, min(last + 5, len(w))))
    return out


def test_edited_notices_equal_brute_force(spark, rows001):
    rows = list(rows001[:40])
    for k, (tid, _, t) in enumerate(L.TEMPLATES):
        w = t.split()
        body = " ".join(f"f{j}" for j in range(17 + k))
        for j, cut in enumerate((w, w[1:], w[:-2], w[:len(w) // 2] + ["changed"] + w[len(w) // 2 + 1:],
                                 w[:len(w) // 3], [x.upper() for x in w])):
            rows.append((1000 + 10 * k + j, f"{body}\n{'  '.join(cut)}\n{body}"))
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["template_id"], r["n_found"], r["first_word"], r["last_word"]) for r in got} \
        == brute(rows, L.TEMPLATES)


def test_blocks_do_not_change_the_result(spark, docs001, monkeypatch):
    want = sorted(map(tuple, L.license_scan(docs001).collect()))
    monkeypatch.setattr(L, "BLOCK_VALUES", 300)
    assert len(L.blocks(L.template_table(L.default_templates(spark)), 300)) > 1
    got = None
    base = L.banded(L.with_shingles(docs001.selectExpr("doc_id", "text _text"), L.F.col("_text")), L.WINDOW // 2)
    for block in L.blocks(L.template_table(L.default_templates(spark)), 300):
        found = L._scan(base, block, L.MIN_CONTAINED)
        got = found if got is None else got.unionByName(found)
    assert sorted(map(tuple, got.collect())) == want


def test_odd_and_empty_rows(spark, odd, empty):
    tpl = spark.createDataFrame([("a", "A", "common footer line here"), ("b", None, None), (None, "C", "!!"),
                                 ("d", "D", "One")], "template_id string, license string, text string")
    got = {(r["doc_id"], r["template_id"]) for r in L.license_scan(odd, tpl).collect()}
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == {(i, t) for i, t, *_ in brute(rows, [(r[0], r[1], r[2]) for r in tpl.collect()])}
    assert (4, "d") in got
    assert L.license_scan(empty, tpl).collect() == []
    assert L.license_scan(odd, tpl.where("false")).collect() == []


def test_notices_at_any_end_equal_brute_force(spark):
    rows = []
    for k, (_, _, t) in enumerate(L.TEMPLATES):
        w = re.sub("[^A-Za-z0-9]+", " ", t).split()
        for j in range(12):  # every start offset, with nothing behind the notice
            body = " ".join(f"f{j}x{i}" for i in range(j))
            for c, cut in enumerate((w, w[1:], w[:-1], w[:8] + w[4:])):  # the last: a stutter, as far as it matches
                rows.append((1000 * k + 10 * j + c, f"{body} {' '.join(cut)}"))
    gpl = L.TEMPLATES[2][2].split()
    rows.append((90000, " ".join(gpl[:11])))
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["template_id"], r["n_found"], r["first_word"], r["last_word"]) for r in got} \
        == brute(rows, L.TEMPLATES)
    assert (90000, "gpl-3.0-line") in {(r["doc_id"], r["template_id"]) for r in got}


def test_templates_that_match_in_short_runs_are_probed_by_single_shingles(spark):
    w = [f"w{k}" for k in range(13)]  # 9 shingles, matched by two runs of 4
    tpl = spark.createDataFrame([("t", "T", " ".join(w))], "template_id string, license string, text string")
    assert not L.windowed(L.template_table(tpl)[0], L.MIN_CONTAINED)
    rows = [(k, " ".join([f"f{k}"] * k + w[:8] + w[4:12])) for k in range(8)]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), tpl).collect()
    assert {(r["doc_id"], r["template_id"], r["n_found"], r["first_word"], r["last_word"]) for r in got} \
        == brute(rows, [("t", "T", " ".join(w))]) and len(got) == 8
