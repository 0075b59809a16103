from cellgrad.llm.quality import quality_rules


def test_depleted_documents_go_and_common_lines_are_cut(spark):
    own = lambda k, n: " ".join(f"w{k}n{j}" for j in range(n))
    menu = " ".join(f"menu{j}" for j in range(25))
    rows = [(k, menu + "\n" + own(k, 60), "hub") for k in range(25)]
    rows += [(100, menu + "\n" + own(100, 5), "hub"), (101, menu, "other"), (102, own(102, 30), None)]
    got = {r["doc_id"]: r for r in quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] and got[k]["text"] == own(k, 60) and got[k]["n_common_words"] == 25 for k in range(25))
    assert not got[100]["kept"] and not got[100]["base_failed"]
    assert got[101]["kept"] and got[101]["text"] == menu  # common on another host only
    assert got[102]["kept"]


def test_documents_count_and_repeated_rows_do_not(spark):
    text = " ".join(f"t{j}" for j in range(40))
    other = " ".join(f"u{j}" for j in range(40))
    rows = [(k, text, "hub") for k in range(21)] + [(100, other, "hub")] * 30 + [(None, other + " x", "hub")] * 30
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.where("doc_id < 21 and n_common_lines = 1 and not kept").count() == 21
    assert got.where("kept and n_common_lines = 0").count() == 60
    got = quality_rules(spark.createDataFrame(rows[1:], "doc_id long, text string, source string"))
    assert got.where("kept and n_common_lines = 0").count() == 80


def test_odd_and_empty_rows(odd, empty):
    got = quality_rules(odd)
    assert got.count() == odd.count()
    assert got.columns[:5] == ["doc_id", "text", "source", "_doc", "n_lines"] and got.columns[-1] == "kept"
    assert got.where("text is null and kept").count() == 0
    assert quality_rules(empty).collect() == []


def test_a_repeated_line_goes_whatever_the_size_of_its_host(spark):
    menu = " ".join(f"menu{j}" for j in range(25))
    for times in (1, 100):
        docs = spark.range(30 * times).selectExpr(
            "id AS doc_id", "'hub' AS source",
            f"concat(if(id < 25, '{menu}\\n', ''), array_join(transform(sequence(1, 60), j -> concat('w', id, 'n', j)), ' ')) AS text")
        got = quality_rules(docs)
        assert got.where("doc_id < 25 and n_common_lines = 1 and n_common_words = 25").count() == 25
        assert got.where("doc_id >= 25 and n_common_lines = 0").count() == 30 * times - 25
