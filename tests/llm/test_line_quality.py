from contentfit.llm.line_quality import quality_rules


def test_counts_by_hand(spark):
    text = "a b c d e f a b c d e x\n#one <two>|\n#one <two>|\n\n\nÀé z\tz"
    r = quality_rules(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).first()
    words = text.split()
    assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
    assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
    assert r["n_dup_lines"] == 1 and r["n_repeat_words"] == 10


def test_overlapping_windows_cover_each_word_once(spark):
    rows = [(1, "a " * 12, "h"), (2, "a b c d e a b c d e", "h"), (3, "a b c d", "h")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in
           quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 12, 2: 10, 3: 0}


def test_frequent_lines_deplete(spark, prose_of):
    line = "this line is on very many pages of one host indeed so it goes"
    rows = [(i, f"{line}\n{prose_of(i, 3)}", "h") for i in range(25)]
    rows += [(100 + i, f"{line.upper()}\n{prose_of(100 + i, 60)}", "h") for i in range(3)]
    rows += [(200, f"{line}\n{prose_of(200, 3)}", "elsewhere")]
    rows += [(300 + i, prose_of(7, 50), "copies") for i in range(40)]
    rows += [(400 + i, prose_of(8, 50), "few") for i in range(20)] + [(500, prose_of(9, 50), "rows")] * 30
    rows += [(None, prose_of(10, 50), "none")] * 30
    got = {r["doc_id"]: r for r in quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(25))
    assert all(got[100 + i]["kept"] and got[100 + i]["n_removed_words"] == len(line.split()) for i in range(3))
    assert got[200]["kept"]
    # Copies are documents: 40 of them lose the line, 20 are at the limit, 30 rows of one id are one document.
    assert all(got[300 + i]["n_removed_words"] == 50 and not got[300 + i]["kept"] for i in range(40))
    assert all(got[400 + i]["kept"] for i in range(20)) and got[500]["kept"] and got[None]["kept"]


def test_odd_rows(odd_docs, no_docs):
    rows = quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["n_words"] == 0 and by_id[4]["base_failed"] and not by_id[4]["kept"]
    assert by_id[8]["n_repeat_words"] == 5000 and by_id[7]["kept"]
    assert quality_rules(no_docs).count() == 0
