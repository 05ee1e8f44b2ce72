"""Toxicity, quality and language: held-out accuracy and defined cases."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from contentfit.llm import language, rule_quality, toxicity
from contentfit.llm.labels import held_out, labelled_sample

INSULTS = ["moron", "idiot", "fool"]


@pytest.fixture(scope="module")
def corpus(spark, prose_of):
    rows, labels = [], []
    for i in range(900):
        toxic, good = int(i % 3 == 0), int(i % 4 != 0)
        text = prose_of(i, 40 + i % 50)
        if toxic:
            text += f" you {INSULTS[i % 9 // 3]}, "
        if not good:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text))
        labels.append((i, good, toxic))
    labels += [(5, 0, 0), (9999, 1, 1), (None, 1, 1), (7, None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def accuracy(scored, labels, column):
    r = scored.join(labels.dropna(), "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()
    return r[0]


def test_held_out_rows_are_never_sampled(spark, corpus):
    docs, labels = corpus
    sample = labelled_sample(docs, labels, "toxic", 200)
    assert sample.count() == 200 and sample.where(held_out(F.col("id"))).count() == 0


def test_toxicity_on_held_out_rows(corpus):
    scored = toxicity.toxicity(*corpus)
    assert accuracy(scored, corpus[1], "toxic") > 0.97
    assert scored.count() == corpus[0].count()


def test_weights_are_sparse(corpus):
    at, w, _ = toxicity.fit(*corpus)
    assert 0 < len(at) < 2_000 and np.all(w != 0)


def test_quality_on_held_out_rows(corpus):
    scored = rule_quality.quality(*corpus)
    assert accuracy(scored, corpus[1], "quality") > 0.99
    kept = rule_quality.drop_low_quality(*corpus)
    assert kept.columns == corpus[0].columns and kept.count() == scored.where("predicted = 1").count()


def test_rules_of_a_printed_forest():
    debug = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 3 <= 0.25)
      Predict: 0.0
     Else (feature 3 > 0.25)
      Predict: 1.0
    Else (feature 3 > 0.5)
     Predict: 1.0
"""
    assert rule_quality.tree_paths(debug) == {
        ((3, "<=", 0.5),), ((3, "<=", 0.25),), ((3, "<=", 0.5), (3, ">", 0.25)), ((3, ">", 0.5),)}


def test_statistics_by_hand():
    s = dict(zip(rule_quality.STATISTICS, rule_quality.statistics(np.frombuffer(b"Aa a b! a\nx|1\n\nx|1", dtype=np.uint8))))
    assert s["log_words"] == pytest.approx(np.log(7)) and s["lines_per_word"] == pytest.approx(3 / 6)
    assert s["upper_share"] == pytest.approx(1 / 12) and s["exclaim_share"] == pytest.approx(1 / 12)
    assert s["repeated_line_share"] == pytest.approx(1 / 3) and s["top_word_share"] == pytest.approx(2 / 6)


def test_odd_rows_and_missing_labels(odd_docs, no_docs, corpus):
    labels = corpus[1]
    n = odd_docs.count()
    for rows in (toxicity.toxicity(odd_docs, labels).collect(), rule_quality.quality(odd_docs, labels).collect()):
        assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert {r["score"] for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in rule_quality.quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in rule_quality.quality(odd_docs, labels.where("quality = 1")).collect()} == {1}
    assert toxicity.toxicity(no_docs, labels).count() == 0 and rule_quality.quality(no_docs, labels).count() == 0


GRAMS = {"aa": "abe ban cab dab ".split(), "bb": "lum nul mul lun ".split(), "cc": "fox zox xof oxo".split()}


def texts(n):
    rows = []
    for i in range(n):
        lang = sorted(GRAMS)[i % 3]
        rows.append((i, " ".join(GRAMS[lang][(i * 7 + j * j) % 4] for j in range(3 + i % 20)), lang))
    return rows


def test_language_on_held_out_rows(spark):
    docs = spark.createDataFrame(texts(300) + [(900, "123 !", "aa"), (901, None, "bb"), (902, "", None), (None, "abe ban", "aa"),
                                               (903, "abe fox lum", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(rows) == docs.count()
    held = [(i, lang) for i, _, lang in texts(300) if rows[i]["held_out"]]
    assert len(held) > 50 and sum(rows[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    assert all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert rows[None]["lang_pred"] == "aa" and rows[903]["score"] < 0.95


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 60])
def test_codewords_are_distinct_and_every_bit_splits(n):
    code = language.codewords(n)
    assert len({tuple(row) for row in code}) == n and np.all(np.abs(code.sum(axis=0)) < n)
    for i in range(n):
        assert language.decode(4 * code[i], code)[0] == i


def test_one_flipped_bit_is_corrected():
    code = language.codewords(4)
    for i in range(4):
        for b in range(code.shape[1]):
            margin = 3 * code[i].copy()
            margin[b] = -margin[b]
            assert language.decode(margin, code)[0] == i


def test_margins_ignore_block_cuts(monkeypatch):
    rng = np.random.default_rng(1)
    w = rng.normal(size=((1 << 10) + 1, 3))
    raw = np.frombuffer(b"some words of a text that is cut into blocks " * 40, dtype=np.uint8)
    whole = language.margins(raw, w, 10)
    monkeypatch.setattr(language, "_BLOCK", 100)
    assert np.allclose(language.margins(raw, w, 10), whole, atol=0.02)


def test_language_without_classes(spark, odd_docs, no_docs):
    assert {r["lang_pred"] for r in language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = language.identify(odd_docs.withColumn("lang", F.lit("en"))).collect()
    assert {r["lang_pred"] for r in one} == {"en", "und"}
    assert language.identify(no_docs).count() == 0
