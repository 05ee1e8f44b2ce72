"""Rewrite rules (R1-R11) on the fixture rows, default pack."""

import pytest
from pyspark.sql import functions as F

from contentfit.functions import rules as R

P = R.TURKISH_ADS
L = F.lit


@pytest.mark.parametrize("col, expected", [
    (lambda: R.title_case(L("google VE reklam için"), P), "Google ve Reklam için"),
    (lambda: R.title_case(L("kolay ya da zor"), P), "Kolay ya Da Zor"),
    (lambda: R.title_case(L("ilan"), P), "Ilan"),
    (lambda: R.finalize(L("Reklam ve,"), L("p"), P), "Reklam."),
    (lambda: R.finalize(L("x ile ve"), L("h1"), P), "x"),
    (lambda: R.finalize(L("a ya da"), L("p"), P), "a ya da."),
    (lambda: R.finalize(L("Nedir?"), L("p"), P), "Nedir?"),
    (lambda: R.finalize(L(""), L("li"), P), "."),
    (lambda: R.enforce_budget(L("a b c"), L("1 2 3 4 5 6"), L("div"), P), "1 2 3 4"),
    (lambda: R.enforce_budget(L("a b c"), L("1 2 3 4 5 6"), L("li"), P), "1 2 3 4"),
    (lambda: R.enforce_budget(L("a b c"), L("1 2 3 4 5 6"), L("h1"), P), "1 2 3 4 5 6"),
    (lambda: R.enforce_budget(L(" ".join("abcdefghij")), L(" ".join(map(str, range(20)))), L("p"), P),
     " ".join(map(str, range(11)))),
    (lambda: R.scrub_phrases(L("Bu ürün potansiyel müşteriler içindir"), P), "Bu ürün içindir"),
    (lambda: R.micro_edit(L("Basit ya da basit"), P), "Basit veya basit"),
    (lambda: R.micro_edit(L("Basit basit"), P), "Kolay basit"),
])
def test_rule_fixtures(one, col, expected):
    assert one(col()) == expected


@pytest.mark.parametrize("head, tails, expected", [
    ("x", " ve VEYA Ya" * 50_000, "x."), ("", "ve veya ki" + " ve" * 50_000, "."),
    ("x", " ve" * 50_000 + " y", "x" + " ve" * 50_000 + " y."), ("xve", " İLE veyaki ve", "xve İLE veyaki."),
    ("x ya da", "", "x ya da."), ("x", " and" * 3, "x and and and."),
])
def test_long_runs_of_conjunctions(one, head, tails, expected):
    assert one(R.finalize(L(head + tails), L("p"), P)) == expected
    if len(tails) < 1000:  # what the greedy pattern gives
        t = R.normalize_ws(L(head + tails))
        assert one(R._pop_tails(t, P)) == one(F.regexp_replace(t, R._tails_re(P), ""))


def test_short_answer_of_a_long_run(one):
    assert one(R.short_answer(L("x" + " ve" * 50_000), L("p"), P)) == "X."


@pytest.mark.parametrize("word, guide", [("rehberlik", True), ("kılavuzluk", False), ("altkılavuz", True)])
def test_guide_pattern(one, word, guide):
    assert one(L(word).rlike(P.guide_re)) is guide


# Committed improvement rows: each new text must be one of the two candidates.
@pytest.mark.parametrize("section, query, old, cand1, cand2", [
    ("h2", "google reklam verme", "Google Ads Nedir?", "Google Reklam Verme Nasıl Yapılır?",
     "Google reklam verme adımları nelerdir?"),
    ("h2", "google reklam vermek", "Google Ads Nedir?", "Google Reklam Verme Nasıl Yapılır?",
     "Google reklam verme adımları nelerdir?"),
    ("div", "google reklam verme", "Google Ads Nedir?", "Google Ads ile reklam", "Google reklam verme adımları"),
    ("li", "web site reklam", "Google Reklamları", "Google Reklamları özetlenir.", "Web Site Reklam."),
    ("li", "ads reklam vermek", "Ads Reklam Politikası", "Google reklam verme anlatılır.",
     "Google reklam verme adımları"),
    ("li", "ads reklam ver", "Ads Reklam Politikası", "Ads Reklam Politikası özetlenir.", "Ads Reklam Ver."),
    ("li", "google reklam vermek", "Google Reklamları", "Google reklam verme", "Google reklam verme"),
])
def test_candidates_of_committed_rows(one, section, query, old, cand1, cand2):
    tag, q, cur = L(section), L(query), L(old)
    det = R.enforce_budget(cur, R.finalize(R.rule_candidate(cur, q, tag, P), tag, P), tag, P)
    qans = R.enforce_budget(cur, R.short_answer(q, tag, P), tag, P)
    assert one(det) == cand1
    assert one(qans) == cand2


def test_budget_never_lengthens(spark):
    texts = [("a b c d e f g h i j k l", "p"), ("x y", "li"), ("one", "div")]
    df = spark.createDataFrame(texts, "t string, tag string")
    cand = F.concat_ws(" ", F.col("t"), F.col("t"), F.col("t"))
    out = df.select(F.size(F.split(cand, " ")).alias("n0"),
                    F.size(F.split(R.enforce_budget(F.col("t"), cand, F.col("tag"), P), " ")).alias("n1"))
    assert all(r.n1 <= r.n0 for r in out.collect())
