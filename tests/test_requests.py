"""The request ledger, in round trips with a made-up model."""

import json

from contentfit.functions import prompts as pr
from contentfit.operators import improve as im
from contentfit.operators import requests as rq

ROWS = [("a", "red shoes", "old words", "p", 0.0), ("b", "red shoes", "old words", "p", 0.0),  # one request
        ("c", "blue hats", "hats", "h1", 0.75), ("d", "never better", "text", "p", 0.0), ("e", "junk", "text", "p", 0.0)]


def model(prompt, attempt, nth):
    """Shoes: JSON on the third try, better on the second attempt; hats: at once; junk: never JSON."""
    if '"red shoes"' in prompt:
        return json.dumps({"text": "red shoes" if attempt == 2 else "no gain"}) if nth == 3 or attempt == 2 else "sorry"
    if '"blue hats"' in prompt:
        return 'Sure: {"text": "blue hats"} .'
    if '"never better"' in prompt:
        return json.dumps({"text": "text"})
    return "{not json"


def rows_of(spark):
    rows = spark.createDataFrame(ROWS, "row_key string, intent string, old_text string, section string, old_score double")
    return rq.with_request(rows, pr.render('"{i}" {t}', {"i": "intent", "t": "old_text"}))


def test_round_trips_ask_each_request_once(spark, tmp_path):
    rows, path, said, runs = rows_of(spark), str(tmp_path / "ledger"), [], []
    while True:
        answers = spark.createDataFrame(said, rq.ANSWER)
        new = rq.make_requests(rows, answers, path).collect()
        if not new:
            break
        runs.append(sorted((r["prompt"].split('"')[1], r["attempt"], r["try"]) for r in new))
        assert rq.make_requests(rows, answers, path).collect() == []  # asked already, not yet answered
        said += [(r["digest"], r["attempt"], r["try"], model(r["prompt"], r["attempt"], r["try"])) for r in new]
    asked = [x for run in runs for x in run]
    assert len(asked) == len(set(asked)) == rq.read_ledger(spark, path).count()
    assert runs[0] == [(i, 1, 1) for i in ("blue hats", "junk", "never better", "red shoes")]
    assert [x for x in asked if x[0] == "red shoes"] == [("red shoes", 1, 1), ("red shoes", 1, 2), ("red shoes", 1, 3), ("red shoes", 2, 1)]
    assert sum(x[0] == "blue hats" for x in asked) == 1 and sum(x[0] == "never better" for x in asked) == 3
    assert sum(x[0] == "junk" for x in asked) == 15
    raw = rq.fan_out(rows, spark.createDataFrame(said, rq.ANSWER))
    out = {r["row_key"]: (r["new_text"], r["attempt"]) for r in
           im.first_improving_attempt(rows.drop("prompt", "digest"), im.attempt_texts(raw, rows)).collect()}
    assert out == {"a": ("red shoes", 2), "b": ("red shoes", 2), "c": ("blue hats", 1), "d": ("text", 0), "e": ("text", 0)}
    # A second job on the same rows asks nothing; a new row asks for itself alone.
    more = rows.unionByName(rq.with_request(spark.createDataFrame([("f", "green", "x", "p", 0.0)], rows.select(
        "row_key", "intent", "old_text", "section", "old_score").schema), pr.render('"{i}" {t}', {"i": "intent", "t": "old_text"})))
    assert [r["attempt"] for r in rq.make_requests(more, spark.createDataFrame(said, rq.ANSWER), path).collect()] == [1]


def test_odd_answers(spark, tmp_path):
    rows = rows_of(spark)
    digest = rows.where("row_key = 'c'").first()["digest"]
    said = [(digest, 1, 1, "nothing"), (digest, 1, 1, '{"text": "a"}'), ("unasked", 1, 1, "x"), (digest, 9, 1, '{"text": "blue hats"}')]
    new = rq.make_requests(rows, spark.createDataFrame(said, rq.ANSWER), str(tmp_path / "l")).where(f"digest = '{digest}'").collect()
    assert [(r["attempt"], r["try"]) for r in new] == [(1, 2)]  # the smallest answer is no JSON
    assert rq.make_requests(rows.limit(0), spark.createDataFrame([], rq.ANSWER), str(tmp_path / "m")).count() == 0
