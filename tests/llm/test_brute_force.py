"""Operators that SQL can't express, against plain Python row by row."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from contentfit.llm import chunk_dedup, language, rule_quality, toxicity
from contentfit.llm.common import word_hashes
from contentfit.llm.labels import labelled_sample

MASK = (1 << 64) - 1


def raw(text):
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


def word_hash(word):
    b = raw(word)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])


def mix(h):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> 33
        h = h * m & MASK
    return h ^ h >> 33


@pytest.fixture(scope="module")
def few(spark, prose_of):
    docs, labels = [], []
    for i in range(160):
        text = prose_of(i, 15 + i % 20) + (f" you moron{i % 2}" if i % 3 == 0 else "") + (" ###" * 9 if i % 5 == 0 else "")
        docs.append((i, text))
        labels.append((i, int(i % 5 != 0), int(i % 3 == 0)))
    docs += [(200, ""), (201, None), (None, "you moron0")]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs)


def test_toxicity_is_ftrl_proximal_by_the_book(spark, few):
    docs, labels, rows = few
    bits = 12

    def grams(text):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
        h = [word_hash(w) for w in words]
        pair = 0x9E3779B97F4A7C15
        out = h + [mix((a * pair + b) & MASK) for a, b in zip(h, h[1:])] + [mix((a * pair + b + 1) & MASK) for a, b in zip(h, h[2:])]
        return {x >> 64 - bits for x in out}

    sample = sorted(labelled_sample(docs, labels, "toxic", 1000).collect(), key=lambda r: r["order"])
    totals, used = defaultdict(float), 0
    for shard in range(toxicity.SHARDS):
        mine = [r for r in sample if r["order"] % toxicity.SHARDS == shard]
        z, n = defaultdict(float), defaultdict(float)

        def weight(c):
            l1 = 0.0 if c == "b" else toxicity.L1
            if abs(z[c]) <= l1:
                return 0.0
            return (math.copysign(l1, z[c]) - z[c]) / ((toxicity.BETA + math.sqrt(n[c])) / toxicity.ALPHA + toxicity.L2)
        for _ in range(toxicity.EPOCHS):
            for r in mine:
                at = [*grams(r["text"]), "b"]
                w = {c: weight(c) for c in at}
                g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - r["label"]
                for c in at:
                    z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / toxicity.ALPHA * w[c]
                    n[c] += g * g
        used += bool(mine)
        for c in list(z):
            totals[c] += weight(c)
    totals = {c: w / used for c, w in totals.items()}
    model = toxicity.fit(docs, labels, bits=bits)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, bits=bits).collect()}
    for i, text in rows:
        want = 1 / (1 + math.exp(-(totals["b"] + sum(totals.get(c, 0.0) for c in grams(text)))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == int(want >= 0.5)


def test_quality_is_the_rules_read_in_python(few):
    docs, labels, rows = few
    model = rule_quality.fit(docs, labels)
    assert model.rules
    ops = {"<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    scored = rule_quality.with_statistics(docs, "text", "stats").select("doc_id", "stats", model.score("stats").alias("score"))
    texts = dict(rows)
    for r in scored.collect():
        stats = rule_quality.statistics(raw(texts[r["doc_id"]]))
        assert list(stats) == r["stats"]
        total = model.intercept + sum(w for rule, w in model.rules if all(ops[op](stats[f], x) for f, op, x in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_statistics_by_hand():
    got = dict(zip(rule_quality.STATISTICS, rule_quality.statistics(raw("Ab cd! 12 cd!\n\ncd! x|"))))
    assert got["log_words"] == pytest.approx(math.log(7)) and got["mean_word_chars"] == pytest.approx(15 / 6)
    assert got["upper_share"] == pytest.approx(1 / 15) and got["digit_share"] == pytest.approx(2 / 15)
    assert got["exclaim_share"] == pytest.approx(3 / 15) and got["top_word_share"] == pytest.approx(3 / 6)
    assert got["stop_mark_share"] == pytest.approx(3 / 6) and got["distinct_word_share"] == pytest.approx(4 / 6)


def plain_chunks(words):
    """``{(start, end)}`` from the rules as they are told, a word at a time."""
    n, low, high = len(words), chunk_dedup.MIN_WORDS, chunk_dedup.MAX_WORDS
    bits, ahead = chunk_dedup.BOUNDARY_BITS, chunk_dedup.FORCED_WORDS
    gear, bounds = 0, []
    for i, w in enumerate(words):
        gear = (word_hash(w) + 2 * gear) & MASK
        if i >= bits - 1 and gear % (1 << bits) == 0:
            bounds.append(i)

    def smallest(i):
        if i + ahead > n:
            return MASK >> 1 << 1 | 1
        acc = word_hash(words[i])
        for w in words[i + 1:i + ahead]:
            acc = (acc * 0xD6E8FEB86659FD93 + word_hash(w)) & MASK
        return mix(acc)
    value = [smallest(i) for i in range(n)]
    starts, gap = set(bounds), high - 1
    for i in range(bits - 1, n - gap + 1):
        window = range(i, i + gap)
        if not any(j in window for j in bounds):
            starts |= {j for j in window if value[j] == min(value[i:i + gap])}
    ends = [*bounds, n]
    return {(s, min(next(e for e in ends if e >= s + low), s + high, n)) for s in starts if s + low <= n}


def test_substring_spans_equal_plain_python(spark, prose_of):
    passage, periodic = prose_of(900, 60), " ".join(["same", "two"] * 60)
    texts = [prose_of(1, 50), f"{prose_of(2, 40)} {passage} {prose_of(3, 20)}", f"{prose_of(4, 13)} {passage.upper()}",
             f"{periodic} {prose_of(5, 30)}", f"{prose_of(6, 22)} {periodic}", prose_of(7, 19), "", None, f"{passage} {passage}"]
    rows = list(enumerate(texts))
    first, found = {}, {}
    for i, t in rows:
        words = (t or "").lower().split()
        found[i] = {(s, e, " ".join(words[s:e])) for s, e in plain_chunks(words)}
        for _, _, c in found[i]:
            first.setdefault(c, i)
    want = {}
    for i, spans in found.items():
        lost = sorted({k for s, e, c in spans if first[c] < i for k in range(s, e)})
        if lost:
            want[i] = (len(lost), lost, sorted({first[c] for _, _, c in spans if first[c] < i}))
    got = {r["doc_id"]: (r["n_removed_words"], [k for s, e in zip(r["starts"], r["ends"]) for k in range(s, e)], r["first_doc_ids"])
           for r in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) >= 3


def test_language_is_the_nearest_codeword(spark):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcde", "bb": "efghi", "cc": "ijklm"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[k]), 5)) for _ in range(12)), k)
            for i in range(150) for k in [sorted(letters)[i % 3]]]
    rows += [(500, "", "aa"), (501, "123 !", "bb"), (502, None, None), (503, "ABCDE", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, weights = language.fit(docs)
    code = language.codewords(len(names))
    got = {r["doc_id"]: r for r in language.predict(docs, (names, weights)).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        b = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
        at = [((x << 8 | y) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language.BITS for x, y in zip(b, b[1:])]
        at += [((x << 16 | y << 8 | z) * 0x85EBCA77 + 0x27D4EB2F & 0xFFFFFFFF) >> 32 - language.BITS for x, y, z in zip(b, b[1:], b[2:])]
        margin = [sum(float(weights[a, j]) for a in at) / max(1, len(at)) + float(weights[-1, j]) for j in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margin)) for word in code]
        best = loss.index(min(loss))
        assert got[i]["lang_pred"] == names[best]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), abs=1e-6)
