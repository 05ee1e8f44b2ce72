import re

import pytest

from contentfit.llm.decontaminate import contained_items, drop_contaminated


def brute(docs, items, k=5, pct=80):
    def shingles(text):
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    out = {}
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and 100 * len(have & want) >= pct * len(want):
                out[d, i] = (len(want), len(have & want))
    return out


@pytest.fixture(scope="module")
def planted(prose_of):
    items = [(i, prose_of(i, 12 + 3 * i)) for i in range(1, 16)] + [(90, "only four words here"), (91, "")]
    docs = [(100 + i, f"{prose_of(500 + i, 300)} {t.upper()}! {prose_of(600 + i, 2000)}") for i, t in items[:10]]
    for i, t in items[5:15]:
        words = t.split()
        words[len(words) // 2] = "changed"  # five shingles lost: above or below the limit by size
        docs.append((200 + i, f"{prose_of(700 + i, 50)}. {' '.join(words)}"))
    docs += [(300 + i, prose_of(800 + i, 200)) for i in range(20)] + [(400, "only four words here"), (401, None)]
    return docs, items


def test_equals_brute_force(spark, planted):
    docs, items = planted
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_shared"]) for r in got} == want
    assert len(want) > 12 and all(abs(r["containment"] - r["n_shared"] / r["n_item_shingles"]) < 1e-12 for r in got)


def test_no_python_on_the_main_path(spark, planted):
    docs, items = planted
    plan = contained_items(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark, odd_docs, no_docs):
    one = [r["text"] for r in odd_docs.where("doc_id = 12").collect()][0]
    items = spark.createDataFrame([(1, one), (1, one), (None, one), (2, None), (3, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contained_items(odd_docs, items).collect()] == [(12, 1)]
    left = drop_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1
    assert contained_items(odd_docs, items.limit(0)).count() == 0 and drop_contaminated(no_docs, items).count() == 0
