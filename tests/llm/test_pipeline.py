"""The corpus pipeline on planted cases, and the registered queries on the smallest tables."""
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from contentfit.llm.common import write_stage
from contentfit.llm.decontaminate import contained_items
from contentfit.llm.near_dup import drop_near_duplicates

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


@pytest.fixture(scope="module")
def tables(spark, prose_of, tmp_path_factory):
    """A folder of small tables with clean documents and planted ones."""
    clean = [(i, prose_of(i, 60 + i % 40)) for i in range(150)]
    junk = [(200 + i, " ".join(w + "***" for w in prose_of(900 + i, 70).split())) for i in range(60)]
    copies = [(300 + i, clean[i][1]) for i in range(10)]
    near = [(320 + i, clean[20 + i][1].replace(clean[20 + i][1].split()[5], "changed")) for i in range(10)]
    passage = prose_of(5000, 70)
    repeats = [(340 + i, f"{prose_of(2000 + i, 80)} {passage} {prose_of(2100 + i, 60)}") for i in range(4)]
    item = prose_of(6000, 25)
    leaks = [(360 + i, f"{prose_of(2200 + i, 50)} {item.upper()} {prose_of(2300 + i, 50)}") for i in range(3)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in clean + junk + copies + near + repeats + leaks]
    rows += [(None, prose_of(7000, 80), None, None, None), (400, None, None, None, None), (401, "", "en", "s", 0)]
    labels = [(i, 1, 0) for i, _ in clean + repeats] + [(i, 0, 0) for i, _ in junk]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose_of(6001, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage, item


def test_stages_catch_planted_cases_and_keep_clean_documents(spark, tables):
    path, passage, item = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_stage(stage(spark, docs, path), name)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(150))
    assert clean <= set(seen["quality"]) and not set(range(200, 260)) & set(seen["quality"])
    assert clean <= set(seen["near_dedup"]) and not set(range(300, 330)) & set(seen["near_dedup"])
    texts = seen["substring_dedup"]
    assert set(texts) == set(seen["near_dedup"]) and [i for i in texts if passage in (texts[i] or "")] == [340]
    left = seen["decontamination"]
    # The first document with the item goes; a later one goes, too, unless the cut before took its copy of the item.
    benchmark = spark.read.parquet(f"{path}/benchmark.parquet")
    assert 360 not in left and contained_items(docs, benchmark).isEmpty()
    assert all(texts[i] != seen["near_dedup"][i] for i in range(361, 363) if i in left)
    assert clean <= set(left) and None in left
    assert all(left[i] == seen["quality"][i] for i in clean)
    packed = corpus_pipeline.packing(spark, docs, path).collect()
    assert sum(r["start"] == 0 for r in packed) == len(left)


def test_near_dedup_links_on_five_words(spark):
    """One changed word in 44: 37 of 45 shingles of four words are shared, 35 of 45 of five; in 60 words, 51 of 61."""
    def pair(i, n):
        words = [f"w{i}x{j}" for j in range(n)]
        return [(i, " ".join(words)), (i + 1, " ".join([*words[:n // 2], "changed", *words[n // 2 + 1:]]))]
    docs = spark.createDataFrame(pair(10, 44) + pair(20, 60), "doc_id long, text string")
    assert {r["doc_id"] for r in drop_near_duplicates(docs).collect()} == {10, 20}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, None).collect()} == {10, 11, 20}


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert out.where("offset + length > 2048").count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(m[1]) for m in map(re.compile(r"op(\d+)_").match, names) if m) == list(range(1, 14))


def _values(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if re.match(r"op\d+_", k)))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})")
    assert _values(got.select(*columns).collect()) == _values(want.fetchall())
