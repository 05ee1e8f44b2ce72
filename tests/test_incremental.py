"""A kept-up-to-date fit equals one made anew, and does only what changed."""

import pytest

from contentfit.operators import sections as sx
from contentfit.plans import incremental as inc


def html(i, word):
    return f"<title>t{i}</title><h1>{word} head {i}</h1><p>{word} text w{i % 7}<p>other w{i % 5} {word}<ul><li>item {word}</ul>"


def frames(spark, pages, queries):
    return (spark.createDataFrame(pages, "page_id long, url string, html string"),
            spark.createDataFrame(queries, "query_id long, query string"))


def fits(spark, path, buckets):
    return sorted(map(str, inc.Tables(spark, path, buckets).read("fits", inc.FITS).drop("bucket").collect()))


@pytest.fixture
def steps():
    pages = [(i, f"http://h/{i}", html(i, "red")) for i in range(30)] + [(None, "http://n/", html(90, "blue")), (50, None, None)]
    queries = [(1, "red head"), (2, "w1 item"), (2, "text")]
    changed = [(i, u, html(i, "green") if i in (3, 17) else h) for i, u, h in pages]
    return [(pages, queries), (changed, queries), ([p for p in changed if p[0] != 5] + [(60, "http://h/60", html(60, "red"))], queries),
            (changed, [*queries[1:], (4, "green head")]), (changed[:2], queries[:1]), (changed + [changed[4]], queries), ([], [])]


def test_equal_to_a_run_from_nothing(spark, tmp_path, steps):
    path = str(tmp_path / "kept")
    want = [(32, 0, 3, 0), (2, 0, 0, 0), (1, 1, 0, 0), (1, 1, 1, 1), (0, 30, 1, 3), (30, 0, 2, 0), (0, 32, 0, 3)]
    for n, (pages, queries) in enumerate(steps):
        p, q = frames(spark, pages, queries)
        counts = inc.update_fits(spark, p, q, path, 0.3, buckets=4)
        whole = inc._fits(sx.page_sections(p), q.distinct(), 0.3)
        whole = sorted(map(str, whole.select(inc.Tables(spark, path, 4).read("fits", inc.FITS).drop("bucket").columns).collect()))
        assert fits(spark, path, 4) == whole, n
        assert tuple(counts[k] for k in ("pages_parsed", "pages_gone", "queries_new", "queries_gone")) == want[n], n
        if n == 1:
            assert 0 < counts["pairs_scored"] * 10 < len(whole)
    same = inc.update_fits(spark, *frames(spark, *steps[-1]), path, 0.3, buckets=4)
    assert set(same.values()) == {0}


def test_a_dead_run_leaves_the_tables(spark, tmp_path, steps, monkeypatch):
    path = str(tmp_path / "t")
    inc.update_fits(spark, *frames(spark, *steps[0]), path, 0.3, buckets=4)
    before = fits(spark, path, 4)
    stage = inc.stage_table

    def dies(df, name):
        if name == "current":
            raise RuntimeError("lost")
        return stage(df, name)
    monkeypatch.setattr(inc, "stage_table", dies)
    with pytest.raises(RuntimeError):
        inc.update_fits(spark, *frames(spark, *steps[1]), path, 0.3, buckets=4)
    monkeypatch.undo()
    assert fits(spark, path, 4) == before
    assert inc.update_fits(spark, *frames(spark, *steps[1]), path, 0.3, buckets=4)["pages_parsed"] == 2


def test_a_run_writes_what_is_new_alone(spark, tmp_path, steps):
    """A row for a section, not for a pair; of pages that stay as they are nothing is written again."""
    path = str(tmp_path / "t")
    for step in steps[:2]:
        inc.update_fits(spark, *frames(spark, *step), path, 0.3, buckets=4)
    sections, fits_1 = (spark.read.parquet(f"{path}/{name}/run=1").count() for name in ("sections", "fits"))
    assert fits_1 == sections > 100
    for name in ("sections", "fits"):
        new = spark.read.parquet(f"{path}/{name}/run=2")
        assert {r.page_id for r in new.collect()} == {3, 17} and new.count() * 10 < sections


def test_rewritten_tables_and_queries_beyond_the_bound(spark, tmp_path, steps, monkeypatch):
    """Every run writes the tables anew first, queries are scored in blocks, and a pair keeps the cut it was scored with."""
    path = str(tmp_path / "t")
    monkeypatch.setattr(inc, "MAX_RUNS", 0)
    monkeypatch.setattr(inc.config, "BROADCAST_MAX_ROWS", 2)
    pages, queries = steps[3]
    inc.update_fits(spark, *frames(spark, *steps[0]), path, 0.3, buckets=4)
    assert inc.Tables(spark, path, 4).rows("queries", inc.NUMBERED).select("batch").distinct().count() > 1
    p, q = frames(spark, pages, queries)
    inc.update_fits(spark, p, q, path, 0.3, buckets=4)
    whole = inc._fits(sx.page_sections(p), q, 0.3)
    whole = sorted(map(str, whole.select(inc.Tables(spark, path, 4).read("fits", inc.FITS).drop("bucket").columns).collect()))
    assert fits(spark, path, 4) == whole
    p, q = frames(spark, pages, [*queries, (5, "green head")])
    inc.update_fits(spark, p, q, path, 1.1, buckets=4)
    now = inc.Tables(spark, path, 4).read("fits", inc.FITS).where("raw_score >= 0.3").select("query_id", "verdict").distinct().collect()
    assert {tuple(r) for r in now} == {(2, "fit"), (4, "fit"), (5, "low_fit")}
