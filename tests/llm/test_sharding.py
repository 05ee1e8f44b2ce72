import zlib

import pytest

from contentfit.llm.sharding import ROW_BYTES, assign_shards, write_shards


def expected(rows, shards):
    """``(doc_id, size, crc, shard, slot)`` by one running sum over all rows."""
    order = sorted(((i is not None, i or 0, len((t or "").encode()) + ROW_BYTES, zlib.crc32((t or "").encode())) for i, t in rows))
    total, start, slots, out = sum(r[2] for r in order), 0, {}, []
    for has, i, size, crc in order:
        shard = (2 * start + size) * shards // (2 * total)
        out.append((i if has else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        start += size
    return sorted(out, key=str)


def manifest(docs, **params):
    return sorted((tuple(r) for r in assign_shards(docs, **params).collect()), key=str)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    for shards in (1, 3, 40):
        assert manifest(odd_docs, shards=shards, block_rows=4) == expected(rows, shards)
    assert manifest(no_docs) == []


def test_hot_key_is_cut(spark):
    rows = [(1, "same text")] * 300 + [(i, "x" * (i % 50)) for i in range(600)] + [(None, "n")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = manifest(docs, shards=10, block_rows=50)
    assert got == expected(rows, 10)
    sizes = {}
    for _, size, _, shard, _ in got:
        sizes[shard] = sizes.get(shard, 0) + size
    target = sum(sizes.values()) / 10
    assert len(sizes) == 10 and all(abs(s - target) <= 2 * 66 for s in sizes.values())


@pytest.mark.parametrize("name", ["plain", "shard"])
def test_written_shards_hold_the_manifest(spark, odd_docs, tmp_path, name):
    docs = odd_docs.withColumnRenamed("lang", "shard") if name == "shard" else odd_docs
    of = write_shards(docs, str(tmp_path / "out"), shards=4, block_rows=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, of}
    found = sorted(((r.doc_id, len((r.text or "").encode()) + ROW_BYTES, zlib.crc32((r.text or "").encode()), r[of])
                    for r in back.collect()), key=str)
    assert found == sorted((r[:4] for r in manifest(docs, shards=4, block_rows=3)), key=str)


def test_no_python_workers(odd_docs):
    plan = assign_shards(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_empty_table_writes_nothing(spark, no_docs, tmp_path):
    assert write_shards(no_docs, str(tmp_path / "none")) == "shard"
