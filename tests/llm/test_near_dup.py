import re

import pytest

from contentfit.llm.common import shingle_set
from contentfit.llm.graph import components
from contentfit.llm.near_dup import (drop_near_duplicates, minhash_samples, near_duplicates, odd_sketch, reject_bits)


def brute(rows, k=4, pct=80):
    """Components over all pairs, from the definition."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= pct * len(sets[a] | sets[b]) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return {i: (len(sets[i]), low[i]) for i in sets}


def edited(text, at):
    words = text.split()
    for i in at:
        words[i] = f"edit{i}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family(prose_of):
    """Chains, a group of copies that are near the original but not each other, and strangers."""
    base, rows = prose_of(50, 120), []
    rows.append((100, base))
    rows += [(101 + i, edited(base, [5 + 3 * i, 60 + i])) for i in range(12)]
    rows += [(200 + i, edited(base, range(i, 110, 17))) for i in range(14)]
    rows += [(300 + i, prose_of(60 + i, 90)) for i in range(8)]
    step = prose_of(70, 100)
    for i in range(6):
        rows.append((400 + i, step))
        step = edited(step, [10 * i + 1, 10 * i + 2])
    rows += [(50, base.upper()), (51, "short one"), (52, "Short  one"), (53, ""), (54, "  ")]
    return rows


def test_equals_brute_force(spark, family):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           near_duplicates(spark.createDataFrame(family, "doc_id long, text string")).collect()}
    assert got == brute(family)


def test_kept_is_one_of_each_component(spark, family):
    docs = spark.createDataFrame(family, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect())
    assert kept == sorted({c for _, c in brute(family).values()})


def test_odd_rows(spark, odd_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] for i in (3, 4, 5))
    assert by_id[8]["n_shingles"] == 1 and by_id[6]["n_shingles"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    left = drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1


def test_empty(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51), (60, 60), (70, None)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50}


def test_sketch_of_equal_sets_cancels_and_bound_keeps_the_threshold():
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    limit = reject_bits(128, 256, 0.8)
    for _ in range(200):
        other = base.copy()
        other[rng.choice(400, 44, replace=False)] = rng.integers(0, 1 << 63, 44, dtype=np.uint64)  # similarity 0.802
        a, b = (odd_sketch(minhash_samples(np.unique(x), 128), 256).view(np.uint64) for x in (base, other))
        assert sum(bin(int(x)).count("1") for x in a ^ b) <= limit
    assert not np.any(odd_sketch(minhash_samples(base, 128), 256) ^ odd_sketch(minhash_samples(base[::-1], 128), 256))


def test_shingles_ignore_block_cuts(monkeypatch, prose_of):
    import numpy as np

    from contentfit.llm import common
    raw = np.frombuffer(prose_of(9, 3000).encode(), dtype=np.uint8)
    whole = shingle_set(raw, 4)
    monkeypatch.setattr(common, "_PIECES", 3)
    assert np.array_equal(whole, shingle_set(raw, 4))


def test_rows_of_one_id_go_by_their_own_text(spark, prose_of):
    rows = [(1, prose_of(1, 80), "a"), (5, prose_of(1, 80), "b"), (5, prose_of(2, 80), "c"), (5, None, "d"), (5, "", "e"),
            (6, prose_of(1, 80) + " more", "f"), (7, prose_of(3, 80), "g"), (None, prose_of(1, 80), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    for k in (4, 5):
        left = drop_near_duplicates(docs, k=k)
        assert left.columns == docs.columns
        assert sorted(r["digest"] for r in left.collect()) == list("acdegh")


def test_pairs_grow_with_classes_not_with_their_square(spark, prose_of, monkeypatch):
    """A group of near copies just short of the threshold: what is verified stays
    near one pair for each class and hub, and most pairs past the bitmaps are links."""
    from contentfit.llm import near_dup as nd
    from contentfit.llm.common import write_stage
    base, seen, confirm = prose_of(50, 150), [], nd._confirm

    def counted(pairs, *rest):
        pairs = write_stage(pairs, "counted")
        found = write_stage(confirm(pairs, *rest), "counted")
        seen.append((pairs.count(), found.count()))
        return found
    monkeypatch.setattr(nd, "_confirm", counted)
    verified = []
    for n in (100, 200):
        seen.clear()
        rows = [(i, edited(base, sorted({(i * 7 + j * 37 + i * j % 11) % 146 + 2 for j in range(4)}))) for i in range(n)]
        got = {r["doc_id"]: r["component_id"] for r in
               near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: low for i, (_, low) in brute(rows).items()}
        verified.append(sum(p for p, _ in seen))
        assert seen[-1][0] <= 4 * seen[-1][1] + 20
    assert verified[1] <= 3 * verified[0] + 100


def test_hub_bitmaps(spark):
    from contentfit.llm.near_dup import hub_bitmaps
    sets = spark.createDataFrame([(b"h", list(range(70))), (b"x", [0, 65, 69, 100]), (b"y", [200])], "digest binary, shingles array<long>")
    pairs = spark.createDataFrame([(b"h", b"x"), (b"h", b"y")], "hub binary, digest binary")
    got = {bytes(r["digest"]): r for r in hub_bitmaps(pairs, sets).collect()}
    assert {k: (r["bits"], r["common"]) for k, r in got.items()} == {b"x": ([1, (1 << 1) + (1 << 5)], 3), b"y": ([0, 0], 0)}
    for r in got.values():
        assert len(r["others"]) == 8 and sum(bin(w & (1 << 64) - 1).count("1") for w in r["others"]) + r["lost"] == 1


def test_recall_of_the_bands():
    """Pairs at a similarity of exactly 0.8 share a band but for 5 in 10^8; none of 4,000 made ones is lost."""
    import numpy as np

    from contentfit.llm.near_dup import band_keys
    rng = np.random.default_rng(11)
    for _ in range(4000):
        base = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        other = np.concatenate((base[10:], rng.integers(0, 1 << 63, 10, dtype=np.uint64)))  # 80 of 100
        a, b = (band_keys(minhash_samples(x, 128), 32) for x in (base, other))
        assert (a == b).any()


def test_clashing_columns(spark, prose_of):
    docs = spark.createDataFrame([(1, prose_of(1, 50), 7, 8), (2, prose_of(1, 50), 9, 10), (2, prose_of(2, 50), 1, 1)],
                                 "doc_id long, text string, near_id int, near_digest int")
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["near_id"] for r in left.collect()) == [1, 7]
