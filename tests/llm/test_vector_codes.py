import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentfit.llm import vector_codes as vc
from contentfit.llm.int_vectors import exact_products, limb_bits, limbs, nearest, scaled_rows

SCHEMA = "vec_id long, embedding array<float>, label int, v int, row int, error string, code int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "e", 3, 4) for r in rows], SCHEMA)


def brute(rows, entries=256, rounds=4, parts=4, scale=1024):
    """The contract in plain Python integers."""
    kept = [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(part, book):
        away = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(assign(c[p], books[p])[0], []).append(c[p])
            for e, members in groups.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    coded = []
    for (i, label, _), c in zip(kept, cut):
        found = [assign(c[p], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in coded), key=str)


def rows_of(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=width) * scale], [None, 0, 1][i % 3]) for i in range(n)]


@pytest.mark.parametrize("n, width, entries, scale", [(60, 8, 6, 1.0), (5, 4, 256, 1.0), (40, 16, 9, 25_000.0)])
def test_brute_force(spark, n, width, entries, scale):
    rows = rows_of(n, n, width, scale)
    rows += [(100 + i, v, label) for i, (_, v, label) in enumerate(rows[:7])]  # equal vectors
    rows += [rows[3], (None, rows[4][1], 1), (200, None, 1), (201, [None] + rows[0][1][1:], 0), (202, [], 0),
             (203, [math.nan] + rows[0][1][1:], 0), (204, [math.inf] + rows[0][1][1:], 1), (205, [0.0] * width, None)]
    got = vc.compress_vectors(frame(spark, rows).repartition(5), entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, entries)


def test_other_widths_empty_and_errors(spark):
    rows = [(1, [1.0] * 8, 0), (2, [1.0] * 4, 0), (3, [2.0] * 8, 0)]
    assert sorted(r.vec_id for r in vc.compress_vectors(frame(spark, rows)).collect()) == [1, 3]
    assert vc.compress_vectors(frame(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress_vectors(frame(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(Exception, match="doesn't fit"):
        vc.compress_vectors(frame(spark, [(1, [3e30] * 8, 0)])).collect()


@pytest.mark.parametrize("most", [3, 2**12, 2**24, 2**27, 2**28 - 1])
def test_limb_products_are_exact(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most + 1, (9, 16)), rng.integers(-most, most + 1, (7, 16))
    a[0], b[0] = most, -most
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert exact_products(a, b).tolist() == want
    bits = limb_bits(16)
    for limb in limbs(a, bits):
        assert np.abs(limb).max() <= 2 ** bits and 16 * 2 ** (2 * bits) <= 2 ** 53
    assert (sum(x.astype(np.int64) << bits * i for i, x in enumerate(limbs(a, bits))) == a).all()


def test_first_of_equally_near():
    x = np.array([[0, 0], [2, 0]])
    book = np.array([[1, 0], [1, 0], [-1, 0], [3, 0]])
    at, away = nearest(x, book)
    assert at.tolist() == [0, 0] and away.tolist() == [1, 1]


def test_decode_is_the_entries(spark):
    rows = rows_of(3, 30, 8)
    ints, width = scaled_rows(frame(spark, rows), "vec_id", "embedding", F.col("label"), 1024)
    books = vc.fit_codebooks(ints, entries=8)
    coded = {r["id"]: r for r in vc.encode(ints, books).collect()}
    for r in ints.collect():
        away = ((np.array(r["v"]) - vc.decode(coded[r["id"]]["code"], books)) ** 2).sum()
        assert away == coded[r["id"]]["error"]
    assert width == 8
