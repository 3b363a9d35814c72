"""Hard negatives against brute force in Python's integers."""

import math

import numpy as np
import pyarrow as pa
import pytest

from civicspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, Row string, positives string"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """Rows by number; ties by id, nulls last, then number (ids differ here)."""
    use = []
    for i, v, lab in rows:
        if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(256 * x) for x in v], lab))
    out, last = [], float("inf")
    for a in use:
        if a[0] is None or a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[1], b[1]))
        place = lambda b: (-score(b), last if b[0] is None else b[0])
        for p in sorted((b for b in use if b is not a and b[2] == a[2]), key=place)[:positives]:
            ps = score(p)
            fit = sorted((b for b in use if b[2] != a[2] and low * ps <= 100 * score(b) <= high * ps), key=place)[:negatives]
            out += [(a[0], p[0], k + 1, b[0], ps, score(b)) for k, b in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.mine(df, **options).collect()), key=repr)


@pytest.mark.parametrize("scale", [0.1, 1e5, 1e25])
def test_products_are_exact(scale):
    rng = np.random.default_rng(4)
    lists = lambda n: pa.chunked_array([pa.array([list(rng.normal(size=rng.integers(0, 9)) * scale) for _ in range(n)], pa.list_(pa.float64()))])
    many, rows = H.integers(lists(7)), H.integers(lists(40))
    packed = H.Packed(rows, many)
    for k in range(7):
        assert [int(x) for x in packed.scores(k)] == [sum(int(x) * int(y) for x, y in zip(many[k], r)) for r in rows]


def table(rng, n, groups=6, wide=8):
    centres = rng.normal(size=(groups, wide))
    return [(i, (centres[rng.integers(groups)] + rng.normal(size=wide) * 0.6).tolist(), int(rng.integers(3))) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 60)
    monkeypatch.setattr(H, "ANCHORS", 5)
    rows = table(np.random.default_rng(1), 400)
    rows += [(400, None, 1), (401, [1.0, None] + [0.0] * 6, 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] + [0.0] * 7, 1),
             (404, rows[0][1], None), (None, rows[50][1], rows[50][2]), (450, [0.0] * 8, 0), (500, [2.0, 1.0], 2), (550, [], 1), (600, [3.0] * 8, 9)]
    rows += [(1000 + k, rows[100][1], k % 3) for k in range(90)]  # copies: ties
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50
    assert mined(spark, rows, every=7, positives=2, negatives=4, low=-50, high=80) == brute(rows, 7, 2, 4, -50, 80)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (3, [0.7, 0.1], 2)]
    assert mined(spark, rows) == [(50, 50, 1, 3, 65536, 256 * 179)] * 2


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
