"""Hard negatives against all products, and on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, n int, across int"


def whole(v):
    return [min(max(math.floor(max(min(256 * x, 9.2e18), -9.2e18)), -(2**63)), 2**63 - 1) for x in v]


def expected(rows, is_anchor, k_positives=5, k=3):
    ok = [(i, y, whole(v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1)
    first = lambda scores, n: sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
    positives, out = {}, set()
    for i, y, a in ok:
        if is_anchor(i):
            for j, z, x in ok:
                if j != i and z == y and len(x) == len(a):
                    positives.setdefault(i, {})[j] = max(positives.get(i, {}).get(j, -(2**63)), dot(a, x))
    for i in {i for i, *_ in ok if is_anchor(i)}:
        for p, ps in first(positives.get(i, {}), k_positives):
            found = {}
            for i2, y, a in ok:
                if i2 == i:
                    for j, z, x in ok:
                        if j != i and z != y and len(x) == len(a) and 50 * ps <= 100 * dot(a, x) <= 95 * ps:
                            found[j] = max(found.get(j, -(2**63)), dot(a, x))
            out |= {(i, p, r, j, ps, s) for r, (j, s) in enumerate(first(found, k), 1)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "x", 1, 2, 3) for i, v, y in rows], SCHEMA)
    got = hn.hard_negatives(df, F.col("vec_id") % 5 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def clustered(n, d, rng, spread=0.3):
    centres = rng.normal(size=(6, d))
    return [(i, (centres[i % 6] + spread * rng.normal(size=d)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("block", [16, 64, 10_000])
def test_against_all_products(spark, block):
    rows = clustered(300, 40, np.random.default_rng(block))
    want = expected(rows, lambda i: i % 5 == 0)
    assert len(want) > 200
    assert mined(spark, rows, block=block) == want


def test_odd_rows(spark):
    draw = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [draw.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(5)], draw.randint(0, 2)) for i in range(60)]
    rows += [(0, None, 1), (5, [0.5] * 5, None), (None, [0.5] * 5, 1), (10, [0.5, None, 0.5, 0.5, 0.5], 1), (15, [nan] * 5, 1), (20, [inf] + [0.5] * 4, 1), (200, [], 1), (201, [], 1), (202, [], 2),
             (205, [0.0] * 5, 1), (210, [0.5] * 4, 0), (211, [0.5] * 4, 0), (212, [0.25] * 4, 1)]
    rows += [(300 + i, [0.5] * 5, i % 3) for i in range(40)]  # a common vector
    assert mined(spark, rows, block=32) == expected(rows, lambda i: i % 5 == 0)


def test_repeated_rows_and_ids(spark):
    rows = [(i % 30, [0.1 * (i % 7), 0.3, -0.2 * (i % 3)], i % 2) for i in range(90)] + [(3, [0.1, 0.3, 0.0], 1)] * 50
    assert mined(spark, rows, block=16) == expected(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("scale", [1e3, 1e8, 1e17, 1e300])
def test_sizes_of_numbers(spark, scale):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) * scale for _ in range(3)], i % 3) for i in range(60)]
    assert mined(spark, rows, block=32) == expected(rows, lambda i: i % 5 == 0)


def test_few_rows(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(0, [1.0], 1)]) == set()
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]) == {(0, 1, 1, 2, 256 * 256, 256 * 192)}
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.75], 2)]) == set()


def test_labels_and_ids_of_other_kinds(spark):
    rows = clustered(80, 6, np.random.default_rng(1))
    df = spark.createDataFrame([(f"k{i:03d}", v, "abcd"[y], i % 5 == 0) for i, v, y in rows], "key string, vector array<float>, kind string, chosen boolean")
    got = hn.hard_negatives(df, F.col("chosen"), label=F.col("kind"), id_col="key", vec_col="vector", block=16)
    narrowed = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    want = {(f"k{a:03d}", f"k{p:03d}", r, f"k{n:03d}", ps, ns) for a, p, r, n, ps, ns in expected(narrowed, lambda i: i % 5 == 0)}
    assert {tuple(r) for r in got.collect()} == want
