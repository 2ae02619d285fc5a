"""Hard negatives against a comparison of all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows: list[tuple], every: int = 100) -> list[tuple]:
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    by_id = lambda i: (i is None, i or 0)
    out = []
    for a in use:
        if a[0] is None or a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731
        ranked = sorted(((-score(r), by_id(r[0]), r) for r in use if r[0] != a[0]), key=lambda x: x[:2])
        for s, _, p in [x for x in ranked if x[2][1] == a[1]][: negatives.POSITIVES]:
            fits = [x for x in ranked if x[2][1] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][: negatives.NEGATIVES]
            out += [(a[0], p[0], k + 1, x[2][0], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


def vectors(seed: int, n: int, width: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.5) for _ in range(width)] for _ in range(5)]
    out = []
    for i in range(n):
        label = rng.randrange(5)
        out.append((i * 10, [x + rng.gauss(0, 0.2) for x in centres[(label + rng.randrange(2)) % 5]], label))
    same = [0.25] * width
    return out + [(5_000 + k, same, k % 3) for k in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    rows = vectors(seed, 200)
    rows += [(7_000, None, 1), (7_001, [0.1, None], 1), (7_002, [0.1, float("nan")], 1), (7_003, [float("inf")], 1), (7_004, [0.5], None), (7_100, [], 1), (7_200, [0.5, 0.25], 2), (None, [0.4] * 6, 2), (None, [0.4] * 6, 3)]
    rows += [(3_000, [1.0, -1.0, 0.001, 0.0, 0.5, 0.25], 4), rows[3], rows[10]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("q", "row", "group", "positives", "score", "rank", "anchor_row"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted((tuple(r) for r in negatives.hard_negatives(df).collect()), key=str)
    assert got == brute(rows) and len(got) > 50
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id % 100 = 1")).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i * 50, [float(rng.randrange(-(1 << 22), 1 << 22)) for _ in range(3)], i % 2) for i in range(60)]
    got = sorted((tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows) and got
    huge = [(i * 100, [(-1.0) ** i * 1e300, 2.0], i % 2) for i in range(8)]
    assert negatives.hard_negatives(spark.createDataFrame(huge, SCHEMA)).count() >= 0


def test_brackets_hold_every_score():
    rng = np.random.default_rng(5)
    m = np.floor(rng.normal(0, 60, (6, 12))[rng.integers(0, 6, 300)] + rng.normal(0, 6, (300, 12)))
    squares = np.einsum("ij,ij->i", m, m)
    more = np.sqrt(squares.max() - squares)
    pivots = negatives.farthest(np.column_stack([m, more])[:100], 8)
    space = negatives._Space(12, float(squares.max()), pivots)
    anchors, rows = space.distances(m[:40], False), space.distances(m, True)
    low, high = negatives.brackets(anchors, rows, rows, squares[:40], space)
    exact = m[:40] @ m.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < squares[:40, None] * 0.7).mean() > 0.5  # between clusters the brackets rule rows out
    near, far = rows.min(0)[None], rows.max(0)[None]
    low, high = negatives.brackets(anchors, near, far, squares[:40], space)
    assert (low <= exact.min(1, keepdims=True)).all() and (exact.max(1, keepdims=True) <= high).all()


def test_tops_take_the_first_of_ties():
    none = -negatives._LONG - 1
    s = np.array([[3, 5, 5, 5, 1, 5], [none, 2, none, none, 2, none], [none] * 6])
    assert negatives._tops(s, 3).tolist() == [[False, True, True, True, False, False], [False, True, False, False, True, False], [False] * 6]
