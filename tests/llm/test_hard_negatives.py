"""Hard negatives against a plain version, and odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kinframe.llm.hard_negatives import Heap, hard_negatives, strassen


def test_strassen():
    draw = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (33, 64, 47), (64, 64, 64), (65, 33, 70), (5, 64, 90), (0, 64, 9), (9, 0, 9)):
        a, b = draw.integers(-(2**20), 2**20, (m, k)), draw.integers(-(2**20), 2**20, (k, n))
        for least in (1, 4, 16):
            assert (strassen(a, b, least) == a @ b).all()
    a, b = draw.integers(-(2**31), 2**31, (40, 1)).repeat(40, 1), np.zeros((40, 40), np.int64)
    b[0] = 2**31 - 1  # sums on the way wrap around, the result fits
    assert (strassen(a, b, 4) == a[:, :1] * (2**31 - 1)).all()


def test_heaps_merge():
    draw = random.Random(2)
    pairs = [(draw.randrange(-5, 5), k) for k in range(60)]
    a, b = Heap(7), Heap(7)
    for k, p in enumerate(pairs):
        (a if k % 2 else b).merge([p[0]], [p[1]])
    a.merge(*zip(*b.pairs()))
    assert a.pairs() == sorted(pairs, key=lambda p: (-p[0], p[1]))[:7] and a.least() == a.pairs()[-1][0]


def plain(rows, is_anchor, most=5, low=80, high=100):
    ok = [r for r in dict.fromkeys((i, tuple(v) if v is not None else None, g) for i, v, g in rows)
          if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    q = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in ok]
    out = []
    for ai, av, ag in (r for r in q if is_anchor(r[0])):
        scored = [(-sum(x * y for x, y in zip(av, v)), i, g) for i, v, g in q if i != ai and len(v) == len(av)]
        for ps, p, _ in sorted(r for r in scored if r[2] == ag)[:most]:
            near = sorted(r for r in scored if r[2] != ag and low * -ps <= 100 * -r[0] <= high * -ps)[:most]
            out += [(ai, p, k, i, -ps, -s) for k, (s, i, _) in enumerate(near, 1)]
    return sorted(out)


def test_equals_plain(spark):
    draw = random.Random(3)
    vector = lambda dim: [draw.choice([-1.5, -0.5, 0.0, 0.25, 1.0, draw.uniform(-1, 1)]) for _ in range(dim)]
    rows = [(k, vector(6), draw.choice([1, 1, 1, 2, 3, -4])) for k in range(400)]
    rows += [(k, vector(3), draw.randrange(2)) for k in range(400, 460)]
    rows += rows[:20] + [(20, vector(6), 1), (20, vector(6), 2)]  # equal rows, and an id of several vectors
    rows += [(1000, None, 1), (1010, [1.0, None, 1.0], 1), (1020, [float("nan")] * 6, 1), (1030, [float("inf")] * 6, 1), (1040, vector(6), None), (None, vector(6), 1), (1050, [], 1), (1060, [], 2)]
    rows += [(1100 + k, [1.0] * 6, k % 2) for k in range(30)]  # ties
    df = spark.createDataFrame([(i, v, g, "x") for i, v, g in rows], "vec_id long, embedding array<double>, label int, rank string").repartition(3)
    for sizes in ({}, {"anchor_tile": 7, "stripe": 50, "chunk": 17}):
        got = hard_negatives(df, F.col("id") % 10 == 0, **sizes)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0)
    got = hard_negatives(df, F.col("id") % 10 == 0, positives=2, low=50, high=150)
    want = [r for r in plain(rows, lambda i: i % 10 == 0, low=50, high=150)]
    firsts = {a: {p for p in [r[1] for r in sorted((r for r in want if r[0] == a), key=lambda r: (-r[4], r[1]))]} for a in {r[0] for r in want}}
    assert {(r.anchor_id, r.positive_id) for r in got.collect()} <= {(a, p) for a, of in firsts.items() for p in of}


def test_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df, F.col("id") % 10 == 0).collect() == [] == hard_negatives(df.limit(0), F.lit(True)).collect()
