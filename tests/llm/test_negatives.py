"""Hard negatives against brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from mailsift.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row long, cell int, r int, vector string"


def brute(rows, shift=True, anchor_step=100, low=30, high=90, n_pos=5, n_neg=10):
    live = []
    for i, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if shift and i is not None and i % 7 == 0:
            label = (label + 1) % 10
        live.append((i, [math.floor(256 * x) for x in vector], label))
    out = []
    for k, (i, vector, label) in enumerate(live):
        if i is None or i % anchor_step:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(vector, v)), j is None, j or 0, n) for n, (j, v, _) in enumerate(live)
                         if n != k))
        named = [(-s, None if gone else j, live[n][2]) for s, gone, j, n in scored]
        for p, pid, _ in [x for x in named if x[2] == label][:n_pos]:
            hits = [(s, j) for s, j, other in named if other != label and low * p <= 100 * s <= high * p][:n_neg]
            out += [(i, pid, rank, j, p, s) for rank, (s, j) in enumerate(hits, 1)]
    return collections.Counter(out)


def mined(df, **options):
    rows = H.usable(df, "vec_id", "embedding", "label")
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return collections.Counter(map(tuple, H.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0, **options).collect()))


def made(seed):
    import numpy as np
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = []
    for i in range(400):
        label = rng.choice([0] * 6 + list(range(10)))
        rows.append((i * 25, [f32(rng.gauss(0.3, 1) * 0.1) for _ in range(8)], label))
    same = rows[5][1]
    rows += [(i, same, rng.randrange(3)) for i in range(10_000, 10_120)]  # ties, a hot vector
    rows += [(200, rows[8][1], rows[8][2]), (200, same, 4), (None, same, 1), (None, rows[9][1], 2), (700, None, 1),
             (800, [None] + same[1:], 1), (900, [float("nan")] + same[1:], 1), (1000, [float("inf")] + same[1:], 1),
             (1100, same, None), (1200, [], 3), (1300, same[:3], 3), (1400, [0.0] * 8, 5), (1500, [-x for x in same], 0)]
    return [(*r, "x", 1, 2, 3, "v") for r in rows]


@pytest.mark.parametrize("block", [8192, 70])
def test_mining_equals_brute_force(spark, block):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert mined(df, block_rows=block) == brute(rows)


def test_zero_scores_and_other_limits(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [0.0, 3.0], 3), (4, [0.5, 0.0], 1), (5, [0.25, 0.0], 2)]
    rows = [(*r, "x", 1, 2, 3, "v") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter(map(tuple, H.mine(H.usable(df, "vec_id", "embedding", "label"), F.col("id") == 0,
                                                positives=2, negatives=1).collect()))
    want = brute(rows, shift=False, anchor_step=10 ** 9, n_pos=2, n_neg=1)
    assert got == want and any(p == 0 for _, _, _, _, p, _ in got)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e9, 1.0], 1), (1, [2e9, 1.0], 1), (2, [1.2e9, -1.0], 2), (3, [1e30, 0.0], 2)]
    rows = [(*r, "x", 1, 2, 3, "v") for r in rows]
    got = H.products(*[__import__("numpy").array([[256 * 3e9, 256.0]])] * 2)
    assert got[0, 0] == 2 ** 63 - 1
    df = spark.createDataFrame(rows, SCHEMA)
    assert H.mine(H.usable(df, "vec_id", "embedding", "label"), F.col("id") == 0).count() >= 0


def test_empty(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == collections.Counter()


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert mined(df) == brute([tuple(r) for r in df.collect()])
