"""Hard negatives by one-bit codes against scoring every pair."""

import math

import numpy as np
from pyspark.sql import functions as F

from lotwise.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, score double, place int"


def brute(rows):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
        if sum(c * c for c in x) < 1 << 62:
            seen[i, (label + 1) % 10 if i % 7 == 0 else label, x] = True
    out = []
    for a, la, x in seen:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, label) for i, label, y in seen if i != a and len(x) == len(y))
        for s, p, _ in [r for r in scored if r[2] == la][:5]:
            some = [r for r in scored if r[2] != la and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(a, p, k, r[1], -s, -r[0]) for k, r in enumerate(some, 1)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", 1.0, 2) for i, v, label in rows], SCHEMA).repartition(3)
    relabel = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(tuple(r) for r in H.hard_negatives(H.stored(H.coded(df, relabel=relabel), "t"), F.col("id") % 100 == 0).collect())
    assert got == brute(rows)
    return got


def cloud(n, dim, seed, first=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    x = centres[rng.integers(0, 6, n)] + .7 * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(first + i, [float(c) for c in x[i]], int(rng.integers(0, 10))) for i in range(n)]


def test_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE", 3)
    assert len(check(spark, cloud(900, 64, 1))) > 300
    check(spark, cloud(400, 70, 2) + cloud(300, 5, 3, 1000))


def test_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 80)
    check(spark, cloud(1200, 16, 4, -200))


def test_odd_rows(spark):
    v = [.5, -.25, .125]
    rows = [(0, v, 1), (0, v, 1), (0, [.1, .2, .3], 2), (1, v, 1), (2, v, 1), (3, [.4, -.2, .1], 4), (4, [.3, -.2, .1], 4),
            (5, None, 1), (6, v, None), (None, v, 1), (8, [.5, None, .1], 1), (9, [.5, float("nan"), .1], 1),
            (10, [float("inf"), 0., 0.], 1), (11, [3e38, 0., 0.], 1), (12, [8e6, 8e6, 8e6], 4), (13, [], 3), (100, [], 3),
            (200, [0., 0., 0.], 4), (14, [0., 0., 0.], 4), (15, [0.] * 3, 5), (300, [-.5, .25, 0.], 4), (16, [1e4, -3.3, 7.], 1)]
    rows += [(1000 + i, [.375, -.25, .125], 5) for i in range(30)] + [(50, v, 1)] * 3
    assert check(spark, rows)
    assert check(spark, []) == []
    assert check(spark, [(i, v, 1) for i in range(201)]) == []


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(5)
    v = rng.integers(-99, 99, (500, 64))
    q = rng.integers(-99, 99, (40, 64))
    group = H.Anchors(np.arange(40), np.arange(40), np.zeros(40), q)
    low, high = group.intervals(*H.one_bit_codes(v), np.sqrt((v * v).sum(1)), slice(0, 40))
    true = v @ q.T
    assert (low <= true).all() and (true <= high).all()
    lengths = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))
    assert ((high - low) / lengths).mean() < 0.45
