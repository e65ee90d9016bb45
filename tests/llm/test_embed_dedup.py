"""Embedding near-duplicates against all pairs in numpy."""

import math

import numpy as np
import pytest

from lotwise.llm import embed_dedup as E
from tests.llm.test_ngram_join import smallest

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string, v int"


def brute(rows, threshold=0.93):
    good = []
    for k, (i, v, label, *_) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((k, i, label, np.array(v, np.float32).astype(np.float64)))
    links, n = [], [0] * len(rows)
    for p, (k, i, label, x) in enumerate(good):
        for m, j, other, y in good[:p]:
            if label == other and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links.append((i, j))
                n[k] += 1
                n[m] += 1
    own = smallest({i for i, *_ in rows if i is not None}, links)
    return sorted(((i, n[k], own.get(i), i is not None and own[i] == i) for k, (i, *_) in enumerate(rows)), key=repr)


def check(spark, rows):
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def vectors(seed, n, dim=16):
    """Clusters of close vectors, exact copies among them, three labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12 + 1, dim))
    out = []
    for i in range(n):
        x = centres[rng.integers(len(centres))]
        x = x + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3, 0.5])
        out.append((i, [float(v) for v in (x * rng.choice([1.0, 2.0])).astype(np.float32)], int(rng.integers(3)), "", 0))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    check(spark, vectors(1, 400))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, "", 0), (2, [], 0, "", 0), (3, [0.0, 0.0], 0, "", 0), (4, [1.0, None], 0, "", 0), (5, [nan, 1.0], 0, "", 0),
            (6, [inf, 1.0], 0, "", 0), (7, [1.0, 0.0], None, "", 0), (None, [1.0, 0.0], 0, "", 0), (8, [1.0, 0.0], 0, "", 0),
            (9, [2.0, 0.0], 0, "", 0), (10, [1.0, 0.0], 0, "", 0), (10, [1.0, 0.0], 0, "", 0), (11, [1.0, 0.0], 1, "", 0),
            (12, [1.0], 0, "", 0), (13, [3.0], 0, "", 0), (14, [1e-30, 0.0], 0, "", 0), (15, [-1.0, -0.0], 0, "", 0),
            (16, [0.0, 1.0], 0, "", 0), (16, [-1.0, 0.0], 0, "", 0), (17, [0.0, 2.0], 0, "", 0)]
    check(spark, rows)


def test_threshold_is_met_exactly(spark):
    up = math.sqrt(1 - 0.93 ** 2)
    rows = [(0, [1.0, 0.0], 0, "", 0)] + [(i, [0.93, up * (1 + (i - 10) * 1e-7)], 0, "", 0) for i in range(1, 20)]
    check(spark, rows)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, E.op5_pca_tiles(spark, sf).collect()), key=repr) == brute(rows)
