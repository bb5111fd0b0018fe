"""Hard-negative mining against brute force, on random and on clustered vectors."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import comparable, duck
from pyspark.sql import functions as F

from casewright.llm import hardneg, queries

ROWS = "vec_id long, label int, embedding array<float>"


def brute(rows, anchor, positives=5, negatives=10):
    whole = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i in sorted({w[0] for w in whole if anchor(w[0])}):
        _, label, v = min(w for w in whole if w[0] == i)
        scored = sorted((-dot(v, w), j, own) for j, own, w in whole if j != i)
        near = [(j, -s) for s, j, own in scored if own == label][:positives]
        for j, p in near:
            found = [(n, -s) for s, n, own in scored if own != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(i, j, k, n, p, s) for k, (n, s) in enumerate(found, 1)]
    return sorted(out)


def mined(frame, anchor, **how):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardneg.mine(frame, anchor, **how).collect())


def clustered(n, seed, dim=8, clusters=12, noise=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 2
    at = rng.integers(0, clusters, n)
    return [(k, int(c if not noise else c % 4 if rng.random() < 0.8 else rng.integers(4)), (centres[c] + rng.normal(size=dim) * 0.2).tolist()) for k, c in enumerate(at)]


@pytest.mark.parametrize("how", [{}, {"leaf_rows": 40, "anchor_rows": 16}])
def test_against_brute_force(spark, how):
    """Clusters, ties of thousands of products, one very common vector, and a label of a single row."""
    rows = clustered(700, 3)
    rows += [(1000 + k, k % 3, [0.5] * 8) for k in range(300)] + [(2000, 77, [1.0] * 8), (2001, 78, [-1.0] * 8), (2010, 0, [0.0] * 8)]
    rng = random.Random(4)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    assert mined(frame, F.col("vec_id") % 10 == 0, **how) == brute(rows, lambda i: i % 10 == 0)


def test_pairs_of_nodes_are_dropped(spark, monkeypatch):
    """On separate clusters few of the block pairs are scored, and nothing is lost."""
    rows = [(k, int(c % 4), v) for k, c, v in clustered(3000, 5, clusters=20, noise=False)]
    shares = []
    whole = hardneg._scored

    def counted(pairs, anchors, leaves, *rest):
        shares.append(pairs.count() / (anchors.count() * leaves.count()))
        return whole(pairs, anchors, leaves, *rest)

    monkeypatch.setattr(hardneg, "_scored", counted)
    assert mined(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 5 == 0, leaf_rows=32, anchor_rows=16, positives=2, negatives=2) == brute(rows, lambda i: i % 5 == 0, 2, 2)
    assert len(shares) == 4 and shares[0] + shares[1] < 0.2 and shares[2] + shares[3] < 0.6


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(8)
    for scale in (3.0, 200.0, 3e5):
        rows = [(k, k % 3, (rng.normal(size=5) * scale).tolist()) for k in range(120)]
        assert mined(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 1, [None, 1.0]), (None, 1, [1.0, 1.0])]
    rows += [(8, 2, [0.5]), (9, 2, []), (2, 2, [0.5, 0.5]), (10, 1, [1.0, 0.5]), (10, 1, [0.0, 0.5]), (10, 3, [1.0, 0.5]), (20, 9, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS code", "1 AS blk", "1 AS leaf", "1 AS score", "1 AS v")
    assert mined(frame, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)
    assert hardneg.mine(frame.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_bands_by_row():
    scores = np.array([[5, 9, 9, 1, 9, 7], [0, 0, 0, 0, 0, 0]])
    r, c, place = hardneg.best_in_band(scores, np.array([[True] * 5 + [False], [False] * 6]), np.array([2, -1]), np.array([9, 3]), 2)
    assert (r.tolist(), c.tolist(), place.tolist()) == ([0, 0], [1, 2], [0, 1])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_its_oracle(spark, data, sf):
    folder = data.replace("sf0.001", sf)
    got = queries.op12_hard_negatives(spark, folder).toPandas()
    assert comparable(got) == comparable(duck(folder).sql(queries.oracle_sql()["op12_hard_negatives"]).df()) and len(got) > 100
