"""Hard negatives against brute force, and the edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatledger.llm import hard_negatives as H
from chatledger.llm import queries

SCHEMA = "vec_id long, label int, embedding array<double>"
LONG = 2**63 - 1


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """Rows ``(vec_id, label, embedding)``, every hundredth vec_id an anchor."""
    made = []
    for vec_id, label, x in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v * 256) for v in x):
            continue
        made.append((vec_id, label, [math.floor(v * 256) for v in x]))
    out = []
    for k, (anchor, label, q) in enumerate(made):
        if anchor % 100:
            continue
        scored = [
            (max(-LONG, min(LONG, sum(a * b for a, b in zip(q, v)))), other, name == label)
            for i, (other, name, v) in enumerate(made) if i != k
        ]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(anchor, positive, rank, other, p, s) for rank, (s, other, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    made = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit("x")).withColumn("cell", F.lit(2.5))
    return sorted(tuple(r) for r in H.mine(made, F.col("vec_id") % 100 == 0, **options).collect())


def clustered(rng, n, size, spread):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.randrange(12)
        label = c % 4 if rng.random() < 0.8 else rng.randrange(4)
        rows.append((i, label, [x + rng.gauss(0, spread) for x in centres[c]]))
    return rows


@pytest.mark.parametrize("size,spread", [(6, 0.1), (16, 1.0)])
def test_mining_equals_brute_force(spark, monkeypatch, size, spread):
    # A small probe and small chunks, so that every later visit matters.
    monkeypatch.setattr(H, "PROBE", 20)
    monkeypatch.setattr(H, "CHUNK", 50)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 3)
    rng = random.Random(size)
    rows = clustered(rng, 1500, size, spread)
    found = mined(spark, rows, codes=8)
    assert found == brute(rows) and len(found) > 100


def test_certified_visits_skip_distant_cells():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 256, (16, 8))
    near = rng.integers(0, 16, 4000)
    rows = np.rint(centres[near] + rng.normal(0, 4, (4000, 8)))
    halves = H._fit(rows[:, :4], 16), H._fit(rows[:, 4:], 16)
    (i, d1), (j, d2) = H._nearest(rows[:, :4], halves[0]), H._nearest(rows[:, 4:], halves[1])
    counts, radii = np.zeros((16, 16), np.int64), (np.zeros((16, 16)), np.zeros((16, 16)))
    np.add.at(counts, (i, j), 1)
    np.maximum.at(radii[0], (i, j), d1)
    np.maximum.at(radii[1], (i, j), d2)
    index = H.Index(8, halves, counts, radii)
    q = rows[0]
    exact = rows @ q
    first, second, high, low, _ = index.bounds(q)
    assert (high[i, j] >= exact).all() and (low[i, j] <= exact).all()
    bounds = [b for b, *_ in H.best_cells(first, second)]
    assert bounds == sorted(bounds, reverse=True) and len(bounds) == 256
    limit = np.sort(exact)[-5]
    visited = list(H._rest_of_positives(index, q, {"limit": limit})) + list(H._probe_positives(index, q, {}))
    seen = sum(counts[c] for c in visited)
    assert set(zip(i[exact >= limit], j[exact >= limit])) <= set(visited) and seen < 2500


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rng = random.Random(9)
    unit = [0.5, -0.25, 0.75]
    rows = [(100, 1, unit)] * 3 + [(i, i % 3, unit) for i in range(1, 60)]
    rows += [(100, 2, [0.1, 0.2, 0.3]), (200, 2, []), (201, 2, [0.0]), (202, 0, [1.0]), (300, 7, [1.0, 0.0, 0.0]), (301, 7, [-1.0, 0.0, 0.0, 2.0])]
    rows += [(400, None, unit), (None, 1, unit), (401, 1, None), (402, 1, [0.1, None]), (403, 1, [float("nan")]), (404, 1, [float("inf"), 1.0])]
    rows += [(i, i % 3, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(500, 560)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(10)
    rows = [(i, i % 2, [rng.randrange(-(2**40), 2**40) / 256 for _ in range(3)]) for i in range(0, 120, 4)]
    rows += [(i, i % 2, [float(rng.choice([1e15, -1e15, 3e14])), 2.0**50]) for i in range(1, 60, 3)]
    rows += [(900, 0, [1e307, 1.0])]
    assert mined(spark, rows) == brute(rows)


def test_empty_table_and_lonely_labels(spark, tmp_path):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0]), (1, 2, [1.0])]) == []
    spark.createDataFrame([(7, 9, [1.0]), (100, 0, [1.0]), (3, 4, [0.5])], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = [tuple(r) for r in queries.op12_hard_negatives(spark, str(tmp_path)).collect()]
    assert found == [(100, 7, 1, 3, 65536, 32768)]
