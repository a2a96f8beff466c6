"""op11 against a plain search over all rows, with nulls, ties, repeated rows and small blocks."""

import math

import numpy as np
import pytest

from ledgerloom.llm import negatives

FIELDS = "vec_id long, label int, embedding array<float>, rank int, score string, anchor string"


def plain(rows, every, positives=5, k=3):
    rows = [(i, l, [math.floor(256 * float(x)) for x in e]) for i, l, e in rows if i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, l, e) in enumerate(rows):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(e, f)), j, m == l) for k_, (j, m, f) in enumerate(rows) if k_ != n and len(e) == len(f)]
        scored.sort(key=lambda x: x[:2])
        for p, pid, _ in [x for x in scored if x[2]][:positives]:
            fit = [(s, j) for s, j, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p][:k]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], FIELDS)
    got = negatives.hard_negatives(df, f"vec_id % {every} = 0", **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n, dim=6, labels=3, near=0.4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dim))
    x = centers[rng.integers(0, 4, n)] + near * rng.normal(size=(n, dim))
    return [(i, int(rng.integers(0, labels)), [float(v) for v in (row / np.linalg.norm(row)).astype(np.float32)]) for i, row in enumerate(x)]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 16}), (3, {"block": 7, "positives": 2, "negatives": 5})])
def test_equals_search_over_all_rows(spark, seed, options):
    rows = vectors(seed, 150)
    assert mined(spark, rows, 10, **options) == plain(rows, 10, options.get("positives", 5), options.get("negatives", 3))


def test_nulls_ties_and_repeated_rows(spark):
    rows = vectors(4, 40, dim=3)
    rows += [rows[3]] * 6 + rows[10:14] + [(20, 1, rows[20][2]), (20, 2, rows[5][2])]  # repeated rows and ids
    rows += [(50, None, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (60, 1, None), (70, 1, []), (80, 1, [1.0, None, 0.0]), (90, 1, [float("nan"), 0.0, 0.0]), (100, 1, [float("inf"), 0.0, 0.0])]
    rows += [(110, 1, [0.0, 0.0, 0.0]), (120, 1, [0.5, 0.5]), (130, 2, [0.5, 0.25]), (-10, 0, [0.5, 0.5, 0.1])]
    assert mined(spark, rows, 10, block=20) == plain(rows, 10)


def test_large_components_stay_exact(spark):
    rows = [(0, 1, [3.0e9, 1.0]), (1, 1, [3.0e9, 2.0]), (2, 2, [2.0e9, 3.0]), (3, 2, [2.5e9, 0.5])]
    assert len(mined(spark, rows, 4)) <= 2  # products beyond a long are cut to its range
    rows = [(0, 1, [5.0e4, 1.0]), (1, 1, [5.0e4, 2.0]), (2, 2, [3.0e4, 3.0]), (3, 2, [4.0e4, 0.5])]
    assert mined(spark, rows, 4) == plain(rows, 4)


def test_one_label_and_one_vector_hold_most_rows(spark):
    common = [0.6, 0.8, 0.0, 0.0, 0.0, 0.0]
    rows = vectors(5, 60) + [(1000 + i, 0, common) for i in range(80)]
    assert mined(spark, rows, 20, block=32) == plain(rows, 20)


def test_empty_and_alone(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, 1, [1.0, 0.0])], 10) == []
    assert mined(spark, [(0, 1, [1.0, 0.0]), (1, 2, [0.8, 0.1])], 10) == []  # no positive


def test_slots_keep_their_best():
    kept = negatives.Kept(2, 2, 2)
    kept.add(np.array([0, 0, 0, 3, 0]), np.array([5, 9, 9, 1, 2]), np.array([1, 4, 3, 7, 8]))
    at, score, ids = kept.cut()
    assert (at.tolist(), score.tolist(), ids.tolist()) == ([0, 0, 3], [9, 9, 1], [3, 4, 7])
    kept.add(np.array([0, 0]), np.array([9, 8]), np.array([2, 1]))
    at, score, ids = kept.cut()
    assert (score.tolist(), ids.tolist()) == ([9, 9, 1], [2, 3, 7])
