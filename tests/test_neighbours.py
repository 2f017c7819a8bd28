"""Exact and hashed neighbours against comparing all pairs, with copies, near copies and odd values."""

import numpy as np
import pytest

from fathomline.operators import matching


def brute(q, p, k):
    out = []
    for i, x in q:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in p)[:k]
        out += [(i, j, f"{w:.9g}", n + 1) for n, (w, j) in enumerate(d)]
    return sorted(out)


def rows(seed, n, first):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[n // 2 :] = x[0] + rng.integers(0, 3, (n - n // 2, 1)) * 1e-9  # nearer to each other than single precision tells
    x[-3:] = [[1e30] * 8, [0.0] * 8, [1e-30] * 8]
    return [(first + k, v.tolist()) for k, v in enumerate(x)]


@pytest.mark.parametrize("block", [16, 32768])
def test_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    monkeypatch.setattr(matching, "CELLS", 64)
    monkeypatch.setattr(matching, "PAIRS", 5)
    q, p = rows(1, 40, 0), rows(1, 50, 1000)
    left, right = spark.createDataFrame(q, "q bigint, vec array<double>"), spark.createDataFrame(p, "p bigint, vec array<double>")
    want = brute(q, p, 3)
    exact, hashed = ([(r["q"], r["p"], f"{r['distance']:.9g}", r["rank"]) for r in found.collect()] for found in (matching.nearest(left, right, 3), matching.nearest_by_hashes(left, right, 3, width=4.0)))
    assert sorted(exact) == want
    pairs = {x[:2] for x in want}
    assert len(hashed) == len(want) and len(pairs & {x[:2] for x in hashed}) >= 0.9 * len(want)


def test_a_bucket_makes_no_pairs(spark):
    """Rows of one large bucket gave a row for each pair; what leaves a bucket is k rows a query now."""
    same = spark.range(600).selectExpr("id", "array(1D, 2D, 3D) vec")
    found = matching.nearest_by_hashes(same.where("id % 2 = 1"), same.where("id % 2 = 0"), 2, qid="id", pid="id")
    assert {(r["p"], r["distance"]) for r in found.collect()} == {(0, 0.0), (2, 0.0)} and found.count() == 600
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
