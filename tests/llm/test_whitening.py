from __future__ import annotations

import numpy as np
import pytest

from pricetrail.llm import whitening

SCHEMA = "id long, x array<long>, n int, component string"


def plain(vectors):
    """Mean, covariance and components by the textbook."""
    x = np.array(vectors, np.float64)
    mean = x.mean(axis=0)
    _, sigma, axes = np.linalg.svd(x - mean, full_matrices=False)
    return mean, sigma**2 / len(x), axes.T


def check(rows, found, most=32):
    vectors = [r[1] for r in rows]
    mean, values, axes = plain(vectors)
    k = min(most, int((values > 1e-19 * values[0]).sum()))
    by = {}
    for r in found:
        by.setdefault(r["id"], []).append(r)
    sign = None
    for row in rows:
        own = sorted(by[row[0]], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, k + 1))
        want = (np.array(row[1]) - mean) @ axes[:, :k] / np.sqrt(values[:k])
        got = np.array([r["whitened"] for r in own])
        if sign is None:
            sign = np.sign(got * want)
        assert np.allclose(got, want * sign, rtol=1e-7, atol=1e-7)
        sums = [sum(v[i] for v in vectors) for i in range(len(row[1]))]
        assert {r["deviation"] for r in own} == {sum((len(rows) * a - s) ** 2 for a, s in zip(row[1], sums))}
        assert {r["n"] for r in own} == {len(rows)}
        assert np.allclose([r["explained"] for r in own], values[:k] / values.sum(), rtol=1e-8)
        assert max(r["identity_error"] for r in own) < 1e-9


def test_against_the_covariance_itself(spark):
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * 20).astype(int) + 1_000_000
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_badly_conditioned_and_rank_deficient(spark):
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 6) * 0.8
    steep = np.round(rng.normal(size=(400, 6)) * scale * 1e5).astype(int) + 1_000_000
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(steep)]
    check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    few = rng.integers(-50, 50, size=(5, 12)) + 1_000_000  # at most four directions
    twice = np.hstack([few, few[:, :2] * 3, np.full((5, 1), 7)])  # columns that depend on others, and one that is constant
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(twice)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, found)
    assert max(r["component"] for r in found) == 4


def test_odd_rows(spark):
    vectors = [[1, 2], [1, 2], [3, 9], [5, 5], [], [4], [1, 2, 3], [4, 5, 7]]
    rows = [(None if i == 3 else i, v, 1, "c") for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert sorted((str(r["id"]), r["component"], r["n"]) for r in found) == sorted(
        [(i, c, 4) for i in ("0", "1", "2", "None") for c in (1, 2)] + [("6", 1, 2), ("7", 1, 2)]
    )
    same = spark.createDataFrame([(1, [5, 6], 1, "c"), (2, [5, 6], 1, "c")], SCHEMA)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(same.limit(0)).collect() == []
    far = [(i, [i * 2**44, -i], 1, "c") for i in range(4)]
    found = whitening.whiten(spark.createDataFrame(far, SCHEMA)).collect()
    assert {r["deviation"] for r in found} == {None}  # beyond a long
    assert len(found) == 4 and max(r["identity_error"] for r in found) < 1e-9


def test_query_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [None, [nan, 1.0], [inf, 1.0], [None, 1.0]]
    good = [[0.0, 0.0], [0.5, -0.25], [0.51, 1e-9], [-1.0, 3.0]]
    rows = [(i, v, 1, "c") for i, v in enumerate(odd + good)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = whitening.op12_whitening(spark, str(tmp_path)).collect()
    x = [(i + 4, [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v]) for i, v in enumerate(good)]
    got = [{"id": r["vec_id"], **{c: r[c] for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")}} for r in found]
    check(x, got)


def test_triangular_solve():
    rng = np.random.default_rng(2)
    r = np.triu(rng.normal(size=(7, 7))) + 3 * np.eye(7)
    rows = rng.normal(size=(20, 7))
    assert np.allclose(whitening.solve(rows, r) @ r, rows)
    assert whitening.factor(np.zeros((2, 2)) + np.eye(2), 10, True) == pytest.approx(np.eye(2), rel=1e-9)
