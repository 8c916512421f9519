from __future__ import annotations

import math

import numpy as np

from pricetrail.llm import embedding_dedup as dedup

from .brute import least_reachable

SCHEMA = "vec_id long, embedding array<float>, label int, component string, node int"


def plain(rows, threshold=0.93):
    ok = [r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    linked = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    linked.append((i, j))
    group = least_reachable(range(len(rows)), linked)
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    number = [0] * len(rows)
    for i, j in linked:
        number[i] += 1
        number[j] += 1
    return sorted((str(r[0]), number[i], least.get(group[i]), r[0] is not None and r[0] == least.get(group[i])) for i, r in enumerate(rows))


def compare(spark, rows, **args):
    found = dedup.near_groups(spark.createDataFrame(rows, SCHEMA), **args).collect()
    assert sorted((str(r["id"]), r["n_links"], r["component"], r["kept"]) for r in found) == plain(rows)


def made(n=400, dim=8):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] * rng.uniform(0.5, 3) + rng.normal(size=dim) * rng.choice([0.01, 0.3, 1.0])
        rows.append((7 * i + 1, [float(x) for x in v.astype(np.float32)], [0, 0, 0, 1, 2, None][rng.integers(6)], "x", 1))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [nan] * dim, [inf] * dim, [-0.0] * dim, [1.0, 2.0], [2.0, 4.0], [1e-30] * dim, [1e30] * dim]
    rows += [(9000 + k, v, 0, "x", 1) for k, v in enumerate(odd)]
    rows += [(9500 + k, rows[3][1], rows[3][2], "x", 1) for k in range(40)] + [rows[5], (None, rows[6][1], rows[6][2], None, None)]
    return rows


def test_matches_all_pairs(spark):
    rows = made()
    compare(spark, rows)
    compare(spark, rows, block=9)  # many cells and blocks
    compare(spark, rows, block=9, fit_rows=30)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=16)
    rows = [(i, [float(x) for x in (v + 0.05 * rng.normal(size=16)).astype(np.float32)], 1, "x", 1) for i in range(600)]
    compare(spark, rows, block=50)


def test_empty_table(spark):
    assert dedup.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = dedup.op3_embedding_dedup(spark, sf).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == plain(rows)
