from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from pricetrail.llm import quality

SCHEMA = "doc_id long, text string, key string, kept int"


def corpus():
    rng = random.Random(7)
    rows, good = [], []
    for i in range(600):
        fine = rng.random() < 0.7
        words = rng.choices("the house of a river and its bank is old".split(), k=rng.choice([8, 50, 300]))
        rows.append((i, " ".join(words) if fine else " ".join(w.upper() + "!!" for w in words), "x", 1))
        if fine:
            good.append(i)
    return rows, good


def plain_weights(rows, target):
    """The same models with dictionaries of buckets."""
    grams = quality.Grams()
    found = {i: grams((t or "").encode()).tolist() for i, t, *_ in rows}
    raw, own = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t, *_ in rows:
        for g in found[i]:
            raw[g] += 1
            own[g] += i in target
    a, n = quality.SMOOTHING, quality.BUCKETS
    return {i: sum(math.log((own[g] + a) / (own.sum() + a * n)) - math.log((raw[g] + a) / (raw.sum() + a * n)) for g in found[i]) for i in found}


def test_weights_and_sample_match_a_plain_loop(spark):
    rows, good = corpus()
    odd = [(1000, None, "", 1), (1001, "", "", 1), (1002, "river bank " * 150_000, "", 1), (1003, " \n", "", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    target = spark.createDataFrame([(i,) for i in good if i % 2] + [(None,)], "doc_id long")
    got = quality.resample(docs, target, 0.6).collect()
    want = plain_weights(rows + odd, {i for i in good if i % 2})
    keys = {}
    for i, w in want.items():
        u = (int(hashlib.md5(f"importance:{i}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
        keys[i] = w - math.log(-math.log(min(u, 1 - 2.0**-53)))
    for r in got:
        assert r["log_weight"] == pytest.approx(want[r["id"]], rel=1e-9, abs=1e-9)
        assert r["key"] == pytest.approx(keys[r["id"]], rel=1e-9, abs=1e-9)
    k = round(0.6 * len(keys))
    assert {r["id"] for r in got if r["kept"]} == set(sorted(keys, key=keys.get)[-k:])
    kept = {r["id"] for r in got if r["kept"]}
    assert len(kept & set(good)) >= 0.85 * k - len(odd)


def test_bigrams_cross_slices(monkeypatch):
    from pricetrail.llm import common

    text = " ".join(f"w{i % 50}" for i in range(3000)).encode()
    want = sorted(quality.Grams()(text))
    monkeypatch.setattr(common.slices, "__defaults__", (100,))
    assert sorted(quality.Grams()(text)) == want and len(want) == 5999


def test_kth_largest(spark, monkeypatch):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1)), rng.expovariate(0.001)]) for _ in range(3000)]
    rows = spark.createDataFrame([(float(v),) for v in values], "key double")
    for few in (50_000, 300):
        monkeypatch.setattr(quality, "FEW", few)
        for k in (1, 2, 700, 1500, 2999, 3000):
            assert quality.kth_largest(rows, "key", k) == sorted(map(float, values))[-k]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1), (None, "c", "", 1), (1, "a b", "", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long")
    got = quality.resample(docs, none, 1.0).collect()
    assert [(r["log_weight"], r["kept"]) for r in got] == [(0.0, True)] * 3
    assert not any(r["kept"] for r in quality.resample(docs, none, 0.0).collect())
    assert quality.resample(docs.limit(0), none, 0.5).collect() == []


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op2_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in tested) >= 0.97 * len(tested)


def test_rows_without_an_id_draw_each_by_its_text(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(50)] + [(None, None)], "doc_id long, text string")
    found = quality.resample(docs, docs, 0.5).collect()
    assert len({r["key"] for r in found}) == 51 and sum(r["kept"] for r in found) == round(51 * 0.5)
