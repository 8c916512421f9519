from __future__ import annotations

import math
import random

import numpy as np

from pricetrail.llm import toxicity

SCHEMA = "doc_id long, text string, score string, features int"
CLEAN = [f"{a}{b}" for a in "the ing tion ouer lan".split() for b in "ka ro mi ne su ta vo".split()]
BAD = ["vilefoul", "nastyrot", "grimcur"]


def corpus(n=900):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.choice([5, 60, 400]))
        toxic = rng.random() < 0.2
        if toxic:
            for w in rng.sample(BAD, rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), "x", 1))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
        docs[-1] = docs[-1] + (toxic,)
    return docs, labels


def test_learns_from_positives_and_unlabelled(spark):
    docs, labels = corpus()
    table = spark.createDataFrame([d[:4] for d in docs], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table.where("doc_id % 4 != 0"), marks.where("doc_id % 4 != 0"))
    assert 0 < len(model.weights) < 200
    got = {r["id"]: r["score"] for r in toxicity.score(table, model).collect()}
    tested = [d for d in docs if d[0] % 4 == 0]
    assert sum((got[d[0]] >= 0.5) == d[4] for d in tested) >= 0.97 * len(tested)
    odd = [(1, None, "", 0), (2, "", "", 0), (3, "thetaka " * 100_000 + "VILEFOUL nastyrot grimcur", "", 0), (None, "thetaka", "", 0), (3, "x", "", 0)]
    scores = [r["score"] for r in toxicity.score(spark.createDataFrame(odd, SCHEMA), model).orderBy("id", "score").collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert scores[-1] >= 0.5 and max(scores[:-1]) < 0.5
    # one feature set after the other gives the same score
    reader = toxicity.Reader()
    for d in docs[:40]:
        z = model.bias + sum(model.weights.get(f, 0.0) for f in reader(d[1].encode()))
        assert math.isclose(got[d[0]], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_risk_turns_where_it_is_negative():
    rng = np.random.default_rng(0)
    pos = [np.array([0]) for _ in range(200)]
    unl = [np.array([0]) if rng.random() < 0.3 else np.array([1]) for _ in range(600)]
    w, b = toxicity.nnpu(pos, unl, np.ones(2), 0.3)
    assert w[0] + b > 0 > w[1] + b


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_stage_keeps_clean_documents_whole(spark, monkeypatch):
    f = toxicity.word_features("vilefoul")[0]
    monkeypatch.setattr(toxicity, "learned", lambda *_: toxicity.Model(-3.0, {f: 9.0}))
    rows = [(1, "fine words", "s", 3), (2, "so VILEFOUL, that", "s", 3), (None, None, None, None), (1, "fine words", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = toxicity.filter_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] != 2)


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    hits = sum(r["predicted"] == 1 == truth[r["doc_id"]] for r in got)
    assert hits >= 0.85 * sum(truth[r["doc_id"]] for r in got)
    assert hits >= 0.95 * sum(r["predicted"] for r in got)
