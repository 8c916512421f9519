from __future__ import annotations

from pricetrail.llm import simhash

SCHEMA = "doc_id long, text string, n_chars long"


def text(name):
    return " ".join(f"{name}{k * k}" for k in range(60))


def test_rows_are_chosen_by_their_texts(spark):
    a, b, c, d, e = map(text, "abcde")
    rows = [(1, b), (5, a), (5, b), (None, c), (None, d), (None, b), (None, d), (7, e), (None, e), (7, e)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], SCHEMA)
    for layout in (docs.repartition(5), docs.coalesce(1)):
        out = simhash.dedup_stage(spark, layout, "")
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"][0]) for r in out.collect()]
        assert sorted(got, key=str) == sorted([(1, "b"), (5, "a"), (None, "c"), (None, "d"), (7, "e")], key=str)
