from __future__ import annotations

import pytest

from pricetrail.llm import line_dedup, mixing, simhash, toxicity

NAMES = ["__id", "__all", "__row", "__n", "__lines", "__kept", "__dropped", "__stay", "row", "id", "h", "fp", "component", "root", "words", "c1", "positive"]


@pytest.mark.parametrize("stage", [toxicity.filter_stage, line_dedup.dedup_stage, simhash.dedup_stage, mixing.mix_stage])
def test_columns_of_any_name_come_through(spark, stage):
    rows = [(i, f"text number {i} is its own. {'word ' * i}", "en", "s", 3, *[f"{n}{i}" for n in NAMES]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    found = out.collect()
    assert {r["doc_id"] for r in found} <= set(range(5)) and found
    for r in found:
        assert list(r)[5:] == [f"{n}{r['doc_id']}" for n in NAMES]
