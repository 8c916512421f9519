from __future__ import annotations

import re

import corpus_pipeline
from pricetrail.llm import line_dedup, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == first.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append({"name": name, "rows": docs.collect()})
    source = {r["doc_id"]: r for r in first.collect()}
    toxic, lines, near, mix, packed = (s["rows"] for s in steps)

    # toxicity: what the operator rejects goes, all else stays as it is
    score = {r["doc_id"]: r["predicted"] for r in toxicity.op8_toxicity(spark, SF).collect()}
    assert sorted(map(tuple, toxic)) == sorted(tuple(r) for i, r in source.items() if not score[i])

    # line dedup: no folded line is left twice, no document gets another's line
    seen = set()
    before = {r["doc_id"]: r["text"] for r in toxic}
    for r in lines:
        own = [x for x in (x.strip(" \t\r\x0b\x0c").lower() for x in r["text"].split("\n")) if x]
        assert not seen & set(own) and len(own) == len(set(own)) and r["n_chars"] == len(r["text"])
        seen.update(own)
        assert own or not before[r["doc_id"]].strip()
        had = iter(before[r["doc_id"]].split("\n"))
        assert all(x in had for x in r["text"].split("\n")), "lines stay in order"

    # near duplicates: the least id of each group of what is left
    groups = {}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode()) for r in lines}
    ids = sorted(prints)
    root = {i: i for i in ids}
    for _ in ids:
        before_ = dict(root)
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = min(root[i], root[j])
        if root == before_:
            break
    groups = set(root.values())
    assert sorted(r["doc_id"] for r in near) == sorted(groups)

    # mixing: whole copies, and one cut one for each source at most
    texts = {r["doc_id"]: r["text"] for r in near}
    cut = [r for r in mix if r["text"] != texts[r["doc_id"]]]
    assert len({r["source"] for r in cut}) == len(cut)
    assert all(r["text"].split() == texts[r["doc_id"]].split()[: len(r["text"].split())] for r in cut)

    # packing: all words of the mix, each row's pieces without gaps
    assert sum(r["doc_tokens"] for r in packed if r["start"] == 0) == sum(r["length"] for r in packed)
    assert len([r for r in packed if r["start"] == 0]) == len(mix)


def test_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(re.fullmatch(r"\d+", str(r["sequence_id"])) for r in rows)
    assert line_dedup.SIMILARITY == 0.8
