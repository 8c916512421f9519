from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest

from pricetrail.llm import mixing

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken int, range string"


def rows():
    rng = random.Random(6)
    made = []
    for i in range(400):
        words = [rng.choice(["a", "word", "É", "##%%", "x.y"]) for _ in range(rng.choice([0, 1, 5, 80]))]
        made.append((i, rng.choice([" ", "\n", " \t"]).join(words), "en", rng.choice(["s1"] * 12 + ["S2", "é", "z", "", None, "tiny"]), 3, 1, "r"))
    made += [(1000, None, None, None, None, None, None), (1001, "", "en", "empty", 0, 1, "r"), (None, "no id here", "en", "z", 1, 1, "r"), made[5], made[5], (1002, "long " * 200_000, "en", "z", 1, 1, "r")]
    return made


def plain(rows):
    """The same mix, one document after the other."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size(r[1]) for r in by[s]) for s in order}
    budget, target, open_ = 1.5 * sum(total.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    out = []
    copies = defaultdict(int)
    for s in order:
        keyed = []
        for r in by[s]:
            t = r[1] or ""
            content = f"{'-' if r[0] is None else r[0]}:{hashlib.md5(t.encode()).hexdigest()}"
            w = max(0.05, sum(c not in mixing.MARKS for c in t) / len(t) if t else 0.0)
            u = (int(hashlib.md5(f"mix:{content}:{copies[s, content]}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
            copies[s, content] += 1
            keyed.append((-math.log(u) / w, -1 if r[0] is None else r[0], size(t)))
        epochs = target[s] // total[s] if total[s] else 0
        left = math.floor(target[s] - epochs * total[s])
        for _, i, n in sorted(keyed):
            own = min(left, n)
            left -= own
            out.append((i, n, total[s], round(target[s], 6), int(epochs * n + own)))
    return sorted(out)


def test_matches_a_plain_loop(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == plain(data)
    by = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(words - target) <= 1 for (_, target), words in by.items())


def test_reruns_agree_in_any_layout(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    one = sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert one == sorted(map(str, mixing.mix(docs.coalesce(1)).collect()))


def test_many_equal_rows_and_no_ids(spark):
    data = [(None, "the same words again", "en", "s", 1, 1, "")] * 500 + [(None, None, "en", "s", 1, 1, "")] * 300 + [(7, f"own {i}", "en", "s", 1, 1, "") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA).repartition(6)).collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == plain(data)
    extra = sum(r["taken"] > r["size"] for r in got if r["size"] == 4)
    assert 150 < extra < 350  # drawn one by one: not all or none of the equal rows


def test_stage_with_clashing_names(spark):
    data = [(1, "a b c", "en", "s", 5, "x", "y", "z", "w")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, __id string, __n string, row string, c1 string")
    got = mixing.mix_stage(spark, docs, "").collect()
    assert [r["text"] for r in got] == ["a b c", "a"] or sorted(r["text"] for r in got) == ["a", "a b c"]
    assert {tuple(r)[5:] for r in got} == {("x", "y", "z", "w")}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).collect() == []
    assert mixing.mix_stage(spark, none, "").collect() == []


def test_weights_decide(spark):
    docs = spark.createDataFrame([(i, "a " * 10, "en", "s", 1, 1, "") for i in range(2000)], SCHEMA)
    from pyspark.sql import functions as F

    got = mixing.mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).collect()
    extra = lambda rest: sum(r["taken"] > 10 for r in got if r["id"] % 2 == rest)
    assert extra(0) > 2 * extra(1) > 0 and extra(0) + extra(1) == pytest.approx(1000, abs=1)


def test_stage_repeats_documents(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    out = mixing.mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[-1 if r["doc_id"] is None else r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["taken"] in (1, None)
    want = defaultdict(int)
    for i, _, _, _, n in plain(data):
        want[i] += n
    assert dict(words) == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    path = f"/root/testdata/{sf}"
    assert oracle.compare(spark, oracle.connect(path), mixing.op10_mixing, mixing.OP10_SQL, path) is None


def test_no_python_in_the_plan(spark):
    plan = mixing.op10_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
