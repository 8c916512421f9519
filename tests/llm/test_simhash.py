from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from pricetrail.llm import simhash
from pricetrail.llm.components import components

from .brute import least_reachable

SCHEMA = "doc_id long, text string, component string, fp int, lo int"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "ÉTÉ", "naïve x"]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 60, 300]))] for _ in range(25)]
    made = [" ".join(b) for b in base]
    for b in base[:15]:  # near copies
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = "Changed"
            made.append("\t".join(c))
    return made + [made[0], made[0].upper(), "", " \n", None, "x", "x y", "long " * 70_000]


def test_groups_match_brute_force(spark):
    rows = [(i * 3, t, "clash", 1, 2) for i, t in enumerate(texts())]
    rows += [rows[4], (None, rows[4][1], None, None, None)]
    want_fp = [plain_fingerprint(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    linked = [(i, j) for i, j in combinations(range(len(rows)), 2) if (want_fp[i] ^ want_fp[j]).bit_count() <= 4]
    group = least_reachable(range(len(rows)), linked)
    least = {}
    for i, g in group.items():
        if ids[i] is not None:
            least[g] = min(least.get(g, ids[i]), ids[i])
    want = sorted((str(ids[i]), f"{want_fp[i]:016x}", least.get(group[i])) for i in range(len(rows)))
    for tile in (4, simhash.TILE):
        found = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA), tile=tile)
        got = found.select("id", simhash.hex16().alias("fp"), "component").collect()
        assert sorted((str(r["id"]), r["fp"], r["component"]) for r in got) == want


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stage_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g", None, 0, 0), (2, "A B C D E F G", None, 0, 0), (3, "quite another text than these", None, 0, 0), (3, "quite another text than these", None, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_close_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    b = a ^ np.uint64(0b1011)
    i, j = simhash.close_pairs(a, b, 3, step=7)
    assert {(int(x), int(y)) for x, y in zip(i, j, strict=True)} == {(x, y) for x in range(50) for y in range(50) if (int(a[x]) ^ int(b[y])).bit_count() <= 3}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(90)]
    root = least_reachable({n for p in pairs for n in p}, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    got = components(spark.createDataFrame([*pairs, (None, 4)], "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["root"] for r in got} == {n: r for n, r in root.items() if n != r}
    assert linked >= {r["node"] for r in got}
