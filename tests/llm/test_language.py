from __future__ import annotations

import random
import zlib

import pytest

from pricetrail.llm import language

SCHEMA = "doc_id long, text string, lang string, score int, accepted string"
SYLLABLES = {"aa": "the ing tion er ou wh", "bb": "sch ung heit keit ver ein", "cc": "ción mente ado ñ los ll"}


def words(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = []
    for i in range(240):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        made.append((i, words(rng, lang, rng.choice([3, 40, 900])), lang, 7, "x"))
    return made


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs.where("doc_id % 5 != 0"))
    assert sorted(lang for lang, _ in model.content) == ["aa", "bb", "cc"] and model.content[0][0] == "aa"
    got = {r["id"]: r for r in language.identify(docs, model).collect()}
    assert len(got) == len(rows)
    tested = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[r[0]]["lang"] == r[2] for r in tested) >= 0.95 * len(tested)
    # the same rows, one after the other
    compressors = model.compressors()
    assert all((got[r[0]]["lang"], got[r[0]]["score"], got[r[0]]["margin"]) == language.classify(r[1].encode(), compressors) for r in rows)


def test_odd_texts(spark, rows):
    model = language.fit(spark.createDataFrame(rows, SCHEMA))
    odd = [(1, None, None, 1, ""), (2, "", "aa", 1, ""), (3, " \n12 ---", "aa", 1, ""), (None, "the ing", "aa", 1, ""), (5, "LOS CIÓNMENTE ÑADO LL " * 40_000, None, 1, ""), (5, "LOS CIÓNMENTE ÑADO LL " * 40_000, None, 1, ""), (6, "ß", None, 1, "")]
    got = language.identify(spark.createDataFrame(odd, SCHEMA), model).collect()
    assert len(got) == len(odd)
    by = {r["id"]: r for r in got}
    assert [by[k]["lang"] for k in (1, 2, 3)] == ["und"] * 3 and not any(by[k]["accepted"] for k in (1, 2, 3))
    assert by[5]["lang"] == "cc" and by[5]["accepted"]
    assert by[6]["lang"] != "und" and not by[6]["accepted"]


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    model = language.fit(none)
    assert model.content == ()
    assert language.identify(none, model).collect() == []
    assert {r["lang"] for r in language.identify(spark.createDataFrame(rows[:4], SCHEMA), model).collect()} == {"und"}


def test_query_on_table(spark):
    got = language.op9_language(spark, "/root/testdata/sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    tested = [r for r in got.collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in tested)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in tested) >= 0.97 * len(tested)
