"""Work that is heavy per row runs on all cores, and plans do not grow with how often rules mention a value."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetrail.functions import titles
from pricetrail.operators import catalog, matching
from pricetrail.session import spread


def analysed(frame) -> str:
    return frame._jdf.queryExecution().analyzed().toString()


def test_spread_deals_one_partition_over_all_cores(spark):
    rows = spark.range(0, 1000, 1, 1)
    assert rows.rdd.getNumPartitions() == 1
    dealt = spread(rows)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert dealt.agg(F.count("*"), F.sum("id")).first()[:] == (1000, 499500)


def test_title_is_folded_once(spark):
    rows = spark.createDataFrame([("Oferta: SSD Samsung (MZ-V9S1T0B/AM) sem fio",), (None,)], "title string")
    made = rows.select(titles.normalize_title(F.col("title")).alias("t"))
    assert analysed(made).count("translate(") == 1
    assert [r["t"] for r in made.collect()] == ["ssd samsung mzv9s1t0bam wireless", None]


def test_condition_of_an_offer_is_read_once(spark):
    rows = spark.createDataFrame([("iPhone Renewed Premium AT&T", {}), ("iPhone", {"condition": "Renewed Premium"})], "title string, metadata map<string,string>")
    made = rows.select(catalog.commercial_metadata(F.col("title"), F.col("metadata")).alias("m"))
    assert analysed(made).count("translate(") <= 8
    assert [r["m"] for r in made.collect()] == [
        {"condition": "renewed", "condition_grade": "premium", "carrier": "at&t"}, {"condition": "Renewed Premium", "condition_grade": "premium"}
    ]


def test_equal_requests_are_scored_once(spark, monkeypatch):
    scored = []
    score = matching.score_pairs
    monkeypatch.setattr(matching, "score_pairs", lambda pairs, **given: scored.append(pairs.count()) or score(pairs, **given))
    products = spark.createDataFrame(
        [("p1", None, "Apple iPhone 16 128GB Black", "Apple", "iPhone 16", None), ("p2", "other", "Apple iPhone 16 128GB Black", "Apple", "iPhone 16", None),
         ("p3", None, "Apple iPhone 16 256GB Black", "Apple", "iPhone 16", None)],
        "id string, owner_user_id string, title string, brand string, model string, attributes map<string,string>",
    )
    requests = spark.range(20).select(
        F.col("id").cast("string").alias("request_id"), F.lit("me").alias("viewer_id"), F.lit(False).alias("is_admin"), F.lit("shop").alias("store"), F.lit("BR").alias("country"),
        F.lit("Apple iPhone 16 128 GB Preto").alias("title"), F.lit("Apple").alias("brand"), F.lit("iPhone 16").alias("model"),
        *[F.lit(None).cast("string").alias(c) for c in ("variant", "category", "gtin")],
    )
    codes = spark.createDataFrame([], "product_id string, type string, value_normalized string")
    listings = spark.createDataFrame([], "canonical_product_id string, store string, country string, status string")
    found = catalog.identity_matches(requests, products, codes, listings).collect()
    assert {(r["cand_id"], r["ref_id"], r["decision"]) for r in found} == {(str(k), "p1", "auto_match") for k in range(20)}
    assert scored == [1]
