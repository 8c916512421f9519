"""Work over ordered and keyed rows: one shuffle where one is enough, and tasks whose rows do not grow with the table."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pricetrail import session
from pricetrail.operators import candidates, catalog
from pricetrail.plans import resolution
from pricetrail.schema import PAYLOAD


def exchanges(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


HITS = [("s", 1, "a"), ("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("s", 4, None), ("s", None, "c"), (None, 1, "a"), ("t", 5, "a"), ("t", 6, "b"), ("t", 7, "c"), ("t", 8, "b")]
FIRSTS = [("s", 1, "a", 1), ("s", 1, "a", 2), ("s", 3, "b", 3), ("t", 5, "a", 1), ("t", 6, "b", 2), ("t", 7, "c", 3)]


@pytest.mark.parametrize("cut", ["5000000", "2"])
def test_firsts_of_a_search_take_one_shuffle(spark, cut):
    hits = spark.createDataFrame(HITS, "search string, rank int, id string")
    spark.conf.set("pricetrail.sequence.cutRows", cut)
    try:
        found = candidates.first_of_each(hits, ["search"], F.col("id"), within=hits)
    finally:
        spark.conf.unset("pricetrail.sequence.cutRows")
    assert sorted(found.select("search", "rank", "id", "place").collect()) == FIRSTS
    if cut == "5000000":
        assert exchanges(found) == 1


def test_rows_of_a_barcode_task_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10, raising=False)
    hits = spark.range(400).select(
        (F.col("id") % 100).alias("ref_id"), F.col("id").alias("seq"), F.lit("s").alias("store"), F.when(F.col("id") % 100 < 50, "auto_match").otherwise("review").alias("decision"),
        F.lit("789-1991010863").alias("gtin"), F.lit("Acme Corp").alias("brand"),
    )
    refs = spark.range(100).select(F.col("id").alias("ref_id"), F.lit(None).cast("string").alias("gtin"), F.lit("acme").alias("brand"))
    found = candidates.running_gtin(refs, hits)
    assert found.rdd.getNumPartitions() >= 40
    assert {tuple(r) for r in found.groupBy("learned", "learned_from").count().collect()} == {("7891991010863", "auto_match:s", 200), (None, None, 200)}
    assert set(found.columns) == {"ref_id", "seq", "store", "decision", "gtin", "brand", "learned", "learned_from"}


LISTINGS = [("b", "shop", "BR", "1", "X", "https://s/1/"), ("a", "shop", "BR", "1", "X", "https://s/1"), ("c", "shop", "BR", "2", "X", "https://s/2"), ("d", "shop", None, "3", " ", None)]
REQUESTS = [(1, "shop", "BR", "9", "X", "HTTPS://S/2/?utm_source=a#b"), (2, "shop", "BR", "2", "X", None), (3, "shop", "BR", "9", "X", " "), (4, "shop", "BR", "1", None, "https://s/1/"), (5, "shop", "BR", "3", " ", None), (6, None, "BR", "1", "X", "https://s/1")]


def test_listings_are_found_by_keys_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 1, raising=False)
    names = "store string, country string, product_id string, sku string, canonical_url string"
    have, asked = spark.createDataFrame(LISTINGS, "id string, " + names), spark.createDataFrame(REQUESTS, "request_id long, " + names)
    found = catalog.find_listings(asked, have)
    assert sorted(tuple(r) for r in found.select("request_id", "listing_id", "found_by").collect()) == [(1, "c", 1), (2, "c", 2), (3, "a", 3), (4, "a", 1)]
    # listings and requests are shuffled once by key, and what they found once by request
    assert exchanges(found) == 3
    dealt = re.findall(r"hashpartitioning\(hash#\d+L, key#\d+, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and min(map(int, dealt)) >= 3 * len(LISTINGS)


def test_listing_ids_of_many_listings_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10, raising=False)
    spark.range(400).select((F.col("id") % 200).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit("F").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = resolution.listings(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 40
    assert made.where("match_decision = 'review'").count() == 200


def test_view_of_a_listing_carries_only_what_is_read(spark):
    listings = spark.createDataFrame([("1", "phone", "none", None), ("2", "phone renewed", "none", None), ("3", None, "none", None)], "id string, title string, promotion_status string, promotion_expires_at timestamp")
    payload = F.struct(*[(F.when(F.col("used"), "used") if f.name == "condition" else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields])
    shots = spark.createDataFrame(
        [("1", "a", 10.0, 5, True), ("1", "b", 20.0, 5, False), ("1", "c", 30.0, None, True), ("2", "d", 40.0, 1, False), (None, "e", 50.0, 1, False)],
        "listing_id string, id string, amount double, at long, used boolean",
    ).select(
        "listing_id", "id", F.col("amount").cast("decimal(18,4)").alias("price"), F.lit("BRL").alias("currency"), F.lit("the seller").alias("seller"), F.lit("in_stock").alias("availability"),
        F.lit(True).alias("available"), payload.alias("payload"), F.timestamp_seconds("at").alias("scraped_at"),
    )
    rates = spark.createDataFrame([], "base_currency string, quote_currency string, rate_type string, rate decimal(24,12), source string, fetched_at timestamp, status string")
    seen = catalog.listing_view(listings, shots, rates, F.timestamp_seconds(F.lit(100)))
    assert {"seller", "snapshot_id", "scraped_at", "pix_price"} <= set(seen.columns) and not [c for c in seen.columns if c.startswith("__") or c == "payload"]
    assert sorted((r["listing_id"], r["snapshot_id"], r["condition"]) for r in seen.collect()) == [("1", "b", None), ("2", "d", "renewed"), ("3", None, None)]
    assert "payload" not in seen._jdf.queryExecution().optimizedPlan().toString()
