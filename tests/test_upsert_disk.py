"""Upserts of listings: what is shuffled goes once it has been read, and the rows are those of the whole batch."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import catalog
from pricetrail.plans import resolution
from pricetrail.schema import CONFIDENCE

NAMES = ("store", "country", "product_id", "sku", "canonical_url")
LISTINGS = [("b", "shop", "BR", "1", "X", "https://s/1/"), ("a", "shop", "BR", "1", "X", "https://s/1"), ("c", "shop", "BR", "2", "Y", "https://s/2"), ("d", "shop", None, "3", " ", None)]
REQUESTS = [
    (1, "shop", "BR", "9", "X", "HTTPS://S/2/?utm_source=a#b"), (2, "shop", "BR", "2", "X", None), (3, "shop", "BR", "9", "X", " "), (4, "shop", "BR", "1", None, "https://s/1/"),
    (5, "shop", "BR", "3", " ", None), (6, None, "BR", "1", "X", "https://s/1"), (7, "shop", "BR", "1", "Y", None), (7, "shop", "BR", "9", None, "https://s/2"), (None, "shop", "BR", "1", "X", "https://s/1"),
]
TEXTS = ", ".join(f"{c} string" for c in NAMES)


def counted_keys(monkeypatch):
    ranks, keys = [], catalog._listing_keys
    monkeypatch.setattr(catalog, "_listing_keys", lambda rows, name, *a: ranks.append(a) or keys(rows, name, *a))
    return ranks


@pytest.mark.parametrize("most", [10_000_000, 1])
def test_listings_found_in_turn_are_those_found_at_once(spark, monkeypatch, most):
    monkeypatch.setattr(catalog, "LISTINGS_A_PASS", most)
    have, asked = spark.createDataFrame(LISTINGS, f"id string, {TEXTS}"), spark.createDataFrame(REQUESTS, f"request_id long, {TEXTS}")
    have = have.unionByName(have.withColumns({"id": F.concat(F.lit("o"), "id"), "store": F.concat(F.lit(" other"), "store")}))
    asked = asked.unionByName(asked.withColumns({"request_id": F.col("request_id") + 10, "store": F.concat(F.lit("other"), "store")}))
    rows = lambda found: sorted(tuple(r) for r in found.where("request_id is not null").collect())
    found = rows(catalog.find_listings_in_turn(asked, have))
    assert found == rows(catalog.find_listings(asked, have))
    first = [(1, "c", 1), (2, "c", 2), (3, "a", 3), (4, "a", 1), (7, "c", 1)]
    assert found == first + [(n + 10, f"o{i}", by) for n, i, by in first]


def test_keys_of_a_kind_are_dealt_only_for_what_is_not_found(spark, monkeypatch):
    have = spark.createDataFrame(LISTINGS, f"id string, {TEXTS}")
    ranks = counted_keys(monkeypatch)
    found = catalog.find_listings_in_turn(spark.createDataFrame(REQUESTS[:1] + REQUESTS[3:4], f"request_id long, {TEXTS}"), have)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "c", 1), (4, "a", 1)] and ranks == [((1,),)] * 2


def offer(store, product, title, url, status, parent, leave, seq, request):
    return (parent, store, "BR", product, "", None, url, url, title, "review", None, status, leave, seq, request)


BATCH = f"canonical_product_id string, store string, country string, product_id string, sku string, gtin string, url string, canonical_url string, title string, decision string, confidence {CONFIDENCE.simpleString()}, status string, allow_reparent boolean, seq long, request_id long"


def test_upserted_rows_are_the_last_of_each_listing(spark):
    listings = spark.createDataFrame([(i, f"p{i}", *x, None, x[4], "old", "auto_match", None, "active") for i, *x in LISTINGS], f"id string, canonical_product_id string, {TEXTS}, gtin string, url string, title string, match_decision string, confidence {CONFIDENCE.simpleString()}, status string")
    rows = [
        offer("shop", "1", "", "https://s/1", "early", "pa", None, 1, 1), offer("shop", "1", "late", "https://s/1", "late", "pa", None, 2, 2),
        offer("shop", "2", "no", "https://s/2", "other parent", "px", False, 3, 3), offer("shop", "7", "n7", None, "seven", "p7", None, None, None), offer("shop", "8", "n8", None, "eight", "p8", None, None, None),
        offer("shop", "10", "n10", None, "ten", "p10", None, 5, 9), offer("shop", "11", "n11", None, "eleven", "p11", None, 5, 9), offer("shop", "11", "n11", None, "eleven", "p11", None, 5, 9),
    ]
    new = lambda product: hashlib.sha256(f"shop|BR|{product}".encode()).hexdigest()
    expected = {("a", "pa", "late", "late"), ("b", "pb", "active", "old"), ("c", "pc", "active", "old"), ("d", "pd", "active", "old")}
    expected |= {(new(7), "p7", "seven", "n7"), (new(8), "p8", "eight", "n8"), (new(10), "p10", "ten", "n10"), (new(11), "p11", "eleven", "n11")}
    given = spark.createDataFrame(rows, BATCH)
    for batch in (given, given.drop("request_id")):
        after = catalog.upsert_listings(listings, batch, F.timestamp_seconds(F.lit(100)))
        got = [(r["id"], r["canonical_product_id"], r["status"], r["title"]) for r in after.collect()]
        assert set(got) == expected and len(got) == len(expected)


def test_upsert_shuffles_links_alone_and_only_columns_that_are_read(spark, monkeypatch, tmp_path):
    spark.range(400).select(
        (F.col("id") % 200).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit("F").alias("l_linestatus"), F.col("id").alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"),
        F.when(F.col("id") % 3 == 0, "R").otherwise("A").alias("l_returnflag"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    ranks = counted_keys(monkeypatch)
    after = resolution.upsert_listings(spark, str(tmp_path))
    assert ranks == [((1,),)] * 2
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert "item/" not in plan and "max_by" not in plan
    last = {k % 200: k * 10 + k % 7 for k in range(0, 400, 3)}
    assert after.count() == 200 and after.where("status = 'review'").count() == sum(seq % 3 != 1 for seq in last.values()) > 0
