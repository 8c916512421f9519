"""Ordered work gives the same rows whether a hot key is cut in segments or not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import changes, fx, monitoring
from pricetrail.sequences import KeyedSequence, cut_points

ROWS = 6000


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows belong to one listing, many of them at one instant."""
    n = F.col("id")
    return spark.range(ROWS).select(
        F.when(n % 3 == 0, F.lit(7)).otherwise(n % 40).cast("long").alias("listing_id"),
        n.alias("observation_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(n / 10) * 37).alias("scraped_at"),
        F.when(n % 11 == 0, "failed").when(n % 97 == 0, "removed").otherwise("ok").alias("outcome"),
        F.when(n % 11 == 0, F.when(n % 2 == 0, "extraction").otherwise("blocked")).alias("failure_kind"),
        (F.floor(n / 9) % 5 + 10).cast("decimal(18,4)").alias("price"),
        F.lit(None).cast("decimal(18,4)").alias("pix_price"),
        F.lit("BRL").alias("currency"),
        F.concat(F.lit("s"), (F.floor(n / 50) % 3).cast("string")).alias("seller"),
        F.when(n % 13 == 0, "out_of_stock").otherwise("in_stock").alias("availability"),
        (n % 13 != 0).alias("available"),
        (n % 5 == 0).alias("changed"),
    )


def same(a, b):
    columns = sorted(a.columns)
    left = sorted(str(r) for r in a.select(columns).collect())
    right = sorted(str(r) for r in b.select(columns).collect())
    assert left == right


def test_only_hot_keys_are_cut(hot):
    cuts = cut_points(hot, ["listing_id"], ["scraped_at", "observation_id"], 300).collect()
    assert [r["listing_id"] for r in cuts] == [7]
    assert 3 <= len(cuts[0]["__cuts"]) <= 12


def test_small_tables_are_not_cut(hot):
    assert not KeyedSequence(hot, ["listing_id"], ["scraped_at", "observation_id"]).cut


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_change_events(hot, parts):
    whole = changes.offer_events(hot)
    same(whole, changes.offer_events(hot.repartition(parts), cut_rows=300))


def test_streaks_and_marks(hot):
    same(changes.extraction_streaks(hot), changes.extraction_streaks(hot, cut_rows=300))
    rows = changes.with_previous_offer(hot)
    same(changes.change_marks(rows), changes.change_marks(rows, cut_rows=300))


def test_running_totals(hot):
    plain = KeyedSequence(hot, ["listing_id"], ["scraped_at", "observation_id"]).running({"total": F.col("price")}).result()
    cut = KeyedSequence(hot, ["listing_id"], ["scraped_at", "observation_id"], 300).running({"total": F.col("price")}).result()
    same(plain.select("observation_id", "total"), cut.select("observation_id", "total"))


def test_as_of(hot):
    events = hot.where("observation_id % 4 = 1").select("listing_id", F.col("observation_id").alias("id"), F.col("scraped_at").alias("detected_at"))
    shots = hot.where("observation_id % 4 = 2").select("listing_id", F.col("observation_id").alias("id"), "scraped_at", "price")
    same(changes.snapshot_as_of(events, shots), changes.snapshot_as_of(events, shots, cut_rows=300))


def test_recurrences(hot):
    visits = hot.select("listing_id", "observation_id", "scraped_at", "outcome", "available", "changed")
    same(monitoring.revisit_intervals(visits), monitoring.revisit_intervals(visits, cut_rows=300))
    requests = hot.select(
        F.col("listing_id").cast("string").alias("identity"), F.col("listing_id").cast("string").alias("host"),
        (F.col("observation_id") % 9).cast("string").alias("url"), F.col("observation_id").alias("request_id"), F.col("scraped_at").alias("at"),
    )
    same(monitoring.quota_audit(requests, 3, 600), monitoring.quota_audit(requests, 3, 600, cut_rows=300))
    same(monitoring.spacing_audit(requests, 900, 120), monitoring.spacing_audit(requests, 900, 120, cut_rows=300))


def test_last_accepted_rate(hot):
    rates = hot.select(
        F.lit("USD").alias("base_currency"), F.lit("BRL").alias("quote_currency"), F.col("listing_id").cast("string").alias("rate_type"),
        (F.col("price") / 2).cast("decimal(24,12)").alias("rate"), F.col("scraped_at").alias("fetched_at"), "observation_id",
    )
    order = ["fetched_at", "observation_id"]
    same(fx.accept_in_order(rates, order), fx.accept_in_order(rates, order, cut_rows=300))


def test_promotions(hot):
    obs = hot.select(
        "listing_id", F.col("scraped_at").alias("at"), F.col("observation_id").alias("seq"), F.lit("s").alias("sku"), F.lit("p").alias("product_id"),
        F.when(F.col("observation_id") % 3 != 1, F.struct(
            F.lit("active").alias("status"), monitoring.plus_seconds(F.col("scraped_at"), (F.col("observation_id") % 7) * 100 - 50).alias("expires_at"),
            F.lit("s").alias("sku"), F.lit("p").alias("product_id"),
        )).alias("promo"),
    )
    same(monitoring.promotion_transitions(obs), monitoring.promotion_transitions(obs, cut_rows=300))
