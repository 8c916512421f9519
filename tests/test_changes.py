"""Literal cases of change detection, schedules, rates and the feed."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetrail.functions import dates, money, redact, units, urls
from pricetrail.operators import changes, feed, fx, matching, monitoring, pages
from pricetrail.schema import PAYLOAD

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)
OBS = (
    "listing_id string, observation_id int, outcome string, failure_kind string, price decimal(18,4), pix_price decimal(18,4), "
    "currency string, seller string, availability string, available boolean, scraped_at timestamp"
)


def obs(n, outcome="ok", price="199.90", pix=None, seller="Kabum", availability="in_stock", available=True, kind=None):
    return ("a", n, outcome, kind, Decimal(price), None if pix is None else Decimal(pix), "BRL", seller, availability, available, T0 + timedelta(hours=n))


CASES = [
    ([obs(0)], ["new_offer"]),
    ([obs(0), obs(1)], ["unchanged"]),
    ([obs(0), obs(1, price="179.90")], ["price_changed"]),
    ([obs(0), obs(1, seller="Marketplace Seller")], ["seller_changed"]),
    ([obs(0), obs(1, seller=" KABUM ")], ["unchanged"]),
    ([obs(0), obs(1, availability="out_of_stock", available=False)], ["availability_changed", "out_of_stock"]),
    ([obs(0), obs(1, outcome="removed")], ["offer_removed"]),
    ([obs(0), obs(1, outcome="failed", kind="blocked")], ["scrape_failed"]),
    ([obs(0), obs(1, outcome="failed", kind="infra")], []),
    ([obs(0), obs(1, outcome="failed", kind="blocked"), obs(2)], ["unchanged"]),
    ([obs(0), obs(1, pix="150")], ["price_changed"]),
    ([obs(0, price="171.00"), obs(1, price="171", seller="B")], ["seller_changed"]),
]


@pytest.mark.parametrize("rows,expected", CASES)
def test_change_types(spark, rows, expected):
    got = changes.with_previous_offer(spark.createDataFrame(rows, OBS)).orderBy("observation_id").collect()
    assert got[-1]["event_types"] == expected


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    "text,currency,expected",
    [("R$ 1.234,56", "BRL", "1234.5600"), ("₲ 4.000.000", "PYG", "4000000.0000"), ("US$ 999.00", "USD", "999.0000"), ("12,5", "USD", "12.5000"),
     ("1,234.56", "USD", None), ("0", "BRL", None), ("abc", "BRL", None), ("-5", "USD", None)],
)
def test_money(spark, text, currency, expected):
    got = value(spark, money.parse_money(F.lit(text), F.lit(currency)))
    assert got == (None if expected is None else Decimal(expected))


def test_conversion(spark):
    rates = spark.createDataFrame(
        [("USD", "BRL", "tourism_sell", Decimal("5.3034"), "v", T0, "fresh"), ("PYG", "BRL", "official", Decimal("0.000861"), "b", T0, "stale"),
         ("EUR", "BRL", "market", Decimal("6"), "x", T0, "stale"), ("EUR", "BRL", "ptax_buy", Decimal("7"), "x", T0, "fresh")],
        "base_currency string, quote_currency string, rate_type string, rate decimal(24,12), source string, fetched_at timestamp, status string",
    )
    prices = spark.createDataFrame(
        [(1, Decimal("999.00"), "USD"), (2, Decimal("4000000"), "PYG"), (3, Decimal("10"), "BRL"), (4, Decimal("1"), "ARS"), (5, Decimal("2"), "EUR"), (6, None, "USD")],
        "id int, amount decimal(18,4), currency string",
    )
    got = {r["id"]: (r["converted_amount"], r["fx_status"]) for r in fx.convert(prices, rates).collect()}
    assert got[1] == (Decimal("5298.1000"), "fresh")
    assert got[2] == (Decimal("3444.0000"), "stale")
    assert got[3] == (Decimal("10.0000"), "fresh")
    assert got[4] == (None, "unavailable")
    assert got[5] == (Decimal("14.0000"), "fresh")
    assert got[6] == (None, None)
    shown = {r["id"]: r["fx_status"] for r in fx.enrich(prices, rates).collect()}
    assert shown[3] is None and shown[1] == "fresh"


def test_rate_validation(spark):
    known = spark.createDataFrame([("USD", "BRL", "tourism_sell", Decimal("5.30"))], "base_currency string, quote_currency string, rate_type string, rate decimal(24,12)")
    batch = spark.createDataFrame(
        [(1, "USD", "BRL", "tourism_sell", Decimal("550")), (2, "USD", "BRL", "tourism_sell", Decimal("5.40")), (3, "USD", "BRL", "tourism_sell", Decimal("0"))],
        "n int, base_currency string, quote_currency string, rate_type string, rate decimal(24,12)",
    )
    got = {r["n"]: r["errors"] for r in fx.validate_batch(batch, known).collect()}
    assert got == {1: ["outside_band", "jump"], 2: [], 3: ["not_positive"]}


def test_schedule(spark):
    now = F.lit("2026-09-01 12:00:00").cast("timestamp")
    at = lambda c: value(spark, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    regular = F.lit("2026-09-02 00:00:00").cast("timestamp")
    assert at(monitoring.next_check(now, regular, F.lit(None).cast("timestamp"))) == "2026-09-02 00:00:00"
    assert at(monitoring.next_check(now, regular, F.lit("2026-09-01 15:00:00").cast("timestamp"))) == "2026-09-01 15:01:00"
    assert at(monitoring.next_check(now, regular, F.lit("2026-09-01 11:00:00").cast("timestamp"))) == "2026-09-01 12:00:00"
    assert at(monitoring.retry_at(now, F.lit(3), F.lit(None).cast("int"))) == "2026-09-01 12:20:00"
    assert at(monitoring.retry_at(now, F.lit(9), F.lit(None).cast("int"))) == "2026-09-01 13:00:00"
    assert at(monitoring.retry_at(now, F.lit(1), F.lit(1800))) == "2026-09-01 12:30:00"
    assert at(monitoring.deferred_until(now, F.lit(None).cast("int"))) == "2026-09-01 12:01:00"


EVENT = "id long, listing_id long, event_type string, before struct<price:string,currency:string,scraped_at:string>, after struct<price:string,currency:string,scraped_at:string,promotion_status:string,source:string>, detected_at timestamp"


def payload(values, side, frame):
    fields = {f.name: f.dataType for f in PAYLOAD.fields}
    return F.struct(*[(F.col(f"{side}.{n}") if n in values else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def events(spark, rows):
    df = spark.createDataFrame(rows, EVENT)
    return df.withColumns(
        {"before": payload(("price", "currency", "scraped_at"), "before", df), "after": payload(("price", "currency", "scraped_at", "promotion_status", "source"), "after", df)}
    )


def kept(spark, rows):
    return sorted(r["id"] for r in feed.suppress_secondary(events(spark, rows)).collect())


def test_feed_suppression(spark):
    none = (None, None, None)
    rows = [
        (1, 1, "availability_changed", none, ("1", "BRL", None, None, None), T0),
        (2, 1, "out_of_stock", none, ("1", "BRL", None, None, None), T0),
        # same observation, detected a moment later
        (3, 2, "price_changed", none, ("1", "BRL", "s1", None, None), T0),
        (4, 2, "promotion_expired", none, ("1", "BRL", "s1", None, None), T0 + timedelta(milliseconds=5)),
        # legacy promotion event: same previous snapshot, no own observation time
        (5, 3, "price_changed", (None, None, "p1"), ("1", "BRL", "s2", None, None), T0),
        (6, 3, "promotion_updated", (None, None, "p1"), (None, None, None, "active", None), T0 + timedelta(seconds=2)),
        # wall-clock expiry names its source and is its own observation
        (7, 4, "price_changed", (None, None, "p1"), ("1", "BRL", "s2", None, None), T0),
        (8, 4, "promotion_expired", (None, None, "p1"), (None, None, None, "expired", "wall_clock"), T0 + timedelta(seconds=1)),
        (9, 5, "offer_created", none, ("1", "BRL", None, None, None), T0),
        (10, 5, "new_offer", none, ("1", "BRL", None, None, None), T0),
    ]
    assert kept(spark, rows) == [2, 4, 6, 7, 8, 10]


def test_feed_price_text(spark):
    rows = [
        (1, 1, "price_changed", ("171", "BRL", None), ("171.00", " brl ", None, None, None), T0),
        (2, 1, "price_changed", ("171", "BRL", None), ("180", "BRL", None, None, None), T0),
        (3, 1, "price_changed", ("171", "BRL", None), ("171", None, None, None, None), T0),
        (4, 1, "price_changed", ("n/a", "BRL", None), ("171", "BRL", None, None, None), T0),
    ]
    df = events(spark, rows)
    got = df.where(feed.really_changed(F.col("before"), F.col("after"), F.col("event_type"))).collect()
    assert sorted(r["id"] for r in got) == [2, 4]


def test_cursor(spark):
    text = value(spark, feed.cursor(F.lit("2026-09-01 12:00:00.123456").cast("timestamp"), F.lit("offer:9")))
    at, key = feed.decode_cursor(text)
    assert key == "offer:9" and at.microsecond == 123456
    with pytest.raises(ValueError):
        feed.decode_cursor("bm90IGEgY3Vyc29y")


def test_urls_dates_units_masks(spark):
    link = "HTTPS://Shop.Example/a/b/?utm_source=x&Color=Red&ref=1&q=a%20b&empty=#top"
    assert value(spark, urls.canonical(F.lit(link))) == "https://shop.example/a/b?Color=Red&q=a+b"
    assert value(spark, F.unix_seconds(dates.parse_time(F.lit("2026/09/28 10:00:59")))) == 1790600459
    assert value(spark, F.unix_seconds(dates.parse_time(F.lit("1790600459000")))) == 1790600459
    assert value(spark, dates.hms(F.lit(3_723_000))) == "01:02:03"
    assert value(spark, units.normalise(F.lit("kit_configuration"), F.lit("2 X 16 GB"))) == "2x16 GB"
    assert value(spark, units.normalise(F.lit("screen_size"), F.lit("27 polegadas"))) == '27"'
    assert value(spark, redact.text(F.lit("Bearer abc https://u:p@h"))) == "Bearer *** https://u:***@h"
    assert value(spark, money.original_from_instalments(F.lit(Decimal("100.00")), F.lit(Decimal("10")), F.lit(Decimal("90.00")))) == Decimal("100.00")
    assert value(spark, money.original_from_instalments(F.lit(Decimal("100.00")), F.lit(Decimal("10")), F.lit(Decimal("80.00")))) is None


def test_structured_offer(spark):
    html = '<script type="application/ld+json">{"@type":["Thing","Product"],"name":"TV","sku":"9","offers":{"price":"4399.00","availability":"InStock"}}</script>'
    row = pages.structured_offers(spark.createDataFrame([("https://x.example/p", html)], "url string, html string"), "USD").collect()[0]
    assert (row["title"], row["price"], row["product_id"], row["available"], row["error"]) == ("TV", Decimal("4399.0000"), "9", True, None)


def test_gtin_consensus(spark):
    refs = spark.createDataFrame([(i, None, "nestle") for i in range(1, 5)] + [(5, "7891991010863", "nestle")], "ref_id int, gtin string, brand string")
    good, other = "7891991010863", "036000291452"
    hits = spark.createDataFrame(
        [(1, "s1", "auto_match", good, "Nestle", 1), (2, "s1", "review", good, "Nestle", 1), (3, "s1", "auto_match", good, "Nestle", 1),
         (3, "s2", "auto_match", other, "Nestle", 2), (4, "s1", "auto_match", good, "Garoto", 1), (5, "s1", "auto_match", good, "Nestle", 1)],
        "ref_id int, store string, decision string, gtin string, brand string, seq int",
    )
    got = {r["ref_id"]: (r["gtin"], r["source"]) for r in matching.gtin_consensus(refs, hits).collect()}
    assert got == {1: (good, "auto_match:s1"), 5: (good, "auto_match:s1")}
