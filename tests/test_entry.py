"""The entry point, and small fixtures for the queries that have no SQL."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import __spark_entry__ as entry
from pricetrail.operators import identity, monitoring, runs
from pricetrail.plans import registry

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100
    assert set(oracles) <= set(queries)
    assert set(registry.QUERIES) <= set(queries)
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"search_queries"}


def test_entry(spark):
    counts = {r["event_type"]: r["events"] for r in entry.entry(spark).collect()}
    assert counts["new_offer"] > 0 and counts["price_changed"] > 0


def test_spacing(spark):
    hits = [(1, "u1", 0), (2, "u2", 5), (3, "u1", 10), (4, "u2", 15), (5, "u1", 299), (6, "u1", 300)]
    log = spark.createDataFrame(
        [(n, "h", u, T0 + timedelta(seconds=s)) for n, u, s in hits], "request_id int, host string, url string, at timestamp"
    )
    got = {r["request_id"]: (r["admitted"], r["code"], r["retry_after"]) for r in monitoring.spacing_audit(log).collect()}
    # the same two gates, written out as a plain loop
    want, host_ok, url_ok = {}, 0, {}
    for n, u, s in hits:
        if url_ok.get(u, 0) > s:
            want[n] = (False, "DUPLICATE_REQUEST", max(1, url_ok[u] - s))
        elif host_ok > s:
            want[n] = (False, "RATE_LIMITED", max(1, host_ok - s))
        else:
            url_ok[u], host_ok, want[n] = s + 300, s + 15, (True, None, 0)
    assert got == want
    assert [n for n, w in want.items() if w[0]] == [1, 4, 6]


def test_store_order(spark):
    stores = spark.createDataFrame([("kabum",), ("amazon_us",), ("pichau",), ("KABUM",)], "store_key string")
    rows = runs.order_stores(stores, "kabum").collect()
    assert [(r["store_key"], r["wave"]) for r in rows] == [("pichau", 2), ("amazon_us", 3), ("kabum", 1)]


def test_search_queries(spark):
    items = spark.createDataFrame([("Apple iPhone 16 Pro 256GB Black", "Apple", "iPhone 16 Pro")], "title string, brand string, model string")
    asked = identity.search_queries(identity.build_identities(items), ["pt-BR", "en-US"])
    got = {r["locale"]: r["queries"] for r in asked.select("locale", "queries").collect()}
    assert "iphone 16 pro 256gb preto" in got["pt-BR"]
    assert "iphone 16 pro 256gb black" in got["en-US"]
    assert all(len(q) == len(set(q)) for q in got.values())
