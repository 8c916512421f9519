"""Views that read the shared test tables as catalog and price-history tables.

Each view is a projection (or a small-dimension join) of a whole table; the
operators on top are the same as for real catalog data. ``SQL`` holds the same
definitions as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY
from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column: str):
    return F.col(column).cast("timestamp")


def prop_k(column: str = "props"):
    return F.regexp_extract(F.col(column), r'"k": *(\d+)', 1).cast("int")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as offer checks: listing = user, one check per event."""
    k = F.col("k")
    price = F.col("value").cast(MONEY)
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", "event_type", "value", utc("ts").alias("ts"), prop_k().alias("k"))
        .select(
            F.col("user_id").alias("listing_id"),
            F.col("event_id").alias("observation_id"),
            F.when(F.col("event_type") == "error", "failed")
            .when((F.col("event_type") == "signup") & (k >= 95), "removed")
            .otherwise("ok")
            .alias("outcome"),
            F.when(
                F.col("event_type") == "error",
                F.when(k < 50, "extraction")
                .when(k < 60, "local_throttle")
                .when(k < 65, "infra")
                .when(k < 68, "gone")
                .when(k < 85, "blocked")
                .otherwise("timeout"),
            ).alias("failure_kind"),
            F.element_at(F.array(F.lit("BRL"), F.lit("USD"), F.lit("PYG")), (F.col("user_id") % 3 + 1).cast("int")).alias("currency"),
            # many equal prices in a row, so that "unchanged" happens too
            F.when(k < 40, F.lit(100).cast(MONEY)).otherwise(price).alias("price"),
            F.when(k % 2 == 0, (F.when(k < 40, F.lit(100).cast(MONEY)).otherwise(price) * F.lit("0.9").cast("decimal(2,1)")).cast(MONEY)).alias("pix_price"),
            F.when(k < 40, F.lit(120).cast(MONEY)).otherwise((price * F.lit("1.2").cast("decimal(2,1)")).cast(MONEY)).alias("original_price"),
            F.concat(F.when(k % 4 == 0, "Seller ").otherwise("seller "), (k % 5 / 4).cast("int").cast("string")).alias("seller"),
            F.when(k % 10 == 0, "out_of_stock").otherwise("in_stock").alias("availability"),
            (k % 10 != 0).alias("available"),
            F.col("ts").alias("scraped_at"),
            F.col("event_type").alias("kind"),
            "k",
        )
    )


OBSERVATIONS_SQL = """
obs AS (
  SELECT user_id AS listing_id, event_id AS observation_id,
    CASE WHEN event_type = 'error' THEN 'failed'
         WHEN event_type = 'signup' AND k >= 95 THEN 'removed' ELSE 'ok' END AS outcome,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN k < 50 THEN 'extraction' WHEN k < 60 THEN 'local_throttle' WHEN k < 65 THEN 'infra'
           WHEN k < 68 THEN 'gone' WHEN k < 85 THEN 'blocked' ELSE 'timeout' END END AS failure_kind,
    CASE user_id % 3 WHEN 0 THEN 'BRL' WHEN 1 THEN 'USD' ELSE 'PYG' END AS currency,
    p AS price,
    CASE WHEN k % 2 = 0 THEN CAST(p * CAST(0.9 AS DECIMAL(2,1)) AS DECIMAL(18,4)) END AS pix_price,
    CASE WHEN k < 40 THEN CAST(120 AS DECIMAL(18,4))
         ELSE CAST(p * CAST(1.2 AS DECIMAL(2,1)) AS DECIMAL(18,4)) END AS original_price,
    (CASE WHEN k % 4 = 0 THEN 'Seller ' ELSE 'seller ' END) || CAST((k % 5) // 4 AS VARCHAR) AS seller,
    CASE WHEN k % 10 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability,
    k % 10 <> 0 AS available, ts AS scraped_at, event_type AS kind, k
  FROM (SELECT *, CASE WHEN k < 40 THEN CAST(100 AS DECIMAL(18,4)) ELSE CAST(value AS DECIMAL(18,4)) END AS p
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))
)"""

OFFER_EVENTS_SQL = OBSERVATIONS_SQL + """,
carried AS (
  SELECT *, last_value(CASE WHEN outcome = 'ok' THEN
      {'price': price, 'pix_price': pix_price, 'currency': currency, 'seller': seller,
       'availability': availability, 'available': available, 'scraped_at': scraped_at} END IGNORE NULLS)
    OVER (PARTITION BY listing_id ORDER BY scraped_at, observation_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM obs
),
typed AS (
  SELECT *, CASE
    WHEN failure_kind IN ('local_throttle', 'infra') THEN CAST([] AS VARCHAR[])
    WHEN outcome = 'failed' THEN ['scrape_failed'] WHEN outcome = 'removed' THEN ['offer_removed']
    WHEN prev IS NULL THEN ['new_offer']
    WHEN same THEN ['unchanged']
    WHEN len(moved) = 0 THEN ['price_changed'] ELSE moved END AS event_types
  FROM (SELECT *,
      prev.availability IS NOT DISTINCT FROM availability AND prev.currency IS NOT DISTINCT FROM currency
      AND prev.pix_price IS NOT DISTINCT FROM pix_price AND prev.price IS NOT DISTINCT FROM price
      AND lower(trim(prev.seller)) IS NOT DISTINCT FROM lower(trim(seller)) AS same,
      list_filter([
        CASE WHEN prev.price IS DISTINCT FROM price THEN 'price_changed' END,
        CASE WHEN lower(trim(prev.seller)) IS DISTINCT FROM lower(trim(seller)) THEN 'seller_changed' END,
        CASE WHEN prev.availability IS DISTINCT FROM availability THEN 'availability_changed' END,
        CASE WHEN prev.availability IS DISTINCT FROM availability
              AND (availability = 'out_of_stock' OR NOT available) THEN 'out_of_stock' END],
        lambda x: x IS NOT NULL) AS moved FROM carried)
)"""
