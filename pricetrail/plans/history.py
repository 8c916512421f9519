"""Registered queries over offer histories and the activity feed."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches_all_terms
from ..operators import changes, feed
from ..schema import PAYLOAD
from ..session import shared_path
from ..sources import sinks
from . import views
from .views import OBSERVATIONS_SQL, OFFER_EVENTS_SQL, table, utc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def micros(column: str):
    return F.unix_micros(F.col(column))


# --- change detection -------------------------------------------------------------------------


@query(
    "offer_diff",
    "WITH " + OFFER_EVENTS_SQL + """
    SELECT listing_id, observation_id, event_type, CAST(prev.price AS DECIMAL(18,4)) AS old_price,
      CASE WHEN outcome = 'ok' THEN price END AS new_price, epoch_us(scraped_at) AS detected_us
    FROM (SELECT *, unnest(event_types) AS event_type FROM typed)""",
)
def offer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = changes.offer_events(views.observations(spark, sf_dir))
    return events.select(
        "listing_id", "observation_id", "event_type",
        F.col("before.price").alias("old_price"), F.col("after.price").alias("new_price"),
        micros("detected_at").alias("detected_us"),
    )


@query(
    "offer_diff_by_type",
    "WITH " + OFFER_EVENTS_SQL + """
    SELECT event_type, count(*) AS events, count(DISTINCT listing_id) AS listings
    FROM (SELECT listing_id, unnest(event_types) AS event_type FROM typed) GROUP BY event_type""",
)
def offer_diff_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = changes.offer_events(views.observations(spark, sf_dir))
    return events.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("listing_id").alias("listings")
    )


@query(
    "refresh_report",
    "WITH " + OFFER_EVENTS_SQL + """
    SELECT status, count(*) AS checks, sum(CASE WHEN outcome = 'ok' THEN price END) AS price_total FROM (
      SELECT outcome, price, CASE WHEN len(event_types) = 0 THEN 'deferred'
        WHEN list_contains(event_types, 'offer_removed') THEN 'removed'
        WHEN list_contains(event_types, 'scrape_failed') THEN 'scrape_failed'
        WHEN list_contains(event_types, 'out_of_stock') THEN 'out_of_stock'
        WHEN event_types = ['unchanged'] THEN 'unchanged' WHEN event_types = ['new_offer'] THEN 'new_offer'
        ELSE 'changed' END AS status FROM typed) GROUP BY status""",
)
def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = changes.refresh_report(views.observations(spark, sf_dir))
    return report.groupBy("status").agg(
        F.count("*").alias("checks"), F.sum("current.price").cast("decimal(38,4)").alias("price_total")
    )


@query(
    "offer_latest",
    "WITH " + OBSERVATIONS_SQL + """
    SELECT listing_id, observation_id, price, pix_price, currency, seller, availability, epoch_us(scraped_at) AS scraped_us
    FROM obs WHERE outcome = 'ok'
    QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, observation_id DESC) = 1""",
)
def offer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest_snapshot(views.observations(spark, sf_dir)).select(
        "listing_id", "observation_id", "price", "pix_price", "currency", "seller", "availability",
        micros("scraped_at").alias("scraped_us"),
    )


@query(
    "history_replay",
    "WITH " + OBSERVATIONS_SQL + """
    SELECT listing_id, observation_id, price, currency, seller, availability, epoch_us(scraped_at) AS scraped_us, CAST(CAST(scraped_at AS DATE) AS VARCHAR) AS day
    FROM obs WHERE outcome = 'ok'""",
)
def history_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: the second crashes half way before it is written whole, the third is replayed."""
    rows = views.observations(spark, sf_dir).where("outcome = 'ok'").select(
        "listing_id", "observation_id", "price", "currency", "seller", "availability", "scraped_at"
    )
    folder = shared_path(spark, "history")
    for n in (0, 1, 2, 2, 3):
        batch = rows.where(F.pmod("observation_id", F.lit(4)) == n)
        if n == 1:
            sinks.stage_batch(batch.where("listing_id % 2 = 0"), folder, str(n), "scraped_at")
        sinks.append_batch(batch, folder, str(n), "scraped_at")
    return sinks.committed(spark, folder, rows.schema).select(
        "listing_id", "observation_id", "price", "currency", "seller", "availability", micros("scraped_at").alias("scraped_us"), F.col("day").cast("string").alias("day")
    )


@query(
    "offer_asof",
    "WITH " + OBSERVATIONS_SQL + """,
    e AS (SELECT listing_id, observation_id AS id, scraped_at AS detected_at FROM obs WHERE kind = 'click'),
    s AS (SELECT listing_id, observation_id AS sid, scraped_at, price FROM obs WHERE kind = 'purchase')
    SELECT e.listing_id, e.id AS event_id, s.sid AS snapshot_id, s.price AS snapshot_price
    FROM e ASOF LEFT JOIN s ON e.listing_id = s.listing_id AND e.detected_at >= s.scraped_at""",
)
def offer_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = views.observations(spark, sf_dir)
    events = obs.where("kind = 'click'").select(
        "listing_id", F.col("observation_id").alias("id"), F.col("scraped_at").alias("detected_at")
    )
    shots = obs.where("kind = 'purchase'").select(
        "listing_id", F.col("observation_id").alias("id"), "scraped_at", "price"
    )
    return changes.snapshot_as_of(events, shots).select(
        "listing_id", F.col("id").alias("event_id"),
        F.col("snapshot.id").alias("snapshot_id"), F.col("snapshot.price").alias("snapshot_price"),
    )


@query(
    "failure_streak",
    "WITH " + OBSERVATIONS_SQL + """
    SELECT listing_id, observation_id, extraction_streak,
      coalesce(failure_kind = 'gone', false) OR (ext AND extraction_streak >= 3) AS removed
    FROM (SELECT *, CASE WHEN ext THEN row_number() OVER (PARTITION BY listing_id, island, ext ORDER BY scraped_at, observation_id)
        ELSE 0 END AS extraction_streak
      FROM (SELECT *, sum(CASE WHEN ext THEN 0 ELSE 1 END) OVER (PARTITION BY listing_id ORDER BY scraped_at, observation_id) AS island
        FROM (SELECT *, coalesce(failure_kind = 'extraction', false) AS ext FROM obs)))""",
)
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.extraction_streaks(views.observations(spark, sf_dir)).select(
        "listing_id", "observation_id", "extraction_streak", "removed"
    )


@query(
    "change_marks",
    "WITH " + OFFER_EVENTS_SQL + """
    SELECT listing_id, observation_id,
      epoch_us(max(CASE WHEN list_contains(event_types, 'price_changed') THEN scraped_at END) OVER w) AS price_changed_us,
      epoch_us(max(CASE WHEN list_has_any(event_types, ['availability_changed', 'out_of_stock']) THEN scraped_at END) OVER w)
        AS availability_changed_us
    FROM typed WINDOW w AS (PARTITION BY listing_id ORDER BY scraped_at, observation_id)""",
)
def change_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.change_marks(changes.with_previous_offer(views.observations(spark, sf_dir)))
    return rows.select(
        "listing_id", "observation_id",
        micros("last_price_changed_at").alias("price_changed_us"),
        micros("last_availability_changed_at").alias("availability_changed_us"),
    )


# --- activity feed ----------------------------------------------------------------------------


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    kind = F.col("event_type")
    typed = (
        F.when(kind == "purchase", "price_changed")
        .when(kind == "click", F.when(k < 50, "availability_changed").otherwise("promotion_updated"))
        .when(
            kind == "view",
            F.when(k < 30, "out_of_stock").when(k < 60, "promotion_activated").when(k < 80, "offer_removed").otherwise("seller_changed"),
        )
        .when(kind == "signup", F.when(k < 50, "new_offer").otherwise("offer_created"))
        .otherwise("scrape_failed")
    )
    price = F.col("value").cast("decimal(18,2)")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    day = F.date_format("ts", "yyyy-MM-dd")
    given = {
        "before": {
            "price": F.when(k % 3 == 0, price).otherwise(price + 10).cast("decimal(18,4)").cast("string"),
            "pix_price": F.when(k % 5 == 0, F.lit("n/a")),
            "currency": F.lit(" brl "),
            "seller": F.lit("Loja Á"),
            "availability": F.lit("in_stock"),
            "available": F.lit(True),
            "scraped_at": F.when(k % 4 == 1, day),
        },
        "after": {
            "price": price.cast("string"),
            "currency": F.when(k % 7 != 0, F.lit("BRL")),
            "seller": F.concat(F.lit("Seller "), (k % 9).cast("string")),
            "availability": F.when(k % 2 == 0, "out_of_stock").otherwise("in_stock"),
            "available": k % 2 != 0,
            "scraped_at": F.when(k % 2 == 0, hour),
            "promotion_status": F.when(typed.startswith("promotion_"), "active"),
        },
    }
    sides = {
        side: F.struct(
            *[
                (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in PAYLOAD.fields
            ]
        )
        for side, values in given.items()
    }
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", "event_type", "value", utc("ts").alias("ts"), views.prop_k().alias("k"))
        .select(
            F.col("event_id").alias("id"), F.col("user_id").alias("listing_id"), typed.alias("event_type"),
            sides["before"].alias("before"), sides["after"].alias("after"),
            F.date_trunc("day", "ts").alias("detected_at"),
        )
    )


FEED_SQL = """
ev AS (
  SELECT event_id AS id, user_id AS listing_id, k, value, ts, date_trunc('day', ts)::TIMESTAMP AS detected_at,
    CASE event_type WHEN 'purchase' THEN 'price_changed'
      WHEN 'click' THEN CASE WHEN k < 50 THEN 'availability_changed' ELSE 'promotion_updated' END
      WHEN 'view' THEN CASE WHEN k < 30 THEN 'out_of_stock' WHEN k < 60 THEN 'promotion_activated'
        WHEN k < 80 THEN 'offer_removed' ELSE 'seller_changed' END
      WHEN 'signup' THEN CASE WHEN k < 50 THEN 'new_offer' ELSE 'offer_created' END
      ELSE 'scrape_failed' END AS event_type,
    CAST(value AS DECIMAL(18,2)) + CASE WHEN k % 3 = 0 THEN 0 ELSE 10 END AS old_price,
    CAST(value AS DECIMAL(18,2)) AS new_price,
    CASE WHEN k % 7 <> 0 THEN 'BRL' END AS new_currency,
    'Seller ' || CAST(k % 9 AS VARCHAR) AS new_seller,
    CASE WHEN k % 4 = 1 THEN strftime(ts, '%Y-%m-%d') END AS old_scraped,
    CASE WHEN k % 2 = 0 THEN strftime(date_trunc('hour', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') END AS new_scraped
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
),
primary_ev AS (
  SELECT * FROM ev e WHERE NOT EXISTS (
    SELECT 1 FROM ev p WHERE p.listing_id = e.listing_id
      AND (p.detected_at = e.detected_at
        OR (e.new_scraped IS NOT NULL AND e.new_scraped = p.new_scraped)
        OR (p.new_scraped IS NULL AND e.old_scraped = p.old_scraped AND starts_with(p.event_type, 'promotion_')))
      AND ((e.event_type = 'availability_changed' AND p.event_type IN ('out_of_stock', 'offer_removed'))
        OR (e.event_type = 'price_changed' AND starts_with(p.event_type, 'promotion_'))
        OR (e.event_type IN ('new_offer', 'offer_created') AND p.event_type IN ('new_offer', 'offer_created') AND p.id > e.id)))
),
summary AS (
  SELECT * FROM primary_ev WHERE event_type NOT IN ('seller_changed', 'scrape_failed')
    AND (event_type <> 'price_changed' OR NOT (old_price > 0 AND new_price > 0 AND old_price = new_price AND new_currency = 'BRL'))
),
prod AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'user-' || CAST(p_partkey % 7 AS VARCHAR) END AS owner_user_id,
    p_name AS title, p_brand AS brand, p_type AS model,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey AS INTEGER)) AS created_at FROM part
),
lst AS (SELECT DISTINCT user_id AS id, user_id AS canonical_product_id,
    CASE user_id % 4 WHEN 0 THEN 'kabum' WHEN 1 THEN 'amazon' WHEN 2 THEN 'amazon' ELSE 'corner' END AS store,
    CASE user_id % 4 WHEN 2 THEN 'US' ELSE 'BR' END AS country FROM events)
"""


def feed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 3 != 0, F.concat(F.lit("user-"), (key % 7).cast("string"))).alias("owner_user_id"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"),
        F.timestamp_seconds(F.lit(1704067200) + key * 60).alias("created_at"),
    )


def feed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return (
        table(spark, sf_dir, "events").select("user_id").distinct()
        .select(
            user.alias("id"), user.alias("canonical_product_id"),
            F.when(user % 4 == 0, "kabum").when(user % 4 == 3, "corner").otherwise("amazon").alias("store"),
            F.when(user % 4 == 2, "US").otherwise("BR").alias("country"),
        )
    )


def feed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct(
        *[
            (
                F.col("value").cast("decimal(18,2)").cast("string") if f.name == "price"
                else F.lit("BRL") if f.name == "currency" else F.lit(None)
            ).cast(f.dataType).alias(f.name)
            for f in PAYLOAD.fields
        ]
    )
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("listing_id"), payload.alias("payload"),
        utc("ts").alias("scraped_at"),
    )


@query("feed_suppress", "WITH " + FEED_SQL + "SELECT id, listing_id, event_type FROM primary_ev")
def feed_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.suppress_secondary(feed_events(spark, sf_dir)).select("id", "listing_id", "event_type")


@query("feed_summary", "WITH " + FEED_SQL + "SELECT id, event_type, old_price, new_price FROM summary")
def feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.summary_events(feed_events(spark, sf_dir)).select(
        "id", "event_type",
        F.col("before.price").cast("decimal(18,2)").alias("old_price"),
        F.col("after.price").cast("decimal(18,2)").alias("new_price"),
    )


@query(
    "feed_types",
    "WITH " + FEED_SQL + """SELECT type, count(*) AS items FROM (
      SELECT CASE event_type WHEN 'offer_created' THEN 'new_offer' ELSE event_type END AS type FROM ev
      UNION ALL SELECT 'product_added' FROM prod) GROUP BY type""",
)
def feed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = feed_events(spark, sf_dir).select("event_type").unionByName(
        feed_products(spark, sf_dir).select(F.lit(None).cast("string").alias("event_type"))
    )
    return items.select(feed.public_type(F.col("event_type")).alias("type")).groupBy("type").agg(
        F.count("*").alias("items")
    )


@query(
    "feed_price_direction",
    "WITH " + FEED_SQL + """SELECT listing_id, price_direction, count(*) AS events FROM (
      SELECT listing_id, CASE WHEN new_currency = 'BRL' THEN
        CASE WHEN new_price < old_price THEN 'decreased' WHEN new_price > old_price THEN 'increased' ELSE 'unchanged' END END AS price_direction
      FROM ev WHERE event_type = 'price_changed') GROUP BY ALL""",
)
def feed_price_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed_events(spark, sf_dir).where("event_type = 'price_changed'")
    rows = rows.withColumn("snapshot", F.lit(None).cast(PAYLOAD))
    return feed.offer_change(rows).groupBy("listing_id", "price_direction").agg(F.count("*").alias("events"))


PAGE_LIMIT = 25
BOUNDARY = (datetime(2024, 1, 20, tzinfo=timezone.utc), "offer:5")
PAGE_SQL = """,
page AS (
  SELECT * FROM (
    SELECT 'product:' || CAST(id AS VARCHAR) AS key, created_at AS occurred_at, id AS product_id, NULL::BIGINT AS event_id
    FROM prod WHERE (owner_user_id IS NULL OR owner_user_id = 'user-2')
    UNION ALL
    SELECT 'offer:' || CAST(s.id AS VARCHAR), s.detected_at, p.id, s.id
    FROM summary s JOIN lst l ON l.id = s.listing_id JOIN prod p ON p.id = l.canonical_product_id
    WHERE (p.owner_user_id IS NULL OR p.owner_user_id = 'user-2'))
  WHERE occurred_at < TIMESTAMP '2024-01-20' OR (occurred_at = TIMESTAMP '2024-01-20' AND key < 'offer:5')
  ORDER BY occurred_at DESC, key DESC LIMIT 26
)"""


@query(
    "feed_page",
    "WITH " + FEED_SQL + PAGE_SQL + """
    SELECT page.key, epoch_us(page.occurred_at) AS occurred_us, page.product_id, page.event_id, prod.title,
      CASE WHEN lst.store = 'amazon' THEN CASE lst.country WHEN 'US' THEN 'amazon_us' ELSE 'amazon_br' END ELSE lst.store END AS store_key,
      CASE WHEN lst.store = 'amazon' THEN CASE lst.country WHEN 'US' THEN 'Amazon US' ELSE 'Amazon Brasil' END
           WHEN lst.store = 'kabum' THEN 'KaBuM!' WHEN lst.store IS NOT NULL THEN 'Loja' END AS store_label
    FROM page JOIN prod ON prod.id = page.product_id LEFT JOIN ev ON ev.id = page.event_id
    LEFT JOIN lst ON lst.id = ev.listing_id""",
)
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, listings = feed_products(spark, sf_dir), feed_listings(spark, sf_dir)
    events, shots = feed_events(spark, sf_dir), feed_snapshots(spark, sf_dir)
    page = feed.change_page(
        products, listings, events, viewer="user-2", limit=PAGE_LIMIT, boundary=BOUNDARY
    )
    full = feed.offer_change(feed.hydrate(page, products, listings, events, shots))
    return full.select(
        "key", micros("occurred_at").alias("occurred_us"), "product_id", "event_id", "title", "store_key", "store_label"
    )


@query(
    "change_explorer",
    "WITH " + FEED_SQL + """
    SELECT 'offer:' || CAST(e.id AS VARCHAR) AS id, epoch_us(e.detected_at) AS occurred_us, p.id AS product_id
    FROM ev e JOIN lst l ON l.id = e.listing_id JOIN prod p ON p.id = l.canonical_product_id
    WHERE contains(lower(concat_ws(' ', p.title, p.brand, p.model, e.new_seller)), 'seller')
      AND contains(lower(concat_ws(' ', p.title, p.brand, p.model, e.new_seller)), '3')
      AND l.store = 'amazon' AND l.country = 'BR' AND e.event_type IN ('new_offer', 'offer_created')
      AND e.detected_at >= TIMESTAMP '2024-01-05' AND e.detected_at < TIMESTAMP '2024-01-25'
    ORDER BY e.detected_at DESC, id DESC LIMIT 51""",
)
def change_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = feed.change_page(
        feed_products(spark, sf_dir), feed_listings(spark, sf_dir), feed_events(spark, sf_dir),
        is_admin=True, limit=50, history=True,
        filters=feed.FeedFilters(
            q="SÉLLER 3", event_type="new_offer", store="amazon_br",
            started_at=datetime(2024, 1, 5, tzinfo=timezone.utc), ended_at=datetime(2024, 1, 25, tzinfo=timezone.utc),
        ),
    )
    return page.select("id", micros("occurred_at").alias("occurred_us"), "product_id")


@query(
    "scope_filter",
    """SELECT count(*) AS products, count(DISTINCT title) AS titles FROM (
      SELECT p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 7 END AS o FROM part)
    WHERE o IS NULL OR o = 2""",
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = feed_products(spark, sf_dir).where(feed.visible(F.col("owner_user_id"), "user-2", False))
    return seen.agg(F.count("*").alias("products"), F.count_distinct("title").alias("titles"))


FOLD_SQL = """lower(translate({0}, 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝŸ',
  'aaaaaaeeeeiiiiooooouuuucnyyaaaaaaeeeeiiiiooooouuuucnyy'))"""


@query(
    "search_terms",
    f"""SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents
    WHERE (contains({FOLD_SQL.format('text')}, 'ete') OR contains({FOLD_SQL.format('source')}, 'ete'))
      AND (contains({FOLD_SQL.format('text')}, 'la') OR contains({FOLD_SQL.format('source')}, 'la'))
    GROUP BY lang""",
)
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.where(matches_all_terms("Été LA été", [F.col("text"), F.col("source")]))
    return found.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("n_chars").cast("long").alias("chars")
    )
