"""Registered queries over the monitoring schedule and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, monitoring
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


NOW = "1998-06-01 00:00:00"
LIMIT = 200


def now():
    return F.lit(NOW).cast("timestamp")


def listing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the current state of monitored listings."""
    key, at = F.col("o_orderkey"), F.col("at")
    promo = F.substring("o_orderpriority", 1, 1)
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", utc("o_orderdate").alias("at"))
        .select(
            key.alias("listing_id"),
            F.concat(F.lit("store-"), (F.col("o_custkey") % 13).cast("string")).alias("store"),
            F.concat(F.lit("host-"), (F.col("o_custkey") % 13).cast("string")).alias("host"),
            F.when(F.col("o_orderstatus") == "P", "removed").otherwise("active").alias("status"),
            (key % 10 != 0).alias("monitoring_enabled"),
            F.when(key % 11 != 0, at).alias("next_check_at"),
            F.greatest(F.lit(0).cast("long"), key % 5 - 2).alias("consecutive_failures"),
            F.when(key % 5 == 0, F.timestamp_micros(F.unix_micros(at) + 2 * 86_400_000_000)).alias("check_claim_expires_at"),
            F.when(promo == "1", "active").when(promo == "2", "expired").otherwise("none").alias("promotion_status"),
            F.when(promo.isin("1", "2"), F.timestamp_micros(F.unix_micros(at) + (key % 30) * 86_400_000_000)).alias("promotion_expires_at"),
        )
    )


STATE_SQL = f"""
ls AS (
  SELECT o_orderkey AS listing_id, 'store-' || CAST(o_custkey % 13 AS VARCHAR) AS store,
    CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'active' END AS status, o_orderkey % 10 <> 0 AS monitoring_enabled,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS next_check_at,
    greatest(0, o_orderkey % 5 - 2) AS consecutive_failures,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS lease,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'active' WHEN '2' THEN 'expired' ELSE 'none' END AS promo,
    CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS expires
  FROM orders
),
st AS (
  SELECT *, promo = 'active' AND expires <= TIMESTAMP '{NOW}' AS lapsed,
    monitoring_enabled AND status = 'active' AND (lease IS NULL OR lease <= TIMESTAMP '{NOW}')
      AND (coalesce(next_check_at <= TIMESTAMP '{NOW}', false) OR coalesce(promo = 'active' AND expires <= TIMESTAMP '{NOW}', false)) AS is_due
  FROM ls
),
work AS (
  SELECT *, CASE WHEN coalesce(lapsed, false) OR (promo = 'expired' AND expires IS NOT NULL) THEN 1
      WHEN consecutive_failures > 0 THEN 2 ELSE 3 END AS work_class,
    coalesce(greatest(0, datediff('second', next_check_at, TIMESTAMP '{NOW}')), 0) AS delay_seconds
  FROM st WHERE is_due ORDER BY work_class, next_check_at ASC NULLS LAST, listing_id LIMIT {LIMIT}
)"""


@query("due_listings", "WITH " + STATE_SQL + " SELECT listing_id, store, work_class, delay_seconds FROM work")
def due_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.work_list(listing_state(spark, sf_dir), now(), LIMIT).select(
        "listing_id", "store", "work_class", "delay_seconds"
    )


@query(
    "due_counts",
    "WITH " + STATE_SQL + f""" SELECT store, count(*) FILTER (is_due) AS due,
      epoch_us(min(least(next_check_at, CASE WHEN lapsed THEN TIMESTAMP '{NOW}' END)) FILTER (is_due)) AS first_due_us
    FROM st GROUP BY store""",
)
def due_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing_state(spark, sf_dir).withColumn("is_due", monitoring.due(now()))
    return rows.groupBy("store").agg(
        F.count_if("is_due").alias("due"),
        F.unix_micros(F.min(F.when(F.col("is_due"), monitoring.due_at(now())))).alias("first_due_us"),
    )


@query(
    "interleave",
    "WITH " + STATE_SQL + """ SELECT listing_id, store,
      row_number() OVER (PARTITION BY store ORDER BY work_class, next_check_at NULLS LAST, listing_id) AS turn FROM work""",
)
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = monitoring.work_list(listing_state(spark, sf_dir), now(), LIMIT)
    work = work.withColumn("next_sort", F.coalesce(F.unix_micros("next_check_at"), F.lit(2**62)))
    return monitoring.interleave(work, ["work_class", "next_sort", "listing_id"]).select("listing_id", "store", "turn")


@query(
    "monitor_dashboard",
    "WITH " + STATE_SQL + f""" SELECT count(*) FILTER (monitoring_enabled AND status = 'active') AS monitored_active,
      count(*) FILTER (is_due) AS due_count, count(*) FILTER (lease > TIMESTAMP '{NOW}') AS claimed_count,
      count(*) FILTER (monitoring_enabled AND consecutive_failures > 0) AS failed_count,
      count(*) FILTER (lapsed) AS promotions_expiring_now,
      count(*) FILTER (monitoring_enabled AND status = 'active' AND promo = 'expired' AND next_check_at <= TIMESTAMP '{NOW}')
        AS promotions_expired_awaiting_refresh,
      epoch_us(min(CASE WHEN is_due THEN least(next_check_at, CASE WHEN lapsed THEN TIMESTAMP '{NOW}' END) END)) AS oldest_due_us,
      datediff('second', min(CASE WHEN is_due THEN least(next_check_at, CASE WHEN lapsed THEN TIMESTAMP '{NOW}' END) END),
        TIMESTAMP '{NOW}') AS max_delay_seconds,
      epoch_us(min(CASE WHEN monitoring_enabled AND status = 'active' AND next_check_at > TIMESTAMP '{NOW}' THEN next_check_at END)) AS next_check_us
    FROM st""",
)
def monitor_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.dashboard(listing_state(spark, sf_dir), now())


@query(
    "next_check",
    f"""SELECT o_orderkey AS listing_id, epoch_us(CASE WHEN promo IS NULL THEN regular WHEN promo <= TIMESTAMP '{NOW}' THEN TIMESTAMP '{NOW}'
      ELSE least(regular, promo + INTERVAL 60 SECOND) END) AS next_check_us
    FROM (SELECT o_orderkey, TIMESTAMP '{NOW}' + to_hours(12 + CAST(o_orderkey % 700 AS INTEGER)) AS regular,
      CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS promo FROM orders)""",
)
def next_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("listing_id"),
        monitoring.plus_seconds(now(), (F.col("o_orderkey") % 700 + 12) * 3600).alias("regular"),
        F.when(F.col("o_orderpriority") == "1-URGENT", utc("o_orderdate")).alias("promo"),
    )
    at = monitoring.next_check(now(), F.col("regular"), F.col("promo"))
    return rows.select("listing_id", F.unix_micros(at).alias("next_check_us"))


BACKOFF_SQL = OBSERVATIONS_SQL + """,
counted AS (
  SELECT *, CASE WHEN k % 9 = 0 THEN k * 50 END AS retry_after, coalesce(failure_kind IN ('local_throttle', 'infra'), false) AS silent,
    outcome = 'failed' AND NOT coalesce(failure_kind IN ('local_throttle', 'infra'), false) AS failed FROM obs
),
islands AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER w AS island FROM counted
  WINDOW w AS (PARTITION BY listing_id ORDER BY scraped_at, observation_id)),
streaks AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id, island ORDER BY scraped_at, observation_id) AS n
  FROM islands)"""


@query(
    "backoff",
    "WITH " + BACKOFF_SQL + """
    SELECT listing_id, observation_id, CAST(n AS BIGINT) AS consecutive_failures,
      CASE WHEN failed THEN greatest(least(3600, 300 * power(2, n - 1)), least(coalesce(retry_after, 0), 3600))
           WHEN silent THEN least(greatest(30, coalesce(retry_after, 0), 60), greatest(30, coalesce(retry_after, 0), 60, 3600)) END::BIGINT AS wait_seconds
    FROM streaks""",
)
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = views.observations(spark, sf_dir).withColumn("retry_after", F.when(F.col("k") % 9 == 0, F.col("k") * 50))
    rows = monitoring.retry_schedule(checks)
    return rows.select(
        "listing_id", "observation_id", "consecutive_failures",
        monitoring.seconds_between(F.col("scraped_at"), F.col("next_check_at")).alias("wait_seconds"),
    )


@query(
    "adaptive_ttl",
    "WITH RECURSIVE " + OFFER_EVENTS_SQL + """,
    v AS (SELECT listing_id, observation_id, outcome, available, NOT list_contains(event_types, 'unchanged') AS changed,
        row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at, observation_id) AS rn FROM typed),
    r AS (
      SELECT listing_id, 0::BIGINT AS rn, NULL::BIGINT AS observation_id, 3600::BIGINT AS ttl, 0::BIGINT AS u, 0::BIGINT AS f
      FROM (SELECT DISTINCT listing_id FROM v)
      UNION ALL
      SELECT v.listing_id, v.rn, v.observation_id,
        CASE WHEN v.outcome <> 'ok' THEN least(86400, r.ttl * CAST(power(2, least(r.f + 1, 5)) AS BIGINT))
          WHEN NOT v.available THEN 86400 WHEN v.changed THEN greatest(900, r.ttl // 2)
          ELSE least(86400, greatest(900, CASE WHEN r.u + 1 >= 3 THEN r.ttl * 2 ELSE r.ttl END)) END,
        CASE WHEN v.outcome <> 'ok' THEN r.u WHEN v.changed THEN 0 ELSE r.u + 1 END,
        CASE WHEN v.outcome <> 'ok' THEN r.f + 1 ELSE 0 END
      FROM r JOIN v ON v.listing_id = r.listing_id AND v.rn = r.rn + 1
    )
    SELECT listing_id, observation_id, ttl, u AS unchanged_in_a_row, f AS failures_in_a_row FROM r WHERE rn > 0""",
)
def adaptive_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.with_previous_offer(views.observations(spark, sf_dir))
    visits = rows.select(
        "listing_id", "observation_id", "scraped_at", "outcome", "available",
        (~F.array_contains("event_types", "unchanged")).alias("changed"),
    )
    return monitoring.revisit_intervals(visits).select(
        "listing_id", "observation_id", "ttl", "unchanged_in_a_row", "failures_in_a_row"
    )


def promo_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as promotion observations: three of five kinds show a promotion."""
    k, at = F.col("k"), F.col("ts")
    promo = F.struct(
        F.lit("active").alias("status"),
        F.timestamp_micros(F.unix_micros(F.date_trunc("day", at)) + (k % 7 - 1) * 43_200_000_000).alias("expires_at"),
        F.when(k % 10 == 3, "other").otherwise("sku").alias("sku"),
        F.lit(None).cast("string").alias("product_id"),
    )
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", "event_type", utc("ts").alias("ts"), views.prop_k().alias("k"))
        .select(
            F.col("user_id").alias("listing_id"), at.alias("at"), F.col("event_id").alias("seq"),
            F.lit(" sku ").alias("sku"), F.lit("p").alias("product_id"),
            F.when(F.col("event_type").isin("view", "click", "purchase"), promo).alias("promo"),
        )
    )


PROMO_SQL = """
po AS (
  SELECT user_id AS listing_id, ts AS tm, 0 AS tick, event_id AS seq, event_type IN ('view', 'click', 'purchase') AS seen,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN date_trunc('day', ts)::TIMESTAMP + to_hours(12 * (k % 7 - 1)) END AS expires
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
  WHERE NOT (k % 10 = 3 AND event_type IN ('view', 'click', 'purchase'))
),
allp AS (
  SELECT * FROM po UNION ALL
  SELECT listing_id, expires, 1, seq, false, NULL FROM po WHERE seen AND expires > tm
),
num AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY tm, tick, seq) AS rn FROM allp),
step AS (
  SELECT listing_id, rn, tm, tick, seq, seen, CASE WHEN seen THEN CASE WHEN expires <= tm THEN 'expired' ELSE 'active' END END AS status, expires FROM num
)"""


@query(
    "promo_transitions",
    "WITH RECURSIVE " + PROMO_SQL + """,
    walk AS (
      SELECT listing_id, 0::BIGINT AS rn, NULL::TIMESTAMP AS tm, 0 AS tick, NULL::BIGINT AS seq, NULL::VARCHAR AS status,
        NULL::TIMESTAMP AS expires, NULL::VARCHAR AS event_type FROM (SELECT DISTINCT listing_id FROM step)
      UNION ALL
      SELECT s.listing_id, s.rn, s.tm, s.tick, s.seq,
        CASE WHEN s.seen THEN s.status WHEN w.status = 'active' AND w.expires <= s.tm THEN 'expired' ELSE w.status END,
        CASE WHEN s.seen THEN s.expires ELSE w.expires END,
        CASE WHEN s.seen THEN
            CASE WHEN w.status IS DISTINCT FROM 'active' AND s.status = 'active' THEN 'promotion_activated'
              WHEN w.status = 'active' AND s.status = 'expired' THEN 'promotion_expired'
              WHEN w.status = 'active' AND s.status = 'active' AND w.expires IS DISTINCT FROM s.expires THEN 'promotion_updated' END
          WHEN w.status = 'active' AND w.expires <= s.tm THEN 'promotion_expired' END
      FROM walk w JOIN step s ON s.listing_id = w.listing_id AND s.rn = w.rn + 1
    )
    SELECT listing_id, epoch_us(tm) AS at_us, seq, event_type, CASE WHEN tick = 1 THEN 'wall_clock' ELSE 'observation' END AS source
    FROM walk WHERE event_type IS NOT NULL""",
)
def promo_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.promotion_transitions(promo_observations(spark, sf_dir)).select(
        "listing_id", F.unix_micros("at").alias("at_us"), "seq", "event_type", "source"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("user:"), (F.col("user_id") % 20).cast("string")).alias("identity"),
        F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("host"),
        F.concat(F.lit("url-"), F.col("user_id").cast("string")).alias("url"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"),
        F.when(F.col("event_type") == "error", F.when(views.prop_k() < 70, "blocked").otherwise("extraction")).alias("failure_kind"),
        utc("ts").alias("at"),
    )


QUOTA_LIMIT, QUOTA_WINDOW = 4, 14400


@query(
    "quota_audit",
    f"""WITH RECURSIVE q AS (SELECT event_id AS request_id, 'user:' || CAST(user_id % 20 AS VARCHAR) AS identity, epoch_us(ts) / 1000000 AS tm,
      row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
      SELECT identity, 0::BIGINT AS rn, NULL::BIGINT AS request_id, {QUOTA_LIMIT}::DOUBLE AS tokens, NULL::DOUBLE AS tm, false AS allowed,
        {QUOTA_LIMIT}::DOUBLE AS filled FROM (SELECT DISTINCT identity FROM q)
      UNION ALL
      SELECT identity, rn, request_id, CASE WHEN filled >= 1 - 1e-9 THEN greatest(0, filled - 1) ELSE filled END, tm, filled >= 1 - 1e-9, filled
      FROM (SELECT q.identity, q.rn, q.request_id, q.tm, CASE WHEN w.tm IS NULL THEN w.tokens ELSE
          least({QUOTA_LIMIT}::DOUBLE, w.tokens + greatest(0, q.tm - w.tm) * ({QUOTA_LIMIT}::DOUBLE / {QUOTA_WINDOW})) END AS filled
        FROM walk w JOIN q ON q.identity = w.identity AND q.rn = w.rn + 1)
    )
    SELECT request_id, identity, allowed, CAST(floor(tokens) AS BIGINT) AS remaining,
      CASE WHEN allowed THEN 0 ELSE greatest(1, CAST(ceil((1 - tokens) / ({QUOTA_LIMIT}::DOUBLE / {QUOTA_WINDOW})) AS BIGINT)) END AS retry_after
    FROM walk WHERE rn > 0""",
)
def quota_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.quota_audit(requests(spark, sf_dir), QUOTA_LIMIT, QUOTA_WINDOW).select(
        "request_id", "identity", "allowed", "remaining", "retry_after"
    )


@query(
    "spacing_audit",
    """WITH RECURSIVE q AS (SELECT event_id AS request_id, 'host-' || CAST(user_id % 20 AS VARCHAR) AS host, 'url-' || CAST(user_id AS VARCHAR) AS url, epoch_us(ts) AS tm,
      row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
      SELECT host, 0::BIGINT AS rn, NULL::BIGINT AS request_id, NULL::BIGINT AS gate, []::STRUCT(u VARCHAR, t BIGINT)[] AS cooling, false AS admitted, NULL::VARCHAR AS code, 0::BIGINT AS retry_after
      FROM (SELECT DISTINCT host FROM q)
      UNION ALL
      SELECT host, rn, request_id, CASE WHEN twice OR soon THEN gate ELSE tm + 1800000000 END, CASE WHEN twice OR soon THEN live ELSE list_append(live, {'u': url, 't': tm + 21600000000}) END,
        NOT (twice OR soon), CASE WHEN twice THEN 'DUPLICATE_REQUEST' WHEN soon THEN 'RATE_LIMITED' END,
        CASE WHEN twice THEN greatest(1, (list_filter(live, lambda x: x.u = url)[1].t - tm) // 1000000) WHEN soon THEN greatest(1, (gate - tm) // 1000000) ELSE 0 END
      FROM (SELECT *, len(list_filter(live, lambda x: x.u = url)) > 0 AS twice, coalesce(gate > tm, false) AS soon
        FROM (SELECT q.host, q.rn, q.request_id, q.url, q.tm, w.gate, list_filter(w.cooling, lambda x: x.t > q.tm) AS live
          FROM walk w JOIN q ON q.host = w.host AND q.rn = w.rn + 1))
    )
    SELECT request_id, host, admitted, code, retry_after FROM walk WHERE rn > 0""",
)
def spacing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.spacing_audit(requests(spark, sf_dir), 21600, 1800).select(
        "request_id", "host", "admitted", "code", "retry_after"
    )


@query(
    "store_pauses",
    """WITH r AS (SELECT event_id AS request_id, 'host-' || CAST(user_id % 20 AS VARCHAR) AS host, ts, event_type <> 'error' AS ok,
        event_type = 'error' AND CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) < 70 AS hit FROM events),
    i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, request_id) AS island FROM r),
    s AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY ts, request_id) AS n FROM i)
    SELECT request_id, host, CAST(n AS BIGINT) AS store_failures,
      CASE WHEN hit THEN CAST(least(300, 30 * power(2, n - 1)) AS BIGINT) END AS pause_seconds FROM s""",
)
def store_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.store_pauses(requests(spark, sf_dir)).select("request_id", "host", "store_failures", "pause_seconds")


@query(
    "health_timeline",
    """WITH r AS (SELECT event_id AS request_id, 'host-' || CAST(user_id % 20 AS VARCHAR) AS host, ts, event_type = 'error' AS failed FROM events),
    i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts, request_id) AS island FROM r),
    s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY ts, request_id) AS n FROM i),
    o AS (SELECT *, lag(n) OVER w AS before_n, lag(ts) OVER w AS before_ts FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, request_id))
    SELECT request_id, host, CASE WHEN before_n >= 2 THEN CASE WHEN ts >= before_ts + INTERVAL 1800 SECOND THEN 'half_open' ELSE 'open' END
        ELSE 'closed' END AS state_before, CASE WHEN n >= 2 THEN 'open' ELSE 'closed' END AS state_after FROM o""",
)
def health_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.health_timeline(requests(spark, sf_dir), threshold=2, cooldown=1800).select(
        "request_id", "host", "state_before", "state_after"
    )


@query(
    "budget_use",
    """SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER w AS BIGINT) AS queries_used, CAST(count(*) OVER w AS BIGINT) AS external_used,
      CAST(sum(l_quantity) OVER w AS BIGINT) <= 100 AND count(*) OVER w <= 4 AS within_budget
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""",
)
def budget_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_quantity").cast("long").alias("queries"), F.lit(1).alias("external"),
    )
    used = monitoring.budget_use(
        rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], {"queries": 100, "external": 4}
    )
    return used.select("l_orderkey", "l_linenumber", "queries_used", "external_used", "within_budget")


@query(
    "failure_kinds",
    """SELECT CASE WHEN o_orderstatus = 'P' THEN 'gone' WHEN o_orderkey % 7 = 0 THEN 'extraction'
        WHEN o_orderkey % 20 = 4 THEN 'not_found' WHEN o_orderpriority = '1-URGENT' THEN 'local_throttle'
        WHEN o_orderpriority = '2-HIGH' THEN 'infra' WHEN o_orderpriority = '3-MEDIUM' THEN 'blocked'
        WHEN o_orderpriority = '5-LOW' THEN 'timeout' WHEN o_orderkey % 3 = 0 THEN 'timeout' ELSE 'upstream_error' END AS kind, count(*) AS failures
    FROM orders GROUP BY 1""",
)
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    code = (
        F.when(priority == "1-URGENT", "RATE_LIMITED").when(priority == "2-HIGH", "BROWSER_QUEUE_TIMEOUT")
        .when(priority == "3-MEDIUM", "UPSTREAM_WAF_BLOCKED").when(priority == "5-LOW", "FETCH_TIMEOUT").otherwise("HTTP_ERROR")
    )
    kind = monitoring.failure_kind(
        F.when(F.col("o_orderstatus") == "P", "gone").when(key % 7 == 0, "parse").otherwise("request"),
        code,
        F.when(key % 20 == 4, 404).otherwise(500),
        F.when(key % 3 == 0, "Timed Out while reading").otherwise("bad gateway"),
    )
    return table(spark, sf_dir, "orders").groupBy(kind.alias("kind")).agg(F.count("*").alias("failures"))


@query(
    "revisit_list",
    f"""SELECT url, priority, epoch_us(enqueued_at) AS enqueued_us FROM (
      SELECT 'item-' || CAST(o_custkey AS VARCHAR) AS url, CAST(left(o_orderpriority, 1) AS INTEGER) * 10 AS priority, o_orderdate AS enqueued_at,
        row_number() OVER (PARTITION BY o_custkey ORDER BY left(o_orderpriority, 1) DESC, o_orderdate) AS rn
      FROM orders WHERE o_orderdate <= TIMESTAMP '{NOW}') WHERE rn = 1""",
)
def revisit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("item-"), F.col("o_custkey").cast("string")).alias("url"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 10).alias("priority"),
        utc("o_orderdate").alias("enqueued_at"), utc("o_orderdate").alias("next_scrape_at"),
    )
    return monitoring.revisit_list(urls, now()).select("url", "priority", F.unix_micros("enqueued_at").alias("enqueued_us"))


@query(
    "sweep",
    "WITH " + STATE_SQL + """, sw AS (SELECT listing_id, store, work_class FROM work)
    SELECT store, CASE WHEN store IN ('store-1', 'store-5') THEN 'deferred' ELSE 'refresh' END AS action, count(*) AS listings
    FROM (SELECT * FROM st WHERE is_due) GROUP BY ALL""",
)
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = listing_state(spark, sf_dir)
    pauses = listings.select("host").distinct().where(F.col("host").isin("host-1", "host-5")).withColumn(
        "paused_until", monitoring.plus_seconds(now(), 300)
    )
    swept = monitoring.sweep(listings, pauses, now())
    return swept.groupBy("store", "action").agg(F.count("*").alias("listings"))
