"""Monitoring: due work, backoff, revisit intervals and promotion life cycles."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..recurrences import Claims, RevisitInterval, Spacing, TokenBucket, url_key
from ..sequences import KeyedSequence, fold
from .changes import SILENT_FAILURES


@dataclass(frozen=True)
class Cadence:
    """The default schedule, in seconds unless named otherwise."""

    interval_hours: int = 12
    jitter: int = 600
    promotion_grace: int = 60
    retry_base: int = 300
    retry_max: int = 3600
    defer: int = 60
    lease: int = 300
    batch: int = 10


DEFAULT = Cadence()
# Failure classification.
THROTTLE_CODES = ("DUPLICATE_REQUEST", "RATE_LIMITED")
BROWSER_CODES = (
    "BROWSER_LAUNCH_ERROR", "BROWSER_INFRASTRUCTURE_UNAVAILABLE", "BROWSER_QUEUE_SATURATED",
    "BROWSER_QUEUE_TIMEOUT", "BROWSER_JOB_CANCELLED",
)
BLOCK_CODES = ("UPSTREAM_BLOCKED", "UPSTREAM_WAF_BLOCKED", "AUTH_REQUIRED")
TIMEOUT_WORDS = ("timeout", "timed out", "network_timeout")
SEARCH_TRIP_CODES = ("UPSTREAM_BLOCKED", "UPSTREAM_WAF_BLOCKED", "SEARCH_INCOMPLETE_RESPONSE")
STORE_SIDE = ("blocked", "timeout", "upstream_error")


def plus_seconds(at: Column, seconds: Column | int) -> Column:
    amount = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(at) + amount.cast("long") * F.lit(1_000_000))


def seconds_between(start: Column, end: Column) -> Column:
    return ((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)).cast("long")


def failure_kind(error_class: Column, code: Column, status: Column, message: Column) -> Column:
    """Coarse kind of a failed check from its class (gone, parse, request), code and text."""
    is_timeout = F.coalesce(code.contains("TIMEOUT"), F.lit(False))
    for word in TIMEOUT_WORDS:
        is_timeout = is_timeout | F.coalesce(F.lower(message).contains(word), F.lit(False))
    return (
        F.when(error_class == "gone", "gone")
        .when(error_class == "parse", "extraction")
        .when(error_class != "request", "upstream_error")
        .when(status.isin(404, 410), "not_found")
        .when(code.isin(*THROTTLE_CODES), "local_throttle")
        .when(code.isin(*BROWSER_CODES), "infra")
        .when(code.isin(*BLOCK_CODES), "blocked")
        .when(is_timeout, "timeout")
        .otherwise("upstream_error")
    )


def trips_search(error_class: Column, code: Column) -> Column:
    """Failures that say the store blocks searches: block codes and broken connections."""
    return ((error_class == "request") & code.isin(*SEARCH_TRIP_CODES)) | (error_class == "connection")


def promotion_lapsed(now: Column) -> Column:
    return F.coalesce(
        (F.col("promotion_status") == "active") & (F.col("promotion_expires_at") <= now), F.lit(False)
    )


def promotion_in_force(now: Column) -> Column:
    return F.coalesce(
        (F.col("promotion_status") == "active") & (F.col("promotion_expires_at") > now), F.lit(False)
    )


def lease_free(now: Column, column: str = "check_claim_expires_at") -> Column:
    return F.col(column).isNull() | (F.col(column) <= now)


def due(now: Column) -> Column:
    scheduled = F.coalesce(F.col("next_check_at") <= now, F.lit(False))
    return (
        F.col("monitoring_enabled")
        & (F.col("status") == "active")
        & lease_free(now)
        & (scheduled | promotion_lapsed(now))
    )


def due_at(now: Column) -> Column:
    """When a listing is due, counting a lapsed promotion as due now. NULL: never."""
    return F.least(F.col("next_check_at"), F.when(promotion_lapsed(now), now))


def work_class(now: Column) -> Column:
    """1 lapsed or expired promotion, 2 retry, 3 regular."""
    expired = (F.col("promotion_status") == "expired") & F.col("promotion_expires_at").isNotNull()
    return (
        F.when(promotion_lapsed(now) | F.coalesce(expired, F.lit(False)), 1)
        .when(F.col("consecutive_failures") > 0, 2)
        .otherwise(3)
    )


def work_list(
    listings: DataFrame, now: Column, limit: int | None, worker: str = "batch", cadence: Cadence = DEFAULT
) -> DataFrame:
    """The next ``limit`` due listings with lease columns, by a top-k without a global sort; without a limit all, in no order."""
    late = F.coalesce(F.greatest(F.lit(0).cast("long"), seconds_between(F.col("next_check_at"), now)), F.lit(0).cast("long"))
    rows = listings.where(due(now)).withColumn("work_class", work_class(now))
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be 1 or more")
        rows = rows.orderBy("work_class", F.asc_nulls_last("next_check_at"), "listing_id").limit(limit)
    return rows.withColumns(
        {
            "check_worker_id": F.lit(worker),
            "check_claimed_at": now,
            "check_claim_expires_at": plus_seconds(now, max(30, cadence.lease)),
            "scheduled_for": F.col("next_check_at"),
            "delay_seconds": late,
        }
    )


def interleave(work: DataFrame, order: list[str], store: str = "store") -> DataFrame:
    """Round-robin position over stores, keeping each store's order.

    For a work list that ``work_list`` has already cut to its limit: the
    position needs the list's own order, which is one short sorted run.
    """
    in_store = Window.partitionBy(store).orderBy(*order)
    ranked = work.withColumn("turn", F.row_number().over(in_store))
    firsts = ranked.where("turn = 1").select(
        F.col(store).alias("__s"), *[F.col(c).alias(f"__first_{i}") for i, c in enumerate(order)]
    )
    first_cols = [f"__first_{i}" for i in range(len(order))]
    return (
        ranked.join(firsts, F.coalesce(F.col(store), F.lit("")) == F.coalesce(F.col("__s"), F.lit("")))
        .orderBy("turn", *first_cols)
        .drop("__s", *first_cols)
    )


def dashboard(listings: DataFrame, now: Column) -> DataFrame:
    """All monitoring figures in one pass."""
    active = F.col("monitoring_enabled") & (F.col("status") == "active")
    scheduled = F.coalesce(F.col("next_check_at") <= now, F.lit(False))
    is_due = due(now)
    claimed = F.coalesce(F.col("check_claim_expires_at") > now, F.lit(False))
    oldest = F.min(F.when(is_due, due_at(now)))
    return listings.agg(
        F.count_if(active).alias("monitored_active"),
        F.count_if(is_due).alias("due_count"),
        F.count_if(claimed).alias("claimed_count"),
        F.count_if(F.col("monitoring_enabled") & (F.col("consecutive_failures") > 0)).alias("failed_count"),
        F.count_if(promotion_lapsed(now)).alias("promotions_expiring_now"),
        F.count_if(active & (F.col("promotion_status") == "expired") & scheduled).alias(
            "promotions_expired_awaiting_refresh"
        ),
        F.unix_micros(oldest).alias("oldest_due_us"),
        seconds_between(oldest, now).alias("max_delay_seconds"),
        F.unix_micros(
            F.min(F.when(active & (F.col("next_check_at") > now), F.col("next_check_at")))
        ).alias("next_check_us"),
    )


def jitter(key: Column, day: Column, most: int) -> Column:
    """0..most seconds, the same for a listing on a day (a retry gives the same plan)."""
    if most <= 0:
        return F.lit(0)
    return F.pmod(F.xxhash64(key, day), F.lit(most + 1))


def next_regular(now: Column, key: Column, cadence: Cadence = DEFAULT) -> Column:
    wait = F.lit(max(1, cadence.interval_hours) * 3600) + jitter(key, F.to_date(now), cadence.jitter)
    return plus_seconds(now, wait)


def next_check(now: Column, regular: Column, promotion_expires_at: Column, cadence: Cadence = DEFAULT) -> Column:
    """The regular time, or the promotion's end plus grace if that is earlier; now if it has ended."""
    return F.when(promotion_expires_at.isNull(), regular).when(promotion_expires_at <= now, now).otherwise(
        F.least(regular, plus_seconds(promotion_expires_at, max(0, cadence.promotion_grace)))
    )


def retry_at(now: Column, failures: Column, retry_after: Column, cadence: Cadence = DEFAULT) -> Column:
    base = max(30, cadence.retry_base)
    cap = max(base, cadence.retry_max)
    n = F.least(F.greatest(failures, F.lit(1)), F.lit(40)).cast("int")
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), n - 1))
    hint = F.when(retry_after > 0, F.least(retry_after, F.lit(cadence.retry_max)))
    return plus_seconds(now, F.greatest(delay, F.coalesce(hint, F.lit(0))))


def deferred_until(now: Column, retry_after: Column, cadence: Cadence = DEFAULT) -> Column:
    base = F.greatest(F.lit(30), F.coalesce(retry_after, F.lit(0)), F.lit(cadence.defer))
    return plus_seconds(now, F.least(base, F.greatest(base, F.lit(cadence.retry_max))))


def retry_schedule(
    checks: DataFrame, cadence: Cadence = DEFAULT, cut_rows: int | None = None
) -> DataFrame:
    """Failures in a row per listing and when each failed or deferred check runs again.

    A success ends a run of failures; a deferral neither counts nor ends it.
    """
    silent = F.coalesce(F.col("failure_kind").isin(*SILENT_FAILURES), F.lit(False))
    failed = (F.col("outcome") == "failed") & ~silent
    now = F.col("scraped_at")
    rows = (
        KeyedSequence(checks, ["listing_id"], ["scraped_at", "observation_id"], cut_rows)
        .streak("consecutive_failures", failed, F.col("outcome") == "ok")
        .result()
    )
    when = F.when(failed, retry_at(now, F.col("consecutive_failures"), F.col("retry_after"), cadence)).when(
        silent, deferred_until(now, F.col("retry_after"), cadence)
    )
    return rows.withColumn("next_check_at", when)


def initial_schedule(listings: DataFrame, now: Column, cadence: Cadence = DEFAULT) -> DataFrame:
    """Schedule of listings on creation: unchecked ones are due now, inactive ones never."""
    active = F.col("status") == "active"
    checked = F.col("checked_at")
    promo = F.when(F.col("promotion_status") == "active", F.col("promotion_expires_at"))
    regular = F.when(checked.isNull(), now).otherwise(next_regular(checked, F.col("listing_id"), cadence))
    at = F.when(checked.isNull(), now).otherwise(next_check(now, regular, promo, cadence))
    return listings.withColumns(
        {
            "monitoring_enabled": active,
            "next_regular_check_at": F.when(active, regular),
            "next_check_at": F.when(active, at),
        }
    )


# --- promotions -------------------------------------------------------------------------------

PROMO_STATE = ["status", "expires_at"]


def promotion_transitions(
    observations: DataFrame, expiry_ticks: bool = True, cut_rows: int | None = None
) -> DataFrame:
    """Promotion events per listing: activated, updated, expired.

    Input rows: listing_id, at, seq, sku, product_id, promo STRUCT(status,
    expires_at, sku, product_id) or NULL for a check without a promotion. A
    promotion of another variant is ignored. With ``expiry_ticks`` every end
    time is itself a point in time at which the promotion may lapse, as a
    timer would see it in a stream.
    """
    promo = F.col("promo")
    other = lambda mine, theirs: F.coalesce(
        (F.trim(mine) != "") & (F.trim(theirs) != "") & (F.trim(mine) != F.trim(theirs)), F.lit(False)
    )
    rows = observations.withColumn(
        "__ignored",
        promo.isNotNull()
        & (other(F.col("sku"), promo["sku"]) | other(F.col("product_id"), promo["product_id"])),
    ).where(~F.col("__ignored")).select(
        "listing_id", "at", "seq", promo["status"].alias("status"), promo["expires_at"].alias("expires_at"),
        promo.isNotNull().alias("seen"), F.lit("observation").alias("source"),
    )
    if expiry_ticks:
        ticks = rows.where(F.col("seen") & (F.col("expires_at") > F.col("at"))).select(
            "listing_id", F.col("expires_at").alias("at"), "seq", F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("timestamp").alias("expires_at"), F.lit(False).alias("seen"),
            F.lit("wall_clock").alias("source"),
        )
        rows = rows.unionByName(ticks)
    at, expires = F.col("at"), F.col("expires_at")
    now_status = F.when(expires <= at, "expired").otherwise(F.col("status"))
    rows = rows.withColumns({"new_status": F.when(F.col("seen"), now_status), "__tick": (F.col("source") == "wall_clock").cast("int")})
    seen = F.when(F.col("seen"), F.struct(F.col("new_status").alias("status"), expires.alias("expires_at"), at.alias("at"), F.col("__tick"), F.col("seq")))
    blank = F.when(~F.col("seen"), F.struct(at.alias("at"), F.col("__tick"), F.col("seq")))
    rows = (
        KeyedSequence(rows, ["listing_id"], ["at", "__tick", "seq"], cut_rows)
        .carry({"prior": seen, "blank": blank})
        .result()
    )
    prior, last_blank = F.col("prior"), F.col("blank")
    later = last_blank > F.struct(prior["at"].alias("at"), prior["__tick"].alias("__tick"), prior["seq"].alias("seq"))
    lapsed = F.coalesce((prior["status"] == "active") & later & (last_blank["at"] >= prior["expires_at"]), F.lit(False))
    rows = rows.withColumn("old_status", F.when(lapsed, "expired").otherwise(prior["status"]))
    was_active = F.coalesce(F.col("old_status") == "active", F.lit(False))
    moved = ~prior["expires_at"].eqNullSafe(expires) & expires.isNotNull()
    event = (
        F.when(
            F.col("seen"),
            F.when(~was_active & (F.col("new_status") == "active"), "promotion_activated")
            .when(was_active & (F.col("new_status") == "expired"), "promotion_expired")
            .when(was_active & (F.col("new_status") == "active") & moved, "promotion_updated"),
        )
        .when(was_active & (prior["expires_at"] <= at), "promotion_expired")
    )
    return (
        rows.withColumn("event_type", event)
        .where(F.col("event_type").isNotNull())
        .select("listing_id", "at", "seq", "source", "event_type", F.col("old_status").alias("previous_status"))
    )


def expire_promotions(listings: DataFrame, now: Column) -> DataFrame:
    """Listing state after the wall clock passed ``now``; lapsed promotions are due at once."""
    lapsed = promotion_lapsed(now)
    return listings.withColumns(
        {
            "promotion_expired": lapsed,
            "promotion_status": F.when(lapsed, "expired").otherwise(F.col("promotion_status")),
            "next_check_at": F.when(lapsed, now).otherwise(F.col("next_check_at")),
        }
    )


# --- revisit intervals ------------------------------------------------------------------------

# Revisit interval limits in seconds.
TTL_START, TTL_MIN, TTL_MAX = 3600, 900, 86400
UNCHANGED_BEFORE_LONGER = 3
TTL_INITIAL = [TTL_START, 0, 0]

TTL_OUT = T.StructType(
    [
        T.StructField("ttl", T.LongType()),
        T.StructField("unchanged_in_a_row", T.LongType()),
        T.StructField("failures_in_a_row", T.LongType()),
    ]
)


def ttl_step(state, row):
    ttl, unchanged, failures = state
    if row.outcome != "ok":
        failures += 1
        ttl = min(TTL_MAX, ttl * 2 ** min(failures, 5))
    else:
        failures = 0
        unchanged = 0 if row.changed else unchanged + 1
        if not row.available:
            ttl = TTL_MAX
        elif row.changed:
            ttl = max(TTL_MIN, ttl // 2)
        else:
            longer = ttl * 2 if unchanged >= UNCHANGED_BEFORE_LONGER else ttl
            ttl = min(TTL_MAX, max(TTL_MIN, longer))
    ttl = max(1, ttl)
    return [ttl, unchanged, failures], (ttl, unchanged, failures)


def revisit_intervals(visits: DataFrame, cut_rows: int | None = None) -> DataFrame:
    """Revisit interval after each visit (outcome, changed, available), and the next due time."""
    intervals = RevisitInterval(TTL_START, TTL_MIN, TTL_MAX, UNCHANGED_BEFORE_LONGER)
    rows = fold(visits, ["listing_id"], ["scraped_at", "observation_id"], intervals, TTL_OUT, cut_rows)
    return rows.withColumn("next_scrape_at", plus_seconds(F.col("scraped_at"), F.col("ttl")))


def revisit_list(urls: DataFrame, now: Column) -> DataFrame:
    """Due URLs, one row each, highest priority first, then first come first served.

    Within a URL the row with the highest priority stands, oldest first.
    """
    rest = [c for c in urls.columns if c != "url"]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("priority")).alias("p"), F.col("enqueued_at")))
    return (
        urls.where(F.col("next_scrape_at") <= now)
        .groupBy("url")
        .agg(best.alias("__row"))
        .select("url", "__row.*")
        .orderBy(F.desc("priority"), "enqueued_at", "url")
    )


# --- audits over request and outcome logs -----------------------------------------------------

QUOTA_OUT = T.StructType(
    [
        T.StructField("allowed", T.BooleanType()),
        T.StructField("remaining", T.LongType()),
        T.StructField("retry_after", T.LongType()),
    ]
)


def quota_step(limit: int, window_seconds: int):
    """Token bucket: the state is (tokens, time of the last request in seconds)."""
    if limit <= 0 or window_seconds <= 0:
        raise ValueError("limit and window must be above zero")
    rate = limit / window_seconds

    def step(state, row):
        tokens, at = state
        now = row.at_us / 1_000_000
        if at is not None:
            tokens = min(float(limit), tokens + max(0.0, now - at) * rate)
        allowed = tokens >= 1 - 1e-9
        if allowed:
            tokens = max(0.0, tokens - 1)
        wait = 0 if allowed else max(1, math.ceil((1 - tokens) / rate))
        return [tokens, now], (allowed, max(0, math.floor(tokens)), wait)

    return step, [float(limit), None]


def quota_audit(
    requests: DataFrame, limit: int, window_seconds: int, cut_rows: int | None = None
) -> DataFrame:
    """Token bucket per identity over a request log: allowed, whole tokens left, retry after."""
    rows = requests.withColumn("at_us", F.unix_micros("at"))
    return fold(rows, ["identity"], ["at_us", "request_id"], TokenBucket(limit, window_seconds), QUOTA_OUT, cut_rows).drop("at_us")


SPACING_OUT = T.StructType(
    [T.StructField("admitted", T.BooleanType()), T.StructField("code", T.StringType()), T.StructField("retry_after", T.LongType())]
)


def spacing_step(url_cooldown: float, host_spacing: float):
    """Two gates of a host: the state is (next free time, URLs whose cooldown still runs).

    The host spacing bounds how many URLs can be in cooldown at a time.
    """

    cooldown, spacing = round(url_cooldown * 1_000_000), round(host_spacing * 1_000_000)

    def step(state, row):
        host_ok, urls = state
        now = row.at_us
        urls = {u: t for u, t in urls.items() if t > now}
        url = url_key(row.url)
        if url in urls:
            return [host_ok, urls], (False, "DUPLICATE_REQUEST", max(1, (urls[url] - now) // 1_000_000))
        if host_ok is not None and host_ok > now:
            return [host_ok, urls], (False, "RATE_LIMITED", max(1, (host_ok - now) // 1_000_000))
        urls[url] = now + cooldown
        return [now + spacing, urls], (True, None, 0)

    return step, [None, {}]


def spacing_audit(
    fetches: DataFrame, url_cooldown: float = 300, host_spacing: float = 15.0, cut_rows: int | None = None
) -> DataFrame:
    """Which fetches a per-URL cooldown and a per-host spacing would have let through.

    A rejected fetch moves neither gate.
    """
    rows = fetches.withColumn("at_us", F.unix_micros("at"))
    return fold(rows, ["host"], ["at_us", "request_id"], Spacing(url_cooldown, host_spacing), SPACING_OUT, cut_rows).drop("at_us")


CLAIM_TTL = 3600
CLAIM_OUT = T.StructType([T.StructField("claimed", T.BooleanType())])


def claim_step(ttl: int = CLAIM_TTL):
    """First sight of a fingerprint, and again once its time-to-live has passed."""

    def step(until, row):
        now = row.at_us / 1_000_000
        if until is None or now >= until:
            return now + ttl, (True,)
        return until, (False,)

    return step, None


def claims(requests: DataFrame, ttl: int = CLAIM_TTL, cut_rows: int | None = None) -> DataFrame:
    """Add ``claimed``: the request is no repeat of its fingerprint within the time-to-live."""
    rows = requests.withColumn("at_us", F.unix_micros("at"))
    return fold(rows, ["fingerprint"], ["at_us", "request_id"], Claims(ttl), CLAIM_OUT, cut_rows).drop("at_us")


def store_pauses(
    outcomes: DataFrame, base: int = 30, most: int = 300, cut_rows: int | None = None
) -> DataFrame:
    """Escalating pause per host after failures on the store's side; a success ends it."""
    hit = (F.col("outcome") == "failed") & F.coalesce(F.col("failure_kind").isin(*STORE_SIDE), F.lit(False))
    rows = (
        KeyedSequence(outcomes, ["host"], ["at", "request_id"], cut_rows)
        .streak("store_failures", hit, F.col("outcome") == "ok")
        .result()
    )
    n = F.least(F.col("store_failures"), F.lit(40)).cast("int")
    seconds = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), n - 1)).cast("long")
    return rows.withColumn("pause_seconds", F.when(hit, seconds)).withColumn(
        "paused_until", plus_seconds(F.col("at"), F.col("pause_seconds"))
    )


def health_timeline(
    outcomes: DataFrame, threshold: int = 3, cooldown: int = 120, cut_rows: int | None = None
) -> DataFrame:
    """State of a store's circuit before and after each outcome (closed, open, half_open)."""
    failed = F.col("outcome") == "failed"
    at = F.col("at")
    rows = (
        KeyedSequence(outcomes, ["host"], ["at", "request_id"], cut_rows)
        .streak("failures", failed, F.col("outcome") == "ok")
        .carry({"__prev": F.struct(F.col("failures").alias("n"), failed.alias("failed"))})
        .carry({"opened_at": F.when(failed & (F.col("failures") >= threshold), at)})
        .result()
    )
    was_open = F.coalesce(F.col("__prev.n") >= threshold, F.lit(False))
    cooled = F.coalesce(at >= plus_seconds(F.col("opened_at"), cooldown), F.lit(False))
    return rows.withColumns(
        {
            "state_before": F.when(was_open, F.when(cooled, "half_open").otherwise("open")).otherwise("closed"),
            "state_after": F.when(F.col("failures") >= threshold, "open").otherwise("closed"),
            "opened_at": F.when(was_open, F.col("opened_at")),
        }
    ).drop("__prev")


HEALTH_OUT = T.StructType([T.StructField("state_before", T.StringType()), T.StructField("state_after", T.StringType())])


def health_step(threshold: int = 3, cooldown: int = 120):
    """The circuit as a recurrence, for streams: the state is (failures in a row, time opened)."""

    def step(state, row):
        failures, opened = state
        before = "closed"
        if failures >= threshold:
            before = "half_open" if row.at_us >= opened + cooldown * 1_000_000 else "open"
        failures = failures + 1 if row.outcome == "failed" else 0
        opened = int(row.at_us) if failures >= threshold else None
        return [failures, opened], (before, "open" if failures >= threshold else "closed")

    return step, [0, None]


def budget_use(
    attempts: DataFrame, keys: list[str], order: list[str], budgets: Mapping[str, int], cut_rows: int | None = None
) -> DataFrame:
    """Running totals of the budgeted columns and whether each attempt stays inside all budgets."""
    sequence = KeyedSequence(attempts, keys, order, cut_rows).running(
        {f"{name}_used": F.col(name).cast("long") for name in budgets}
    )
    inside = F.lit(True)
    for name, most in budgets.items():
        inside = inside & (F.col(f"{name}_used") <= most)
    return sequence.result().withColumn("within_budget", inside)


# Attempts one store search may use.
SEARCH_BUDGETS = {"queries": 5, "external": 12, "navigations": 8}


def sweep(listings: DataFrame, pauses: DataFrame, now: Column, limit: int | None = None, cadence: Cadence = DEFAULT) -> DataFrame:
    """One periodic pass: due work, lapsed promotions, paused stores deferred, the rest to refresh.

    ``pauses`` is (host, paused_until), one row per host.
    """
    work = work_list(expire_promotions(listings, now), now, limit, cadence=cadence)
    joined = work.join(pauses, "host", "left")
    left = F.when(F.col("paused_until") > now, seconds_between(now, F.col("paused_until")))
    return joined.withColumn("action", F.when(left > 0, "deferred").otherwise("refresh")).withColumn(
        "next_check_at", F.when(left > 0, deferred_until(now, left, cadence)).otherwise(F.col("next_check_at"))
    )
