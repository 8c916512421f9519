"""Change detection over offer observations (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MONEY
from ..sequences import KeyedSequence

OFFER_FIELDS = ["price", "pix_price", "currency", "seller", "availability", "available"]
# Failures of our own spacing or browsers say nothing about the offer.
SILENT_FAILURES = ("local_throttle", "infra")
REMOVAL_STREAK = 3


def seller_key(seller: Column) -> Column:
    """Sellers compare without case and outer blanks; blank equals missing."""
    return F.nullif(F.lower(F.trim(seller)), F.lit(""))


def money_text(amount: Column) -> Column:
    return amount.cast(MONEY).cast("string")


def fingerprint(offer: Column) -> Column:
    """SHA-256 over the fields that make two offers the same."""
    fields = F.struct(
        offer["availability"].alias("availability"),
        offer["currency"].alias("currency"),
        money_text(offer["pix_price"]).alias("pix_price"),
        money_text(offer["price"]).alias("price"),
        seller_key(offer["seller"]).alias("seller"),
    )
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def same_offer(a: Column, b: Column) -> Column:
    """The equality classes of ``fingerprint`` without hashing."""
    return (
        a["availability"].eqNullSafe(b["availability"])
        & a["currency"].eqNullSafe(b["currency"])
        & a["pix_price"].eqNullSafe(b["pix_price"])
        & a["price"].eqNullSafe(b["price"])
        & seller_key(a["seller"]).eqNullSafe(seller_key(b["seller"]))
    )


def change_types(
    previous: Column, current: Column, outcome: Column, failure_kind: Column | None = None
) -> Column:
    """Event names of one observation, given the last good offer before it.

    Money compares as decimals, so 171 and 171.00 are the same price.
    """
    kind = F.lit(None).cast("string") if failure_kind is None else failure_kind
    moved = F.array_compact(
        F.array(
            F.when(~previous["price"].eqNullSafe(current["price"]), F.lit("price_changed")),
            F.when(
                ~seller_key(previous["seller"]).eqNullSafe(seller_key(current["seller"])),
                F.lit("seller_changed"),
            ),
            F.when(
                ~previous["availability"].eqNullSafe(current["availability"]),
                F.lit("availability_changed"),
            ),
            F.when(
                ~previous["availability"].eqNullSafe(current["availability"])
                & F.coalesce(
                    (current["availability"] == "out_of_stock") | ~current["available"],
                    F.lit(False),
                ),
                F.lit("out_of_stock"),
            ),
        )
    )
    one = lambda name: F.array(F.lit(name))
    return (
        F.when(kind.isin(*SILENT_FAILURES), F.array().cast("array<string>"))
        .when(outcome == "failed", one("scrape_failed"))
        .when(outcome == "removed", one("offer_removed"))
        .when(previous.isNull(), one("new_offer"))
        .when(same_offer(previous, current), one("unchanged"))
        .when(F.size(moved) == 0, one("price_changed"))
        .otherwise(moved)
    )


def with_previous_offer(observations: DataFrame, cut_rows: int | None = None) -> DataFrame:
    """Add ``previous`` (last good offer before the row), ``current`` and ``event_types``."""
    current = F.struct(*[F.col(c) for c in OFFER_FIELDS], F.col("scraped_at"))
    good = F.when(F.col("outcome") == "ok", current)
    rows = (
        KeyedSequence(observations, ["listing_id"], ["scraped_at", "observation_id"], cut_rows)
        .carry({"previous": good})
        .result()
        .withColumn("current", good)
    )
    kind = F.col("failure_kind") if "failure_kind" in observations.columns else None
    return rows.withColumn(
        "event_types", change_types(F.col("previous"), F.col("current"), F.col("outcome"), kind)
    )


def offer_events(observations: DataFrame, cut_rows: int | None = None) -> DataFrame:
    """One row per typed change event."""
    return with_previous_offer(observations, cut_rows).select(
        "listing_id",
        "observation_id",
        F.explode("event_types").alias("event_type"),
        F.col("previous").alias("before"),
        F.col("current").alias("after"),
        F.col("scraped_at").alias("detected_at"),
    )


def refresh_report(observations: DataFrame, cut_rows: int | None = None) -> DataFrame:
    """Per check: status and the offer before and after it."""
    rows = with_previous_offer(observations, cut_rows)
    types = F.col("event_types")
    status = (
        F.when(F.size(types) == 0, "deferred")
        .when(F.array_contains(types, "offer_removed"), "removed")
        .when(F.array_contains(types, "scrape_failed"), "scrape_failed")
        .when(F.array_contains(types, "out_of_stock"), "out_of_stock")
        .when(types == F.array(F.lit("unchanged")), "unchanged")
        .when(types == F.array(F.lit("new_offer")), "new_offer")
        .otherwise("changed")
    )
    view = lambda side: F.when(
        F.col(side).isNotNull(),
        F.struct(
            *[F.col(side)[f].alias(f) for f in [*OFFER_FIELDS, "scraped_at"]],
            fingerprint(F.col(side)).alias("fingerprint"),
        ),
    )
    return rows.select(
        "listing_id",
        "observation_id",
        "scraped_at",
        status.alias("status"),
        types.alias("events"),
        view("previous").alias("previous"),
        view("current").alias("current"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), at).alias("__row"))
        .select(*keys, "__row.*")
    )


def latest_snapshot(observations: DataFrame) -> DataFrame:
    good = observations.where(F.col("outcome") == "ok")
    return latest_per_key(good, ["listing_id"], ["scraped_at", "observation_id"])


def snapshot_as_of(
    events: DataFrame, snapshots: DataFrame, cut_rows: int | None = None
) -> DataFrame:
    """Add to every event the newest snapshot of its listing at or before it.

    Snapshots and events are laid in one sequence per listing, snapshots first
    at equal times, and the last snapshot is carried forward: one shuffle, no
    pair of rows is ever built.
    """
    event_row = F.struct(*[F.col(c) for c in events.columns])
    shot_row = F.struct(*[F.col(c) for c in snapshots.columns])
    event_type = events.select(event_row.alias("r")).schema["r"].dataType
    shot_type = snapshots.select(shot_row.alias("r")).schema["r"].dataType
    both = events.select(
        "listing_id",
        F.col("detected_at").alias("__at"),
        F.lit(1).alias("__side"),
        F.col("id").cast("string").alias("__id"),
        event_row.alias("__event"),
        F.lit(None).cast(shot_type).alias("__shot"),
    ).unionByName(
        snapshots.select(
            "listing_id",
            F.col("scraped_at").alias("__at"),
            F.lit(0).alias("__side"),
            F.col("id").cast("string").alias("__id"),
            F.lit(None).cast(event_type).alias("__event"),
            shot_row.alias("__shot"),
        )
    )
    rows = (
        KeyedSequence(both, ["listing_id"], ["__at", "__side", "__id"], cut_rows)
        .carry({"snapshot": F.col("__shot")})
        .result()
    )
    return rows.where(F.col("__event").isNotNull()).select("__event.*", "snapshot")


def extraction_streaks(
    checks: DataFrame, threshold: int = REMOVAL_STREAK, cut_rows: int | None = None
) -> DataFrame:
    """Extraction failures in a row, and whether the listing counts as removed.

    Anything else in between (a success, another failure, a deferral) starts the
    count again, and so does a removal.
    """
    extraction = F.coalesce(
        (F.col("outcome") == "failed") & (F.col("failure_kind") == "extraction"), F.lit(False)
    )
    rows = (
        KeyedSequence(checks, ["listing_id"], ["scraped_at", "observation_id"], cut_rows)
        .with_columns({"__ext": extraction})
        .streak("extraction_streak", F.col("__ext"), ~F.col("__ext"))
        .result()
    )
    gone = F.coalesce(F.col("failure_kind") == "gone", F.lit(False))
    return rows.withColumn(
        "removed", gone | (F.col("__ext") & (F.col("extraction_streak") >= threshold))
    ).drop("__ext")


def change_marks(events: DataFrame, cut_rows: int | None = None) -> DataFrame:
    """Carry forward when price and availability last changed, up to each row."""
    types = F.col("event_types")
    price = F.when(F.array_contains(types, "price_changed"), F.col("scraped_at"))
    availability = F.when(
        F.arrays_overlap(types, F.array(F.lit("availability_changed"), F.lit("out_of_stock"))),
        F.col("scraped_at"),
    )
    return (
        KeyedSequence(events, ["listing_id"], ["scraped_at", "observation_id"], cut_rows)
        .carry(
            {"last_price_changed_at": price, "last_availability_changed_at": availability},
            inclusive=True,
        )
        .result()
    )
