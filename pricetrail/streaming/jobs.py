"""Streaming forms of the history, monitoring, rate and run operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import changes, fx, monitoring, runs
from .state import JsonState, _sorted_rows, carry_stream, fold_stream

ORDER = ["scraped_at", "observation_id"]


# --- offers -----------------------------------------------------------------------------------


def offer_events(observations: DataFrame) -> DataFrame:
    """Observation stream to typed change events; the last good offer per listing is the state."""
    current = F.struct(*[F.col(c) for c in changes.OFFER_FIELDS], F.col("scraped_at"))
    good = F.when(F.col("outcome") == "ok", current)
    extraction = F.coalesce((F.col("outcome") == "failed") & (F.col("failure_kind") == "extraction"), F.lit(False))
    rows = carry_stream(
        observations, ["listing_id"], ORDER, {"previous": good}, {"extraction_streak": (extraction, ~extraction)}
    ).withColumn("current", good)
    kinds = changes.change_types(F.col("previous"), F.col("current"), F.col("outcome"), F.col("failure_kind"))
    return rows.select(
        "listing_id", "observation_id", F.explode(kinds).alias("event_type"), F.col("previous").alias("before"),
        F.col("current").alias("after"), "extraction_streak", F.col("scraped_at").alias("detected_at"),
    )


def revisit_intervals(visits: DataFrame) -> DataFrame:
    rows = fold_stream(visits, ["listing_id"], ORDER, monitoring.ttl_step, monitoring.TTL_INITIAL, monitoring.TTL_OUT)
    return rows.withColumn("next_scrape_at", monitoring.plus_seconds(F.col("scraped_at"), F.col("ttl")))


# --- request logs -----------------------------------------------------------------------------


def _with_micros(stream: DataFrame) -> DataFrame:
    return stream.withColumn("at_us", F.unix_micros("at"))


def unique_requests(requests: DataFrame, ttl: int = monitoring.CLAIM_TTL) -> DataFrame:
    """Requests that are no repeat of their fingerprint within the time-to-live from its first sight."""
    step, start = monitoring.claim_step(ttl)
    rows = fold_stream(_with_micros(requests), ["fingerprint"], ["at_us", "request_id"], step, start, monitoring.CLAIM_OUT)
    return rows.where("claimed").drop("claimed", "at_us")


def unique_within_watermark(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The built-in form: state leaves with the watermark; the time-to-live counts from the last late row."""
    return requests.withWatermark("at", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def quota(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    step, start = monitoring.quota_step(limit, window_seconds)
    return fold_stream(
        _with_micros(requests), ["identity"], ["at_us", "request_id"], step, start, monitoring.QUOTA_OUT
    ).drop("at_us")


def spacing(fetches: DataFrame, url_cooldown: float = 300, host_spacing: float = 15.0) -> DataFrame:
    step, start = monitoring.spacing_step(url_cooldown, host_spacing)
    return fold_stream(
        _with_micros(fetches), ["host"], ["at_us", "request_id"], step, start, monitoring.SPACING_OUT
    ).drop("at_us")


def store_pauses(outcomes: DataFrame, base: int = 30, most: int = 300) -> DataFrame:
    """Escalating pauses per host while store-side failures go on."""
    hit = (F.col("outcome") == "failed") & F.coalesce(F.col("failure_kind").isin(*monitoring.STORE_SIDE), F.lit(False))
    rows = carry_stream(outcomes, ["host"], ["at", "request_id"], {}, {"store_failures": (hit, F.col("outcome") == "ok")})
    n = F.least(F.col("store_failures"), F.lit(40)).cast("int")
    seconds = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), n - 1)).cast("long")
    return rows.withColumn("pause_seconds", F.when(hit, seconds))


def health(outcomes: DataFrame, threshold: int = 3, cooldown: int = 120) -> DataFrame:
    """Circuit state per host before and after each outcome."""
    step, start = monitoring.health_step(threshold, cooldown)
    return fold_stream(
        _with_micros(outcomes), ["host"], ["at_us", "request_id"], step, start, monitoring.HEALTH_OUT
    ).drop("at_us")


# --- timers -----------------------------------------------------------------------------------

PROMOTION_OUT = T.StructType(
    [
        T.StructField("listing_id", T.LongType()), T.StructField("at", T.TimestampType()),
        T.StructField("source", T.StringType()), T.StructField("event_type", T.StringType()),
    ]
)


class PromotionClock(StatefulProcessor):
    """Promotion state of a listing; a timer lets it lapse when no check comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = JsonState(handle)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        frame = _sorted_rows(rows, ["at_us", "seq"])
        if frame is None:
            return
        status, ends = self.state.get([None, None])
        made = []
        for row in frame.itertuples(index=False):
            now = int(row.at_us)
            if status == "active" and ends is not None and ends < now:
                # the end lay between two rows of this batch
                made.append((ends, "wall_clock", "promotion_expired"))
                status = "expired"
            if not row.seen:
                if status == "active" and ends is not None and ends <= now:
                    made.append((now, "observation", "promotion_expired"))
                    status = "expired"
                continue
            new_ends = None if pd.isna(row.expires_us) else int(row.expires_us)
            new = "expired" if new_ends is not None and new_ends <= now else row.status
            if status != "active" and new == "active":
                made.append((now, "observation", "promotion_activated"))
            elif status == "active" and new == "expired":
                made.append((now, "observation", "promotion_expired"))
            elif status == "active" and new == "active" and new_ends != ends and new_ends is not None:
                made.append((now, "observation", "promotion_updated"))
            status, ends = new, new_ends
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "active" and ends is not None:
            self.handle.registerTimer(ends // 1000 + 1)
        self.state.set([status, ends])
        if made:
            yield self._rows(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        status, ends = self.state.get([None, None])
        if status == "active" and ends is not None:
            self.state.set(["expired", ends])
            yield self._rows(key, [(ends, "wall_clock", "promotion_expired")])

    @staticmethod
    def _rows(key, made) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "listing_id": [key[0]] * len(made),
                "at": pd.to_datetime([m[0] for m in made], unit="us"),
                "source": [m[1] for m in made],
                "event_type": [m[2] for m in made],
            }
        )

    def close(self) -> None:
        pass


def promotion_events(observations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Promotion events of an observation stream (listing_id, at, seq, sku, product_id, promo).

    Expiry is an event-time timer: it fires when the watermark passes the end.
    """
    promo = F.col("promo")
    other = lambda mine, theirs: F.coalesce(
        (F.trim(mine) != "") & (F.trim(theirs) != "") & (F.trim(mine) != F.trim(theirs)), F.lit(False)
    )
    ignored = promo.isNotNull() & (other(F.col("sku"), promo["sku"]) | other(F.col("product_id"), promo["product_id"]))
    rows = (
        observations.where(~ignored)
        .withWatermark("at", delay)
        .select(
            "listing_id", "at", "seq", promo.isNotNull().alias("seen"), promo["status"].alias("status"),
            F.unix_micros(promo["expires_at"]).alias("expires_us"), F.unix_micros("at").alias("at_us"),
        )
    )
    return rows.groupBy("listing_id").transformWithStateInPandas(
        statefulProcessor=PromotionClock(), outputStructType=PROMOTION_OUT, outputMode="Append", timeMode="EventTime"
    )


STALL_OUT = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("last_progress_at", T.TimestampType())])


class StallClock(StatefulProcessor):
    """Reports a run once its progress stops for too long."""

    def __init__(self, after_seconds: int) -> None:
        self.after_seconds = after_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = JsonState(handle)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        frame = _sorted_rows(rows, ["at_us"])
        if frame is None:
            return
        last, done = self.state.get([0, False])
        last = max(last, int(frame["at_us"].max()))
        done = done or bool(frame["finished"].any())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not done:
            self.handle.registerTimer(last // 1000 + self.after_seconds * 1000)
        self.state.set([last, done])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        last, done = self.state.get([0, False])
        if not done:
            yield pd.DataFrame({"run_id": [key[0]], "last_progress_at": pd.to_datetime([last], unit="us")})

    def close(self) -> None:
        pass


def stalled_runs(progress: DataFrame, after_seconds: int = runs.STALL_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Runs without progress for too long, from a stream (run_id, at, finished)."""
    rows = progress.withWatermark("at", delay).select("run_id", "at", "finished", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=StallClock(after_seconds), outputStructType=STALL_OUT, outputMode="Append", timeMode="EventTime"
    )


# --- aggregates and micro-batches -------------------------------------------------------------


def run_progress(store_runs: DataFrame) -> DataFrame:
    """Progressive roll-up of running match runs; write it in update or complete mode."""
    return runs.run_rollup(store_runs)


def write_history(events: DataFrame, path: str, checkpoint: str, at: str = "detected_at", once: bool = True) -> StreamingQuery:
    """Append a stream of events by day. The file sink writes each micro-batch exactly once."""
    writer = (
        events.withColumn("day", F.to_date(at)).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).partitionBy("day")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a batch operator on every micro-batch. ``work`` must give the same result when a batch is retried."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rate_ingest(spark: SparkSession, archive: DataFrame, path: str, checkpoint: str, overrides: DataFrame | None = None) -> StreamingQuery:
    """Ingest archived rate responses: parse, pick sources, validate against the latest known, store.

    Batch N writes ``rates/batch=N``, and ``known/batch=N`` with the latest accepted
    rate of each pair and type. It reads only ``known/batch=N-1``, so a retry replaces what the
    failed attempt left and sees none of it, and no batch reads the history again. Manual rates in
    ``overrides`` replace the fetched ones. Rates turn stale when they are read (``known_rates``).
    """
    from ..sources import rate_pages

    def work(batch: DataFrame, number: int) -> None:
        known = spark.read.parquet(f"{path}/known/batch={number - 1}") if number > 0 else None
        found = rate_pages.rates(batch).withColumn("batch_id", F.lit(number))
        pyg = found.where(F.col("source").isin("bcp_referential", "bcb_sml"))
        picked = fx.first_source(pyg, ["bcp_referential", "bcb_sml"], ["batch_id"])
        rest = found.where(~F.col("source").isin("bcp_referential", "bcb_sml"))
        tagged = fx.prefer_central_bank(fx.validate_batch(rest.unionByName(picked), known)).drop("last_known")
        if overrides is not None:
            tagged = fx.with_override(tagged, overrides)
        own = f"{path}/rates/batch={number}"
        tagged.write.mode("overwrite").parquet(own)
        stored = spark.read.parquet(own)
        accepted = stored.where(F.col("valid") & ~F.col("audit_only"))
        merged = accepted if known is None else known.unionByName(accepted, allowMissingColumns=True)
        fx.latest_rates(merged, ["fetched_at", "source"]).write.mode("overwrite").parquet(f"{path}/known/batch={number}")

    return for_each_batch(archive, work, checkpoint)


def known_rates(spark: SparkSession, path: str, number: int, now: Column) -> DataFrame:
    """The latest accepted rates after batch ``number``, marked stale by age."""
    return fx.latest_rates(spark.read.parquet(f"{path}/known/batch={number}"), ["fetched_at", "source"], now)


def sweep_job(listings: Callable[[], DataFrame], pauses: Callable[[], DataFrame], out: str, limit: int | None = None):
    """Work of one monitoring sweep as a micro-batch function: the batch's tick rows give the time.

    ``listings`` and ``pauses`` read the current state tables; the work list of
    each sweep is written to its own folder.
    """

    def work(batch: DataFrame, number: int) -> None:
        tick = batch.agg(F.max("at").alias("at")).collect()[0]["at"]
        if tick is None:
            return
        now = F.lit(tick).cast("timestamp")
        monitoring.sweep(listings(), pauses(), now, limit).write.mode("overwrite").parquet(f"{out}/sweep={number}")

    return work
