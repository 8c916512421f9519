"""Exchange rates: validation, latest known good, conversion."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import round_cents
from ..recurrences import LastAccepted
from ..schema import RATE, S, struct
from ..sequences import KeyedSequence, fold
from ..session import staged
from .changes import latest_per_key

PAIR = ["base_currency", "quote_currency"]
RATE_KEY = [*PAIR, "rate_type"]
MAX_CURRENCIES = 1000
# Default rate type per pair, preference order, magnitude bands, limits.
DEFAULT_TYPE = {("USD", "BRL"): "tourism_sell", ("PYG", "BRL"): "official", ("USD", "PYG"): "official"}
PREFERENCE = ("tourism_sell", "official", "ptax_sell", "market", "tourism_buy", "ptax_buy")
BANDS = {("USD", "BRL"): ("2", "15"), ("PYG", "BRL"): ("0.00005", "0.01"), ("USD", "PYG"): ("500", "100000")}
MAX_CHANGE_PERCENT = 15
MAX_TOURISM_PREMIUM_PERCENT = 12
PTAX_AGREEMENT_PERCENT = "0.5"
STALE_AFTER_SECONDS = 21600
CENTRAL_BANK, NEWSPAPER = "bcb_ptax", "valor_data"


def _pair_is(base: str, quote: str) -> Column:
    return (F.col("base_currency") == base) & (F.col("quote_currency") == quote)


def _by_pair(table: dict, make) -> Column:
    chain = None
    for (base, quote), value in table.items():
        chain = (
            F.when(_pair_is(base, quote), make(value))
            if chain is None
            else chain.when(_pair_is(base, quote), make(value))
        )
    return chain


def outside_band() -> Column:
    """True outside the pair's plausible band; pairs without a band pass."""
    low = _by_pair(BANDS, lambda v: F.lit(v[0]).cast(RATE))
    high = _by_pair(BANDS, lambda v: F.lit(v[1]).cast(RATE))
    return F.coalesce((F.col("rate") < low) | (F.col("rate") > high), F.lit(False))


def rate_errors(last_known: Column | None = None, max_change: int = MAX_CHANGE_PERCENT) -> Column:
    """Codes of the checks a rate fails. A rate that is not above zero gets no other check."""
    wide = T.DecimalType(38, 12)
    checks = [F.when(outside_band(), F.lit("outside_band"))]
    if last_known is not None:
        jump = F.abs(F.col("rate") - last_known).cast(wide) * F.lit(100)
        jumped = (last_known > 0) & (jump > last_known.cast(wide) * F.lit(max_change))
        checks.append(F.when(jumped, F.lit("jump")))
    return F.when(~(F.col("rate") > 0), F.array(F.lit("not_positive"))).otherwise(
        F.array_compact(F.array(*checks))
    )


def validate_batch(batch: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Tag a batch of fetched rates with ``errors`` and ``valid`` against the last known good."""
    if latest is None:
        tagged = batch.withColumn("errors", rate_errors())
    else:
        known = latest.select(*RATE_KEY, F.col("rate").alias("last_known"))
        tagged = batch.join(known, RATE_KEY, "left").withColumn("errors", rate_errors(F.col("last_known")))
    return tagged.withColumn("valid", F.size("errors") == 0)


_ACCEPT_OUT = T.StructType([T.StructField("last_accepted", RATE), T.StructField("jump", T.BooleanType())])


def accept_in_order(
    rates: DataFrame, order: Sequence[str], max_change: int = MAX_CHANGE_PERCENT, cut_rows: int | None = None
) -> DataFrame:
    """Validate a history in order: each rate is compared with the last *accepted* one.

    ``lag`` would compare with the previous row even if that one was refused.
    """
    basic = rates.withColumn("__basic", rate_errors()).withColumn("sound", F.size("__basic") == 0)
    rows = fold(basic, RATE_KEY, order, LastAccepted(max_change, pa.decimal128(RATE.precision, RATE.scale)), _ACCEPT_OUT, cut_rows)
    sound_jump = F.when(F.col("jump") & (F.col("rate") > 0), F.array(F.lit("jump"))).otherwise(F.array().cast("array<string>"))
    return (
        rows.withColumn("errors", F.concat("__basic", sound_jump))
        .withColumn("valid", F.size("errors") == 0)
        .drop("__basic", "sound", "jump")
    )


def jumps_between_neighbours(rates: DataFrame, order: Sequence[str], cut_rows: int | None = None) -> DataFrame:
    """Flag rates that moved more than the limit against the previous observation."""
    rows = (
        KeyedSequence(rates, RATE_KEY, order, cut_rows).carry({"previous": F.col("rate")}).result()
    )
    wide = T.DecimalType(38, 12)
    jump = F.abs(F.col("rate") - F.col("previous")).cast(wide) * F.lit(100) > F.col("previous").cast(wide) * F.lit(MAX_CHANGE_PERCENT)
    return rows.withColumn("jump", F.coalesce((F.col("previous") > 0) & jump, F.lit(False)))


def cross_checks(batch: DataFrame, key: str = "batch_id") -> DataFrame:
    """Warnings per batch: tourism premium over PTAX, and the two PTAX sources' agreement."""
    usd = _pair_is("USD", "BRL")
    kind, source, rate = F.col("rate_type"), F.col("source"), F.col("rate")
    wide = T.DecimalType(38, 12)
    figures = batch.where(usd & F.col("valid")).groupBy(key).agg(
        F.max(F.when(kind == "tourism_sell", rate)).alias("tourism_sell"),
        F.max(F.when((kind == "ptax_sell") & (source != CENTRAL_BANK), rate)).alias("ptax_news"),
        F.max(F.when((kind == "ptax_sell") & (source == CENTRAL_BANK), rate)).alias("ptax_bank"),
    )
    ptax = F.coalesce(F.col("ptax_bank"), F.col("ptax_news"))
    top = ptax.cast(wide) * F.lit(100 + MAX_TOURISM_PREMIUM_PERCENT)
    premium = (ptax > 0) & ((F.col("tourism_sell") < ptax) | (F.col("tourism_sell").cast(wide) * F.lit(100) > top))
    apart = F.abs(F.col("ptax_news") - F.col("ptax_bank")).cast(wide) * F.lit(1000) > F.col("ptax_bank").cast(wide) * F.lit(5)
    return figures.withColumns(
        {
            "tourism_warning": F.coalesce(premium, F.lit(False)),
            "ptax_warning": F.coalesce((F.col("ptax_bank") > 0) & apart, F.lit(False)),
        }
    )


def prefer_central_bank(rates: DataFrame, key: str = "batch_id") -> DataFrame:
    """Mark the newspaper's PTAX as audit-only in batches where the bank's own PTAX is valid."""
    bank = (
        rates.where((F.col("source") == CENTRAL_BANK) & (F.col("rate_type") == "ptax_sell") & F.col("valid"))
        .select(key).distinct().withColumn("__bank", F.lit(True))
    )
    theirs = (F.col("source") == NEWSPAPER) & F.col("rate_type").isin("ptax_buy", "ptax_sell")
    return rates.join(bank, key, "left").withColumn(
        "audit_only", F.coalesce(F.col("__bank"), F.lit(False)) & theirs
    ).drop("__bank")


def first_source(rates: DataFrame, ranks: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Rows of the first source of ``ranks`` that has any row for the key."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ranks]), F.col("source"))
    ranked = rates.withColumn("__rank", rank).where("__rank > 0")
    best = ranked.groupBy(*key).agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, [*key, "__rank"]).drop("__rank")


def with_override(batch: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual rates replace the fetched ones of the same pair and type."""
    return batch.join(overrides.select(*RATE_KEY), RATE_KEY, "left_anti").unionByName(
        overrides, allowMissingColumns=True
    )


def latest_rates(observations: DataFrame, order: Sequence[str] = ("fetched_at",), now: Column | None = None) -> DataFrame:
    """Newest rate per pair and type, marked stale after six hours when ``now`` is given."""
    kept = observations.where(~F.col("audit_only")) if "audit_only" in observations.columns else observations
    latest = latest_per_key(kept, RATE_KEY, list(order))
    if now is not None:
        age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
        latest = latest.withColumn("status", F.when(age > STALE_AFTER_SECONDS, "stale").otherwise("fresh"))
    return latest


def rates_of(latest: DataFrame, base: str | None = None, quote: str | None = None) -> DataFrame:
    """The latest rates of one base or quote currency, or of both; all without either."""
    rows = latest.where(F.col("base_currency") == base) if base else latest
    return rows.where(F.col("quote_currency") == quote) if quote else rows


def freshness(status: Column, fetched_at: Column, now: Column, after: int = STALE_AFTER_SECONDS) -> Column:
    known = F.when(status.isin("fresh", "stale", "unavailable"), status)
    old = F.unix_timestamp(fetched_at) < F.unix_timestamp(now) - after
    return F.coalesce(known, F.when(old, "stale").otherwise("fresh"))


def rate_per_pair(latest: DataFrame, rate_type: str | None = None) -> DataFrame:
    """The one rate to use per pair.

    The asked or default type if there is one, else fresh before stale and then
    the preference order.
    """
    wanted = F.lit(rate_type) if rate_type else _by_pair(DEFAULT_TYPE, F.lit)
    place = F.array_position(F.array(*[F.lit(p) for p in PREFERENCE]), F.col("rate_type"))
    rank = F.struct(
        F.when(F.col("rate_type") == wanted, 0).otherwise(1).alias("default"),
        F.when(F.col("status") == "fresh", 0).otherwise(1).alias("stale"),
        F.when(place > 0, place).otherwise(99).alias("place"),
        F.col("rate_type").alias("type"),
    )
    row = F.struct("rate", "rate_type", "status", "source", "fetched_at")
    return latest.groupBy(*PAIR).agg(F.min_by(row, rank).alias("fx"))


def convert(
    prices: DataFrame, latest: DataFrame, to_currency: str = "BRL", rate_type: str | None = None
) -> DataFrame:
    """Add converted amount, rate and status to rows with ``amount`` and ``currency``.

    One aggregate row per currency is made, counted and broadcast, so prices are not
    shuffled on a handful of currencies. There are no cross rates.
    """
    picked = rate_per_pair(latest, rate_type).where(F.col("quote_currency") == to_currency)
    picked = staged(picked.select(F.col("base_currency").alias("currency"), "fx"))
    if picked.count() > MAX_CURRENCIES:
        raise ValueError(f"rates of more than {MAX_CURRENCIES} currencies")
    rows = prices.join(F.broadcast(picked), "currency", "left")
    own = F.col("currency") == to_currency
    rate = F.when(F.col("fx.rate") > 0, F.col("fx.rate"))
    product = (F.col("amount").cast("decimal(18,4)") * rate).cast("decimal(38,10)")
    converted = round_cents(product) if to_currency == "BRL" else product
    known = F.col("amount").isNotNull() & F.col("currency").isNotNull()
    return rows.select(
        *prices.columns,
        F.when(known, F.when(own, F.col("amount").cast("decimal(38,4)")).otherwise(converted.cast("decimal(38,4)"))).alias("converted_amount"),
        F.when(known, F.when(own, F.lit(1).cast(RATE)).otherwise(rate)).alias("fx_rate"),
        F.when(known, F.when(own, "official").otherwise(F.col("fx.rate_type"))).alias("fx_rate_type"),
        F.when(known, F.when(own, "fresh").when(rate.isNull(), "unavailable").otherwise(F.col("fx.status"))).alias("fx_status"),
        F.when(known, F.when(own, "identity").otherwise(F.col("fx.source"))).alias("fx_source"),
    )


def enrich(prices: DataFrame, latest: DataFrame) -> DataFrame:
    """Conversion columns for a view: all NULL for prices already in BRL or missing."""
    rows = convert(prices, latest)
    show = F.coalesce(F.col("currency") != "BRL", F.lit(False)) & F.col("amount").isNotNull()
    return rows.withColumns(
        {c: F.when(show, F.col(c)) for c in rows.columns if c.startswith("fx_") or c == "converted_amount"}
    )


def failure_counts(fetches: DataFrame, order: Sequence[str], cut_rows: int | None = None) -> DataFrame:
    """Failed fetches in a row per pair and type."""
    ok = F.col("ok")
    return (
        KeyedSequence(fetches, RATE_KEY, order, cut_rows).streak("failures_in_a_row", ~ok, ok).result()
    )


def refresh_summary(tagged: DataFrame, key: str = "batch_id") -> DataFrame:
    """Per batch: fetched, valid, rejected, stored and whether a fallback source was used."""
    stored = F.col("valid") & ~F.col("audit_only")
    return tagged.groupBy(key).agg(
        F.count("*").alias("fetched"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("rejected"),
        F.count_if(stored).alias("persisted"),
        F.coalesce(F.bool_or("fallback"), F.lit(False)).alias("fallback_used"),
    )


def diagnostics(latest: DataFrame, wanted_pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Stale rates and wanted pairs without any rate."""
    spark: SparkSession = latest.sparkSession
    pairs = spark.createDataFrame(list(wanted_pairs), struct(("base_currency", S), ("quote_currency", S)))
    have = latest.groupBy(*PAIR).agg(F.count("*").alias("rates"), F.count_if(F.col("status") == "stale").alias("stale"))
    joined = F.broadcast(pairs).join(have, PAIR, "left")
    return joined.agg(
        F.sum(F.coalesce("stale", F.lit(0))).cast("long").alias("stale_count"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("rates").isNull(), F.concat_ws("/", *PAIR)))), ","
        ).alias("unavailable_pairs"),
    )


