"""Dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLASHED = r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}(:\d{2})?$"
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_time(text: Column, source_zone: Column | None = None) -> Column:
    """Epoch seconds or milliseconds, ISO, or ``YYYY/MM/DD HH:MM[:SS]`` in the source's zone, as UTC.

    Slashed times without a zone are Brazilian shop time; ISO times without one are UTC.
    """
    raw = F.trim(text)
    number = raw.try_cast("double")
    epoch = F.timestamp_micros((F.when(number > 1e12, number / 1000).otherwise(number) * 1e6).cast("long"))
    slashed = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy/M/d H:mm:ss")), F.try_to_timestamp(raw, F.lit("yyyy/M/d H:mm")))
    zone = F.lit(None).cast("string") if source_zone is None else source_zone
    iso = raw.try_cast("timestamp")
    return (
        F.when(number.isNotNull(), epoch)
        .when(raw.rlike(SLASHED), F.to_utc_timestamp(slashed, F.coalesce(zone, F.lit("America/Sao_Paulo"))))
        .when(raw.rlike(ZONED), iso)
        .otherwise(F.to_utc_timestamp(iso, F.coalesce(zone, F.lit("UTC"))))
    )


def hms(total_ms: Column) -> Column:
    """Milliseconds as HH:MM:SS; nothing or less than nothing is 00:00:00."""
    ms = F.when(total_ms >= 0, total_ms).otherwise(0)
    seconds = F.floor(F.coalesce(ms, F.lit(0)) / 1000)
    return F.format_string(
        "%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    )
