"""Streams give the same rows as the batch operators on the same data."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import changes, monitoring, runs
from pricetrail.plans import views, watch
from pricetrail.streaming import jobs
from pricetrail.streaming.state import prepare_streaming

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.streaming


def as_stream(spark, rows, order, parts=3):
    """Write rows as files in time order and read them back as a stream, one file per batch."""
    prepare_streaming(spark)
    folder = tempfile.mkdtemp(prefix="pricetrail-stream-")
    total = rows.count()
    numbered = rows.orderBy(*order).toPandas()
    for i in range(parts):
        part = numbered.iloc[i * total // parts : (i + 1) * total // parts]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/in"), folder


def run(stream, folder, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def rows_of(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


def test_offer_events(spark):
    obs = views.observations(spark, SF)
    stream, folder = as_stream(spark, obs, ["scraped_at", "observation_id"])
    got = run(jobs.offer_events(stream), folder, "st_offer_events")
    want = changes.offer_events(obs)
    columns = ("listing_id", "observation_id", "event_type", "before.price", "after.price", "before.scraped_at")
    assert rows_of(got, *columns) == rows_of(want, *columns)


def test_quota_and_spacing(spark):
    requests = watch.requests(spark, SF)
    stream, folder = as_stream(spark, requests, ["at", "request_id"])
    got = run(jobs.quota(stream, 4, 14400), folder, "st_quota")
    want = monitoring.quota_audit(requests, 4, 14400)
    assert rows_of(got, "request_id", "allowed", "remaining") == rows_of(want, "request_id", "allowed", "remaining")
    stream, folder = as_stream(spark, requests, ["at", "request_id"])
    got = run(jobs.spacing(stream, 21600, 1800), folder, "st_spacing")
    want = monitoring.spacing_audit(requests, 21600, 1800)
    assert rows_of(got, "request_id", "admitted", "code") == rows_of(want, "request_id", "admitted", "code")


def test_unique_requests(spark):
    requests = watch.requests(spark, SF).withColumn("fingerprint", F.col("url"))
    stream, folder = as_stream(spark, requests, ["at", "request_id"])
    got = run(jobs.unique_requests(stream, 86400), folder, "st_unique")
    want = monitoring.claims(requests, 86400).where("claimed")
    assert rows_of(got, "request_id") == rows_of(want, "request_id")


def test_store_pauses(spark):
    outcomes = watch.requests(spark, SF)
    stream, folder = as_stream(spark, outcomes, ["at", "request_id"])
    got = run(jobs.store_pauses(stream), folder, "st_pauses")
    want = monitoring.store_pauses(outcomes)
    assert rows_of(got, "request_id", "store_failures", "pause_seconds") == rows_of(want, "request_id", "store_failures", "pause_seconds")


def test_health(spark):
    outcomes = watch.requests(spark, SF)
    stream, folder = as_stream(spark, outcomes, ["at", "request_id"])
    got = run(jobs.health(stream, 2, 1800), folder, "st_health")
    want = monitoring.health_timeline(outcomes, 2, 1800)
    assert rows_of(got, "request_id", "state_before", "state_after") == rows_of(want, "request_id", "state_before", "state_after")


def test_run_progress(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("store"),
        F.when(F.col("l_returnflag") == "A", "match").otherwise("no_match").alias("status"), "l_linenumber",
    )
    stream, folder = as_stream(spark, lines, ["run_id"])
    got = run(jobs.run_progress(stream), folder, "st_runs", "complete")
    assert rows_of(got, "run_id", "stores_total", "matches") == rows_of(runs.run_rollup(lines), "run_id", "stores_total", "matches")


def test_promotions_lapse_by_timer(spark):
    obs = watch.promo_observations(spark, SF)
    last = obs.agg(F.max("at")).collect()[0][0]
    stream, folder = as_stream(spark, obs, ["at", "seq"])
    got = run(jobs.promotion_events(stream), folder, "st_promos")
    # ends after the last row have not come yet for the stream
    want = monitoring.promotion_transitions(obs).where(F.col("at") < F.lit(last))
    got = got.where(F.col("at") < F.lit(last))
    assert rows_of(got, "listing_id", "at", "event_type") == rows_of(want, "listing_id", "at", "event_type")


def test_rate_ingest_survives_a_failed_batch(spark, tmp_path, monkeypatch):
    """A batch that fails half way and runs again gives what an unbroken run gives."""
    body = '{{"value": [{{"cotacaoCompra": {0}, "cotacaoVenda": {0}, "dataHoraCotacao": "2026-0{1}-01 13:00:00.000"}}]}}'
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    days = [("bcb_ptax", body.format(rate, month), start + timedelta(days=30 * month), month) for month, rate in ((1, 5.0), (2, 5.1), (3, 6.3), (4, 5.2))]
    made = spark.createDataFrame(days, "source string, body string, fetched_at timestamp, month int")
    broken, whole = str(tmp_path / "broken"), str(tmp_path / "whole")

    def ingest(path, fail):
        folder = tempfile.mkdtemp(dir=tmp_path)
        for k in range(len(days)):
            made.where(F.col("month") == k + 1).drop("month").coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(made.drop("month").schema).parquet(folder)
            if fail and k == 2:
                real = jobs.fx.latest_rates
                monkeypatch.setattr(jobs.fx, "latest_rates", lambda *a, **b: 1 / 0)
                with pytest.raises(Exception):
                    jobs.rate_ingest(spark, stream, path, path + "-checkpoint").awaitTermination()
                monkeypatch.setattr(jobs.fx, "latest_rates", real)
            jobs.rate_ingest(spark, stream, path, path + "-checkpoint").awaitTermination()
        return rows_of(spark.read.parquet(f"{path}/rates"), "rate_type", "rate", "valid", "batch"), rows_of(jobs.known_rates(spark, path, len(days) - 1, F.lit(start + timedelta(days=500))), "rate_type", "rate", "status")

    one, two = ingest(whole, False), ingest(broken, True)
    assert one == two and one[0] and one[1]
    assert any(row[2] == "False" or row[2] is False for row in one[0]), "the jump is refused"
    assert all("6.3" not in str(row) and "stale" in str(row) for row in one[1])
