"""Batches that are committed by a record beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetrail.sources import sinks


def noon():
    return F.lit("2026-09-01 12:00:00").cast("timestamp")



def test_crash_replay_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "history")
    rows = spark.range(100).withColumn("at", noon())
    assert sinks.commits(spark, folder).isEmpty()
    sinks.stage_batch(rows.where("id < 30"), folder, "a", "at")  # the writer stops here
    assert sinks.committed(spark, folder, rows.schema).isEmpty()
    assert sinks.append_batch(rows.where("id < 60"), folder, "a", "at")
    assert not sinks.append_batch(rows.where("id < 60"), folder, "a", "at")
    assert sinks.append_batch(rows.where("id >= 60"), folder, "b", "at")
    got = sinks.committed(spark, folder, rows.schema)
    assert sorted(r["id"] for r in got.collect()) == list(range(100))
    assert [str(r["day"]) for r in got.select("day").distinct().collect()] == ["2026-09-01"]


def test_two_writers_commit_one_batch(spark, tmp_path):
    folder = str(tmp_path / "history")
    rows = spark.range(10).withColumn("at", noon())
    attempts = [sinks.stage_batch(rows, folder, "a", "at") for _ in range(2)]
    for attempt in reversed(attempts):
        sinks.commit_batch(spark, folder, "a", attempt)
    assert sinks.committed(spark, folder, rows.schema).count() == 10
