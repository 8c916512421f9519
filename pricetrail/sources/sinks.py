"""Appending and replacing tables so that a retried job writes the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import S, struct

COMMIT = struct(("batch", S), ("attempt", S))


def append_history(rows: DataFrame, path: str, at: str) -> None:
    """Append snapshots or events, one folder per day.

    Rows are spread over the day's tasks by id, so a hot listing does not make
    one large file. Writers rely on the file committer: a failed task leaves
    nothing behind.
    """
    (
        rows.withColumn("day", F.to_date(at))
        .write.mode("append").partitionBy("day").parquet(path)
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_new(rows: DataFrame, existing: DataFrame, keys: list[str], path: str) -> None:
    """Append the rows whose key is not stored yet."""
    rows.join(existing.select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(path)


def replace_table(rows: DataFrame, folder: str, version: int) -> str:
    """Write a new version of a state table beside the old one and return its path.

    A table is never overwritten while it is read; readers switch to the new
    folder once it is complete.
    """
    path = f"{folder}/version={version:06d}"
    rows.write.mode("errorifexists").parquet(path)
    return path


# --- committed batches ------------------------------------------------------------------------


def stage_batch(rows: DataFrame, folder: str, batch: str, at: str) -> str:
    """Write one attempt of a batch, a folder for each day; no reader sees it before ``commit_batch``. Returns the attempt."""
    attempt = uuid.uuid4().hex
    dated = rows.withColumn("day", F.to_date(at))
    dated.write.mode("errorifexists").partitionBy("day").parquet(f"{folder}/data/batch={batch}/attempt={attempt}")
    return attempt


def commit_batch(spark: SparkSession, folder: str, batch: str, attempt: str) -> None:
    """Make an attempt visible: one record beside the data. Of several attempts of a batch the least counts, for every reader alike."""
    spark.createDataFrame([(batch, attempt)], COMMIT).coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """``batch`` and ``attempt`` of the committed batches, one row each; none where nothing has been committed yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(f"{folder}/commits").groupBy("batch").agg(F.min("attempt").alias("attempt"))


def append_batch(rows: DataFrame, folder: str, batch: str, at: str) -> bool:
    """Append a batch once: whether it was written now. A batch that is committed already is not written again, so a job may be replayed."""
    spark = rows.sparkSession
    if not commits(spark, folder).where(F.col("batch") == batch).isEmpty():
        return False
    commit_batch(spark, folder, batch, stage_batch(rows, folder, batch, at))
    return True


def committed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches, with ``day``; what crashed writers left behind is pruned by its folder."""
    stored = T.StructType([*schema.fields, *COMMIT.fields, T.StructField("day", T.DateType())])
    rows = spark.read.schema(stored).option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    return rows.join(commits(spark, folder), ["batch", "attempt"], "left_semi").drop("batch", "attempt")
