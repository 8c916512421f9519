"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, rows_of, slices, split, staged, table, text_bytes, uniform

BUCKETS = 1 << 16
SMOOTHING = 2.0  # added to each bucket's count
TOKENS = re.compile(r"\w+|[^\w\s]+")
CACHE = 200_000  # tokens a task remembers at once
SEED = "importance"
FEW = 50_000  # keys that the driver sorts


class Grams(dict):
    """The buckets of a text's tokens and of its pairs of neighbouring tokens, repeats included. Remembers the hashes of tokens."""

    def __missing__(self, token: str) -> int:
        self[token] = found = xxhash.xxh64_intdigest(token)
        return found

    def hashes(self, text: bytes) -> np.ndarray:
        out = []
        for part in slices(text):
            if len(self) > CACHE:
                self.clear()
            tokens = TOKENS.findall(part.decode(errors="replace"))
            out.append(np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        one = self.hashes(text)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        two ^= two >> np.uint64(29)
        return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def log_ratios(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Per bucket the log of how much likelier it is in target text than in raw text.

    The raw model counts the n-grams of all docs. The target model counts those of all docs whose ids are
    in ``target``. Only texts that a filter of bits takes for targets are shuffled to the ids, by a
    sort-merge join at any size; all others are counted where they are read, so that each text is read once. Counts are added up by task before they
    are shuffled; the driver gets one row per bucket. Without target texts all ratios are 1.
    """
    ids = staged(target.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    some, others = split(rows.where("id is not null"), ids, "id")
    others = others.unionByName(rows.where("id is null")).select("text", F.lit(False).alias("target"))
    marked = some.join(ids.withColumn("target", F.lit(True)).hint("merge"), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(), np.zeros((2, BUCKETS), np.int64)
        for texts, marks in rows_of(batches, "text", "target"):
            for text, mark in zip(texts, marks, strict=True):
                own = np.bincount(grams(text), minlength=BUCKETS)
                counts[0] += own
                if mark:
                    counts[1] += own
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "raw", "target"])

    found = marked.unionByName(others).mapInArrow(run, "bucket long, raw long, target long")
    sums = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[:, sums["bucket"].to_numpy(int)] = sums[["raw", "target"]].to_numpy(float).T
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw, own = (np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * BUCKETS) for c in counts)
    return own - raw


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``id``, ``u``, a uniform number by the id (without an id by the text), ``log_weight`` (of the whole text; 0 without tokens) and ``grams``, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [grams(t) for t in batch.column("text").to_pylist()]
            weights = pa.array([float(ratios[g].sum()) for g in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), weights, pa.array([len(g) for g in found], pa.int64())], ["id", "u", "log_weight", "grams"])

    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(text_bytes(text_col))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), uniform(key, SEED).alias("u"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, u double, log_weight double, grams long")


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest of a column of finite numbers, exactly.

    Approximate percentiles close in on it from both sides, and what is above is counted, until few distinct keys are left.
    """
    band, above = rows.select(F.col(key).alias("x")), 0
    low, high = float("-inf"), float("inf")
    while True:
        own = band.where((F.col("x") >= low) & (F.col("x") <= high))
        n, distinct = own.agg(F.count("*"), F.approx_count_distinct("x")).first()
        if distinct <= FEW // 2 or n <= FEW:
            for x, number in sorted(((r["x"], r["n"]) for r in own.groupBy("x").agg(F.count("*").alias("n")).collect()), reverse=True):
                above += number
                if above >= k:
                    return x
            return low
        at = 1 - (k - above) / n
        ends = own.agg(F.percentile_approx("x", F.array(*[F.lit(min(1.0, max(0.0, at + d))) for d in (-0.001, 0.001)]), F.lit(10_000))).first()[0]
        # an end is taken only if the k-th is known to lie on its inner side
        over, over_low = own.agg(F.count_if(F.col("x") > ends[1]), F.count_if(F.col("x") >= ends[0])).first()
        if above + over < k:
            above, high = above + over, ends[1]
        else:
            low = max(low, ends[1])
        if above + over_low - (over if high == ends[1] else 0) >= k:
            low = max(low, ends[0])


def resample(docs: DataFrame, target: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``id``, ``log_weight``, ``key`` and ``kept``.

    The log weight is the log likelihood of the whole text's tokens and token pairs under the
    target model less that under the raw model. With Gumbel noise from a hash of the id (without an id: of the text) added, the
    keys of the ``share`` of all rows that are kept are the largest: a sample without replacement by
    weight. Rows with equal keys, as rows that repeat, are kept together. Null and empty texts weigh
    1 (log 0). An empty table gives none. Only the two named columns are read.
    """
    found = weigh(docs, log_ratios(docs, target, id_col, text_col), id_col, text_col)
    noise = -F.log(-F.log(F.least(F.col("u"), F.lit(1 - 2.0**-53))))
    rows = staged(found.select("id", "log_weight", (F.col("log_weight") + noise).alias("key")))
    total = rows.count()
    k = round(total * share)
    if not k:
        return rows.withColumn("kept", F.lit(False))
    return rows.withColumn("kept", F.col("key") >= F.lit(kth_largest(rows, "key", k)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep as large a share of all documents as has quality 1 among the labels that may be learnt from."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = labels.agg(F.coalesce(F.avg("quality"), F.lit(1.0))).first()[0]
    found = resample(docs, labels.where("quality = 1"), share)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "log_weight", "key", "kept")
