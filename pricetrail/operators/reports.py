"""Evaluation of match decisions and operations reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label names and duration budgets in ms (expected, warn, slow, critical).
LABELS = ("same_product", "different_product", "uncertain")
SPLITS = ("development", "train", "calibration", "validation", "holdout")
BUDGETS = {
    "unit_test": (200, 500, 2_000, 10_000),
    "integration_test": (1_000, 2_000, 10_000, 60_000),
    "live_test": (15_000, 30_000, 120_000, 600_000),
    "e2e": (30_000, 60_000, 300_000, 900_000),
    "http_request": (1_500, 3_000, 15_000, 60_000),
    "browser_navigation": (5_000, 10_000, 45_000, 120_000),
    "browser_launch": (3_000, 5_000, 20_000, 60_000),
    "crawler": (8_000, 15_000, 60_000, 180_000),
    "product_search": (2_000, 5_000, 30_000, 120_000),
    "product_match": (15_000, 30_000, 180_000, 600_000),
    "database_query": (50, 200, 1_000, 5_000),
    "migration": (2_000, 5_000, 30_000, 120_000),
    "docker_build": (45_000, 60_000, 300_000, 900_000),
    "ci_job": (180_000, 300_000, 900_000, 1_800_000),
    "agent_shell": (15_000, 30_000, 120_000, 600_000),
    "agent_research": (60_000, 120_000, 600_000, 1_200_000),
    "external_tool": (5_000, 15_000, 60_000, 300_000),
}


def prediction(decision: Column) -> Column:
    return F.when(decision == "auto_match", "same_product").when(decision == "reject", "different_product").otherwise("uncertain")


def ratio(part: Column, whole: Column) -> Column:
    """Quotient of counts; NULL when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall, F1 and false positive rate to rows with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    return counts.withColumns(
        {"precision_auto_match": precision, "recall_same_product": recall, "f1_same_product": f1, "false_positive_rate": ratio(fp, fp + tn)}
    )


def _counts() -> list[Column]:
    label, made = F.col("label"), F.col("prediction")
    same, other, hit = label == "same_product", label == "different_product", made == "same_product"
    return [
        F.count("*").alias("count"),
        F.count_if(same & hit).alias("tp"),
        F.count_if(other & hit).alias("fp"),
        F.count_if(same & ~hit).alias("fn"),
        F.count_if(other & ~hit).alias("tn"),
    ]


def metrics(examples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Binary metrics of (label, prediction); uncertain gold is left out, a review counts as no match."""
    known = examples.where(F.col("label") != "uncertain")
    return with_metrics((known.groupBy(*keys) if keys else known).agg(*_counts()))


def metric_slices(examples: DataFrame) -> DataFrame:
    """Metrics over all, by category and by language pair, in one pass over grouping sets."""
    rows = examples.where(F.col("label") != "uncertain").withColumn(
        "language_pair", F.concat_ws("-", "reference_language", "candidate_language")
    )
    grouped = rows.groupingSets(
        [[], ["category"], ["language_pair"]], "category", "language_pair"
    ).agg(F.grouping_id().alias("__g"), *_counts())
    name = (
        F.when(F.col("__g") == 3, "all")
        .when(F.col("__g") == 1, F.concat(F.lit("category:"), "category"))
        .otherwise(F.concat(F.lit("language_pair:"), "language_pair"))
    )
    return with_metrics(grouped.withColumn("slice", name)).select(
        "slice", "count", "tp", "fp", "fn", "tn", "precision_auto_match", "recall_same_product", "f1_same_product", "false_positive_rate"
    )


def confusion(examples: DataFrame) -> DataFrame:
    """3x3 matrix: one row per label, one column per prediction."""
    return examples.groupBy("label").pivot("prediction", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0)


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def split_leaks(examples: DataFrame) -> DataFrame:
    """Groups that appear in more than one split."""
    pairs = examples.select("group_id", "split").distinct()
    return pairs.groupBy("group_id").agg(
        F.count("*").alias("splits"), F.array_join(F.array_sort(F.collect_list("split")), ",").alias("split_names")
    ).where("splits > 1")


# --- durations --------------------------------------------------------------------------------


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, points: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation of whole-number values.

    Equal values are counted first, so that a group's state is its distinct
    values, not its rows, and a hot group combines before the shuffle.
    """
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(*keys).agg(
        F.sum("__n").alias("measured"),
        *[F.percentile(value, p, F.col("__n")).alias(f"p{round(p * 100)}") for p in points],
    )


def severity(category: Column, duration_ms: Column) -> Column:
    """NORMAL, WARN, SLOW or CRITICAL by the category's budget; NULL for unknown categories."""
    budget = lambda i: F.try_element_at(
        F.expr("map(" + ", ".join(f"'{k}', {v[i]}" for k, v in BUDGETS.items()) + ")"), F.lower(category)
    )
    return F.when(
        budget(0).isNotNull(),
        F.when(duration_ms >= budget(3), "CRITICAL").when(duration_ms >= budget(2), "SLOW").when(duration_ms >= budget(1), "WARN").otherwise("NORMAL"),
    )


def repeated_work(log: DataFrame, keys: Sequence[str] = ("kind", "key"), top: int = 20) -> DataFrame:
    """Keys done more than once, most often first (a top-k report)."""
    counts = log.groupBy(*keys).agg(F.count("*").alias("times")).where("times >= 2")
    return counts.orderBy(F.desc("times"), *keys).limit(top)


def retry_report(attempts: DataFrame) -> DataFrame:
    """Per operation: attempts, retries, time and waiting, and how the last attempt ended."""
    return attempts.groupBy("operation").agg(
        F.count("*").alias("attempts"),
        (F.count("*") - 1).alias("retries"),
        F.sum(F.col("duration_ms") + F.col("backoff_ms")).alias("total_ms"),
        F.sum("backoff_ms").alias("backoff_ms_total"),
        F.max_by("outcome", "attempt").alias("last_outcome"),
        F.count_if(F.col("outcome") != "ok").alias("failed_attempts"),
    )


def attempt_timeline(attempts: DataFrame) -> DataFrame:
    """Every attempt with its number within the operation; rows stay rows, so no group is collected."""
    return attempts.select("operation", "attempt", "duration_ms", "backoff_ms", "outcome", "code")


def stage_rollup(store_runs: DataFrame) -> DataFrame:
    """Stage totals per run and store with subtotals per run and overall."""
    grouped = store_runs.rollup("run_id", "store").agg(
        F.grouping_id().alias("level"),
        F.sum("duration_ms").cast("long").alias("elapsed_ms"),
        F.sum("search_ms").cast("long").alias("search_ms"),
        F.sum("fetch_ms").cast("long").alias("fetch_ms"),
        F.sum("fetches").cast("long").alias("fetches"),
        F.count_if(F.col("status") == "match").alias("matched"),
    )
    return grouped.withColumn("level", F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "run").otherwise("store"))


def fetch_costs(fetches: DataFrame) -> DataFrame:
    """Per store and stage: fetches, bytes, time and the 95th percentile, cache hits and retries."""
    totals = fetches.groupBy("store", "stage").agg(
        F.count("*").alias("fetches"), F.sum("bytes").cast("long").alias("bytes"), F.sum("duration_ms").cast("long").alias("total_ms"),
        F.count_if("cache_hit").alias("cache_hits"), F.sum("retries").cast("long").alias("retries"),
    )
    tail = percentiles(fetches, ["store", "stage"], "duration_ms", (0.95,)).drop("measured")
    return totals.join(tail, ["store", "stage"])


def product_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("products"))
