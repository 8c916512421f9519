"""Product images: availability, galleries, reuse and backlog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def image_status() -> Column:
    """ready, processing, storage_error or invalid_reference of an image row."""
    has_small = (F.col("optimized_status") == "ready") & F.col("optimized_file_id").isNotNull()
    return (
        F.when(F.coalesce(has_small, F.lit(False)), "ready")
        .when(F.col("original_status") == "ready", F.when(F.col("original_file_id").isNotNull(), "ready").otherwise("invalid_reference"))
        .when(F.col("original_status").isin("pending", "downloading"), "processing")
        .when(F.col("original_status") == "failed", "storage_error")
        .otherwise("processing")
    )


def with_view(images: DataFrame) -> DataFrame:
    """Add status, display link, error and whether the smaller copy failed."""
    path = F.concat(F.lit("/products/"), F.col("product_id").cast("string"), F.lit("/images/"), F.col("id").cast("string"), F.lit("/content"))
    small = F.coalesce((F.col("optimized_status") == "ready") & F.col("optimized_file_id").isNotNull(), F.lit(False))
    stored = F.coalesce((F.col("original_status") == "ready") & F.col("original_file_id").isNotNull(), F.lit(False))
    original = F.when(stored, F.concat(path, F.lit("?variant=original"))).when(
        F.col("original_status").isin("pending", "downloading"), F.col("source_url")
    )
    status = image_status()
    broken = (F.col("optimized_status") == "failed") | ((F.col("optimized_status") == "ready") & F.col("optimized_file_id").isNull())
    return images.withColumns(
        {
            "image_status": status,
            "display_url": F.when(small, F.concat(path, F.lit("?variant=optimized"))).otherwise(original),
            "image_error": F.when(status.isin("invalid_reference", "storage_error"), status),
            "warning": F.when(broken & stored, "optimized_unavailable"),
        }
    )


def import_status(images: DataFrame) -> DataFrame:
    """Per product: images in error, ready, processing and pending, in that order of precedence."""
    state = (
        F.when((F.col("original_status") == "failed") | (F.col("optimized_status") == "failed"), "error")
        .when(F.col("optimized_status") == "ready", "ready")
        .when((F.col("original_status") == "downloading") | (F.col("optimized_status") == "processing"), "processing")
        .otherwise("pending")
    )
    return images.withColumn("state", state).groupBy("product_id").agg(
        F.count("*").alias("images"), *[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "processing", "ready", "error")]
    )


def primary_images(images: DataFrame) -> DataFrame:
    """Main image per product, else the first by position and creation."""
    rank = F.struct((~F.col("is_main")).alias("m"), F.col("position"), F.col("created_at"), F.col("id"))
    return with_view(images).groupBy("product_id").agg(F.min_by(F.struct("id", "display_url", "image_status"), rank).alias("i")).select("product_id", "i.*")


def resequence(images: DataFrame) -> DataFrame:
    """Positions 0..n-1 per product; the first becomes main where none is.

    A gallery is small by nature, so one window per product is enough.
    """
    by = Window.partitionBy("product_id")
    order = by.orderBy("position", "created_at", "id")
    rows = images.withColumns({"position": F.row_number().over(order) - 1, "__any": F.max(F.col("is_main").cast("int")).over(by)})
    return rows.withColumn("is_main", F.col("is_main") | ((F.col("__any") == 0) & (F.col("position") == 0))).drop("__any")


def next_positions(images: DataFrame) -> DataFrame:
    return images.groupBy("product_id").agg((F.max("position") + 1).alias("next_position"))


def reusable(images: DataFrame) -> DataFrame:
    """For every image another one of its product with the same original and a ready smaller copy."""
    ready = images.where((F.col("optimized_status") == "ready") & F.col("optimized_file_id").isNotNull())
    # the two smallest ids per original are enough: one of them is another image
    best = ready.groupBy("product_id", "original_file_id").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    joined = images.select("id", "product_id", "original_file_id").join(best, ["product_id", "original_file_id"])
    other = F.when(F.col("first") != F.col("id"), F.col("first")).when(F.col("last") != F.col("id"), F.col("last"))
    return joined.withColumn("reuse_id", other).where(F.col("reuse_id").isNotNull()).select("id", "product_id", "reuse_id")


def by_content(images: DataFrame) -> DataFrame:
    """One image per product and content hash, the first by position; rows being deleted do not count."""
    live = images.where((F.col("original_status") != "deleting") & F.col("sha256").isNotNull())
    rest = [c for c in images.columns if c not in ("product_id", "sha256")]
    return live.groupBy("product_id", "sha256").agg(F.min_by(F.struct(*rest), F.struct("position", "id")).alias("r")).select("product_id", "sha256", "r.*")


def due(now: Column) -> Column:
    """Images whose smaller copy may be made now: pending and free, or left behind by a lost worker."""
    lease_free = F.col("claim_expires_at").isNull() | (F.col("claim_expires_at") <= now)
    pending = (
        (F.col("optimized_status") == "pending")
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
        & lease_free
    )
    left = (F.col("optimized_status") == "processing") & lease_free
    original = F.col("original_status").isin("pending", "downloading") | (
        (F.col("original_status") == "ready") & F.col("original_file_id").isNotNull()
    )
    return F.coalesce(original & (pending | left), F.lit(False))


def backlog(images: DataFrame, now: Column, limit: int) -> DataFrame:
    return images.where(due(now)).orderBy(F.asc_nulls_first("next_attempt_at"), "created_at", "id").limit(max(1, limit))


def gallery_audit(images: DataFrame) -> DataFrame:
    """Products whose gallery has not exactly one main image, or repeats a position."""
    return images.groupBy("product_id").agg(
        F.count("*").alias("images"), F.count_if("is_main").alias("mains"), F.count_distinct("position").alias("positions")
    ).where((F.col("mains") != 1) | (F.col("positions") != F.col("images")))


def funnel(passes: DataFrame) -> DataFrame:
    """Per store: images found, kept, distinct, returned and omitted, and how the passes ended."""
    return passes.groupBy("store").agg(
        F.count("*").alias("passes"),
        F.sum("raw").cast("long").alias("found"),
        F.sum("after_filter").cast("long").alias("kept"),
        F.sum("after_dedup").cast("long").alias("distinct_images"),
        F.sum("returned").cast("long").alias("returned"),
        F.sum(F.col("raw") - F.col("returned")).cast("long").alias("omitted"),
        F.count_if(F.col("returned") > 0).alias("success"),
        F.count_if(F.col("returned") == 0).alias("empty"),
    )
