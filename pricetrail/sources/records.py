"""Typed record sources: offers, details, histories and labelled pairs. No schema inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..operators.reports import LABELS, SPLITS
from ..schema import DETAILS, EVENT, OBSERVATION, OFFER, SNAPSHOT, STR_MAP, S, struct

AVAILABILITY = ("available", "in_stock", "out_of_stock", "preorder", "unknown")
CORRUPT = "_corrupt_record"


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "json":
        with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = spark.read.schema(with_corrupt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.format(fmt).load(path)


def offers(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Valid offers and the refused rows with a reason."""
    return split_valid(read(spark, path, OFFER, fmt), offer_error())


def details(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    rows = read(spark, path, DETAILS, fmt)
    return split_valid(rows, F.when(blank_to_null(F.col("title")).isNull(), "title_missing"))


def offer_error() -> Column:
    """Why an offer row is refused: no identity, no link, or a price that is not above zero."""
    missing = lambda c: blank_to_null(F.col(c)).isNull()
    return (
        F.when(missing("store") | missing("product_id"), "identity_missing")
        .when(missing("url"), "url_missing")
        .when(F.col("price").isNull() | (F.col("price") <= 0), "price_not_positive")
        .when((F.col("pix_price") <= 0) | (F.col("original_price") <= 0), "price_not_positive")
        .when(missing("currency"), "currency_missing")
        .when(F.col("availability").isNotNull() & ~F.col("availability").isin(*AVAILABILITY), "availability_unknown")
    )


def split_valid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    if CORRUPT in rows.columns:
        error = F.when(F.col(CORRUPT).isNotNull(), "malformed").otherwise(error)
    judged = rows.withColumn("error", error)
    good = judged.where(F.col("error").isNull()).drop("error", CORRUPT)
    return good, judged.where(F.col("error").isNotNull())


def observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, OBSERVATION, fmt)


def history(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Snapshots or events, written by day; a time filter prunes the folders.

    ``between`` filters on the day column as well as on the time.
    """
    schema = {"snapshots": SNAPSHOT, "events": EVENT}[kind]
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).parquet(path)


def between(rows: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Rows with ``start <= column < end``; the day bounds reach the partition filter."""
    days = (F.col("day") >= F.to_date(start)) & (F.col("day") <= F.to_date(end))
    return rows.where(days & (F.col(column) >= start) & (F.col(column) < end))


# --- labelled pairs ---------------------------------------------------------------------------

IDENTITY_FIELDS = struct(
    ("gtin", S), ("brand", S), ("model", S), ("title", S), ("title_normalized", S), ("variant_attrs", STR_MAP),
    ("category_attrs", STR_MAP), ("store", S), ("product_id", S), ("price", S), ("currency", S), ("mpn", S), ("mpn_display", S),
    ("mpn_aliases", T.ArrayType(S)), ("model_numbers", T.ArrayType(S)), ("monitor_model_code", S), ("category", S),
)
PAIR = struct(
    ("schema_version", S), ("sample_id", S), ("group_id", S), ("split", S), ("label", S), ("category", S),
    ("reference_language", S), ("candidate_language", S), ("provenance", S), ("label_basis", S),
    ("reference", IDENTITY_FIELDS), ("candidate", IDENTITY_FIELDS),
)
PROVENANCE = ("live_match_run", "live_public_listings", "regression_fixture", "synthetic")


def labelled_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of a JSON-lines file and the reasons any row or the set is unusable.

    Checks: well-formed, version 1, no unknown field in a pair or its two identities, known label, split and
    provenance, texts present, sample ids unique, groups within one split. The
    set may be used only if the second frame is empty and the first is not.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", PAIR).alias("p"), F.json_object_keys("value").alias("keys"), "value",
    )
    pairs = parsed.select("p.*", "keys", "value")
    names = lambda schema: F.array(*[F.lit(f.name) for f in schema.fields])
    nested = lambda side: F.coalesce(F.json_object_keys(F.get_json_object("value", f"$.{side}")), F.array().cast("array<string>"))
    unknown = F.concat(
        F.array_except("keys", names(PAIR)), F.array_except(F.concat(nested("reference"), nested("candidate")), names(IDENTITY_FIELDS))
    )
    empty = lambda c: blank_to_null(F.col(c)).isNull()
    error = (
        F.when(F.col("keys").isNull(), "malformed")
        .when(F.size(unknown) > 0, "unknown_field")
        .when(~F.coalesce(F.col("schema_version") == "1", F.lit(False)), "schema_version")
        .when(empty("sample_id") | empty("group_id") | empty("category"), "text_missing")
        .when(empty("reference_language") | empty("candidate_language"), "text_missing")
        .when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "split")
        .when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label")
        .when(F.col("provenance").isNotNull() & ~F.col("provenance").isin(*PROVENANCE), "provenance")
        .when(F.col("reference.title").isNull() | F.col("candidate.title").isNull(), "identity")
    )
    judged = pairs.withColumn("error", error)
    good = judged.where("error IS NULL").drop("error", "keys", "value")
    repeated = good.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id", F.lit("sample_id_repeated").alias("error"))
    leaks = good.select("group_id", "split").distinct().groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    leaked = good.join(leaks.select("group_id"), "group_id", "left_semi").select("sample_id", F.lit("group_in_two_splits").alias("error"))
    bad = judged.where("error IS NOT NULL").select("sample_id", "error")
    return good, bad.unionByName(repeated).unionByName(leaked)


def content_digest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file of a labelled set; the files are small by nature (a few thousand lines)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
