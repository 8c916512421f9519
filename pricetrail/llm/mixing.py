"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table, uniform

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = 1.5  # of all words, what the mix takes
MOST = 2  # copies of a source, at most
SEED = "mix"
LEAST_QUALITY = 0.05
STEPS = 512  # ranges of keys for each factor e between keys

#: Marks that prose has few of.
MARKS = "#$%&*+/<=>@[\\]^_`{|}~"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """The share of a text's characters that are not ``MARKS``, ``LEAST_QUALITY`` at least; of empty texts too."""
    plain = F.try_divide(F.length(F.translate(text, MARKS, "")), F.length(text))
    return F.greatest(F.coalesce(plain, F.lit(0.0)), F.lit(LEAST_QUALITY))


def source_key(source: Column) -> Column:
    """A text that sorts as the source does by code point, with null after all."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (``source_key``, ``source_size``).

    The sources share ``share`` of all sizes by weight; a target stops at ``most`` times its
    source's size and the excess is shared again. Sorted by how soon they reach their limit,
    the sources that do are a prefix, and all others get one level times their weight.
    One row per source passes through a single task, never the documents.
    """
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    soonest = Window.orderBy(F.col("most") / F.col("w"), "source_key")
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavy = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", rest / heavy).withColumn("n", F.row_number().over(soonest))
    rows = rows.withColumn("full", F.col("most") / F.col("w") <= F.col("level"))
    shared = F.min(F.when(~F.col("full"), F.struct("n", "level"))).over(whole)
    return rows.withColumn("shared", shared["level"]).select(
        "source_key", "source_size", F.when(F.col("full") | (F.col("n") < shared["n"]), F.col("most")).otherwise(F.col("w") * F.col("shared")).alias("target")
    )


def taken(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to rows with ``source_key``, ``size``, ``weight`` and ``uniform``.

    Each document's key is exponential with its weight as the rate. A source's complete epochs
    take every document; the words that are left go to its documents in the order of their
    keys until they are used up, so the last of these gives only some of its words.
    The running sums are made in two steps, over ranges of keys and inside a range: a range
    holds under a thousandth of a source whatever the weights are, so no source is one task's work.
    """
    key = -F.log(F.col("uniform")) / F.col("weight")
    rows = rows.withColumn("key", key).withColumn("range", F.floor(F.log(F.greatest("key", F.lit(1e-300))) * STEPS))
    ranges = rows.groupBy("source_key", "range").agg(F.sum("size").alias("words"))
    sources = targets(ranges.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source_key", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")).join(sources, "source_key")
    inside = Window.partitionBy("source_key", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    own = epochs * F.col("size") + F.greatest(F.least(rest - before, F.col("size")), F.lit(0))
    return rows.join(ranges, ["source_key", "range"]).withColumn("taken", own.cast("long")).drop("key", "range", "before")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy`` to rows with ``row`` (a number of its own), ``content`` and ``source_key``: from 0 among the rows of equal content and source.

    Rows are numbered inside the part of the input that they come from, and go on where the parts before end, so that not even
    equal rows in any number meet in one task.
    """
    rows = rows.withColumn("part", F.shiftright("row", 33))
    same = ["content", "source_key", "part"]
    before = Window.partitionBy("content", "source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*same).agg(F.count("*").alias("n")).select(*same, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*same).orderBy("row")) - 1
    return rows.withColumn("inside", inside).join(parts, same).withColumn("copy", F.col("first") + F.col("inside")).drop("part", "inside", "first")


def mix_rows(rows: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    """``mix`` for rows that have a ``row``, which comes back too."""
    text = F.col(text_col)
    content = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))
    keys = rows.select(
        "row", F.col(id_col).cast("long").alias("id"), content.alias("content"), source_key(F.col(source_col).cast("string")).alias("source_key"), word_count(text).alias("size"),
        (quality(text) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(LEAST_QUALITY))).alias("weight"),
    )
    keys = numbered(staged(keys))
    keys = staged(keys.select("row", "id", "source_key", "size", "weight", uniform(F.concat("content", F.lit(":"), F.col("copy").cast("string")), SEED).alias("uniform")))
    return taken(keys).drop("source_key", "weight", "uniform")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """One row per row of docs: ``id``, ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` is how many words the mix takes of the document, repeats counted. A row's random number comes from its id, its
    text and its number among equal rows, so rows without an id and rows that repeat are drawn each by itself.
    Null and empty texts have size 0 and give nothing; null sources are a source of their own, the last; without any word all targets are 0;
    an empty table gives none. The result depends on the rows alone. A weight below
    ``LEAST_QUALITY`` or null counts as that.
    """
    return mix_rows(docs.withColumn("row", F.monotonically_increasing_id()), id_col, text_col, source_col, weight).drop("row")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document's rows are its copies, the last one cut to the words that are left for it.

    Documents that the mix does not take go. Columns stay as they are, whatever their names; ``n_chars`` follows the text.
    """
    place = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    rows = staged(docs.toDF(*place.values()).withColumn("row", F.monotonically_increasing_id()))
    plan = mix_rows(rows, place["doc_id"], place["text"], place["source"], None).where("taken > 0")
    copies = F.array_repeat(F.lit(None).cast("int"), F.floor(F.try_divide("taken", "size")).cast("int"))
    part = F.try_mod("taken", "size").cast("int")
    plan = plan.select("row", F.explode(F.when(part > 0, F.concat(copies, F.array(part))).otherwise(copies)).alias("words"))
    text = F.col(place["text"])
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1, F.greatest("words", F.lit(1))), " ")
    met = rows.join(plan, "row").withColumn(place["text"], F.when(F.col("words").isNull(), text).otherwise(cut))
    if "n_chars" in place:
        met = met.withColumn(place["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return met.select(*place.values()).toDF(*docs.columns)


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         greatest(coalesce(CASE WHEN length(text) > 0 THEN length(translate(text, '{MARKS}', ''))::DOUBLE / length(text) END, 0.0), {LEAST_QUALITY}::DOUBLE) AS weight,
         coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, '')) AS content
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY content, source) - 1 AS copy FROM d),
r AS (SELECT *, (CAST('0x' || substr(md5('{SEED}:' || content || ':' || CAST(copy AS VARCHAR)), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM n),
k AS (SELECT *, coalesce('=' || source, '~') AS sk, -ln(u) / weight AS key FROM r),
s AS (SELECT sk, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY sk COLLATE C) - 1 AS place FROM k GROUP BY sk),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM s),
l AS (
  SELECT *, row_number() OVER o AS n,
         ((SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER p, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER p, 0)) AS level
  FROM w WINDOW o AS (ORDER BY most / w, sk), p AS (ORDER BY most / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(n) AS n FROM l WHERE most / w > level),
t AS (SELECT sk, source_size, CASE WHEN f.n IS NULL OR l.n < f.n THEN most ELSE w * (SELECT level FROM l, f WHERE l.n = f.n) END AS target FROM l, f),
b AS (
  SELECT k.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY k.sk ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.sk = t.sk)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CAST(epochs * size + greatest(least(floor(target - epochs * source_size) - before, size), 0) AS BIGINT) AS taken
FROM b
"""
