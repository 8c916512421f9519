"""Attribute resolution: from evidence rows to one value with its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammars, identifiers, title_attributes, units
from ..functions.patterns import among, any_of, let, literal_list, squash
from ..functions.text import fold_key
from ..rules import catalog
from ..session import spread

RAM_LABEL = r"\bram\b|memoria\s*ram|system memory"
DISK_LABEL = r"storage|armazen|almacen|ssd|hdd|disco|built-in|memoria\s*interna|internal\s*memory"
VARIANT_DIMENSIONS = ("color", "storage", "ram", "size", "capacity", "screen_size")
# Attributes that only identifiers or specifications may state, never a title.
NOT_FROM_TITLE = ("mpn", "gtin", "sku")


def spec_attribute(attribute: str, label: Column, value: Column) -> Column:
    """True when a specification label stands for the attribute.

    Short aliases must be whole words; long ones match as parts either way.
    RAM, storage and video memory labels are kept apart.
    """
    return let(squash(fold_key(label)), lambda folded: label_fits(attribute, folded, value))


def label_fits(attribute: str, folded: Column, value: Column) -> Column:
    aliases = catalog.SPEC_LABELS.get(attribute, [attribute])
    short = [a for a in aliases if len(a) <= 3]
    long = [a for a in aliases if len(a) > 3]
    hit = among(folded, aliases)
    if short:
        hit = hit | folded.rlike(rf"\b{any_of(short)}\b")
    if long:
        # a label inside an alias, as "memory" in "system memory"
        hit = hit | folded.rlike(any_of(long)) | ((folded != "") & F.lit("|".join(long)).contains(folded))
    if attribute == "storage":
        hit = hit & ~folded.rlike(RAM_LABEL)
    if attribute == "ram":
        hit = hit & ~folded.rlike(DISK_LABEL) & ~value.rlike(title_attributes.VRAM_MARK)
    if attribute == "vram":
        hit = hit | (folded.isin("memoria", "memory", "memoria dedicada") & value.rlike(title_attributes.VRAM_MARK))
    return F.coalesce(hit, F.lit(False))


def from_specifications(specs: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Evidence rows of long-form specifications (product_id, position, source, label, value).

    Every label is tested against all attributes in one pass over the row; an
    attribute's first fitting label in the sheet's order counts.
    """
    folded, value = F.col("folded"), F.col("value")
    fits = F.array_compact(F.array(*[F.when(label_fits(a, folded, value), F.lit(a)) for a in attributes]))
    rows = (
        specs.withColumn("folded", squash(fold_key(F.col("label"))))
        .select("product_id", "source", "position", "value", F.explode(fits).alias("attribute"))
        .withColumn("value", units.clean(F.col("attribute"), value))
        .where(F.col("value").isNotNull())
    )
    return rows.groupBy("product_id", "attribute", "source").agg(F.min_by("value", "position").alias("value"))


def from_titles(products: DataFrame) -> DataFrame:
    """Evidence rows of titles (product_id, title, category)."""
    made = title_attributes.title_attributes(F.col("title"), F.col("category"))
    return spread(products).select("product_id", F.explode(made).alias("attribute", "value")).select(
        "product_id", "attribute", F.lit("title").alias("source"), "value"
    )


def resolve(evidence: DataFrame) -> DataFrame:
    """One value per product and attribute: the best source that has one, and which it was."""
    rank = F.array_position(literal_list(catalog.EVIDENCE_ORDER), F.col("source"))
    usable = evidence.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    safe = usable.where(~(F.col("source").isin("title", "url") & among(F.col("attribute"), NOT_FROM_TITLE)))
    best = F.min_by(F.struct("value", "source"), F.struct(rank.alias("r"), F.col("value").alias("v")))
    return safe.groupBy("product_id", "attribute").agg(best.alias("b")).select("product_id", "attribute", "b.value", "b.source")


def conflicts(evidence: DataFrame) -> DataFrame:
    """Attributes whose sources disagree after normalising, with the winner."""
    value = fold_key(units.normalise(F.col("attribute"), F.col("value")))
    rank = F.array_position(literal_list(catalog.EVIDENCE_ORDER), F.col("source"))
    rows = evidence.where(F.col("value").isNotNull() & (F.trim("value") != "")).select(
        "product_id", "attribute", "source", "value", value.alias("norm"), rank.alias("rank")
    )
    # one row per source and value first, so that a group never holds more than the sources' values
    merged = rows.groupBy("product_id", "attribute", "norm").agg(
        F.min_by(F.struct("rank", "source", "value"), F.struct("rank", "value")).alias("best")
    )
    grouped = merged.groupBy("product_id", "attribute").agg(
        F.count("*").alias("distinct_values"),
        F.min_by("best", F.struct("best.rank", "best.value")).alias("winner"),
        F.max_by("best", F.struct("best.rank", "best.value")).alias("last"),
    )
    return grouped.where("distinct_values > 1").select(
        "product_id", "attribute", "distinct_values",
        F.col("winner.source").alias("winner_source"), F.col("winner.value").alias("winner_value"),
        F.col("last.source").alias("other_source"), F.col("last.value").alias("other_value"),
    )


def to_wide(resolved: DataFrame) -> DataFrame:
    """One row per product: attribute -> value and attribute -> source maps."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", c))))
    return resolved.groupBy("product_id").agg(entries("value").alias("values"), entries("source").alias("sources"))


def apply_category_identity(products: DataFrame) -> DataFrame:
    """Correct brand, model and edition with the category's title grammar.

    Input: title, category, values, sources (``to_wide``). A structured model
    that already is a base model is only spelt canonically; opaque codes and
    line names give way to the title's model.
    """
    get = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    rows = products.withColumns(
        {
            "__p": grammars.parse(F.col("title"), F.col("category")),
            "__own": grammars.parse(get("values", "model"), F.col("category")),
        }
    )
    p = F.col("__p")
    brand, brand_from = get("values", "brand"), get("sources", "brand")
    noise = among(F.lower(brand), [*catalog.CATEGORY_PREFIXES, "gpu", "nvidia", "geforce", "radeon"])
    from_title = brand_from == "title"
    sure = p["confidence"].isin("exact_title", "contextual")
    take_brand = p["brand"].isNotNull() & (brand.isNull() | (from_title & (noise | sure)))
    drop_brand = p["brand"].isNull() & from_title & (noise | (F.col("category") == "cooler"))
    model, model_from = get("values", "model"), get("sources", "model")
    structured = F.coalesce(model_from.isin("specifications", "structured"), F.lit(False))
    base = F.coalesce(grammars.is_base_model(F.col("category"), model), F.lit(False))
    keep_model = structured & base
    take_model = p["model"].isNotNull() & ~keep_model
    displaced = F.when(structured & take_model & ~F.coalesce(identifiers.opaque_code(model), F.lit(False)), model)
    edition = get("values", "edition")
    new_edition = F.when(take_model, F.coalesce(p["variant"], displaced, edition)).otherwise(F.coalesce(edition, p["variant"]))
    new_model = F.when(take_model, p["model"]).when(
        keep_model, grammars.base_model_display(F.col("category"), model, F.col("__own"))
    ).otherwise(model)
    title_source = lambda changed, old: F.when(changed, "title").otherwise(old)
    values = F.map_concat(
        F.map_filter("values", lambda k, _: ~k.isin("brand", "model", "edition")),
        title_attributes.to_map(
            {
                "brand": F.when(F.coalesce(take_brand, F.lit(False)), p["brand"]).when(~F.coalesce(drop_brand, F.lit(False)), brand),
                "model": new_model,
                "edition": new_edition,
                "gpu_model": F.coalesce(get("values", "gpu_model"), F.when(F.col("category") == "gpu", p["model"])),
            }
        ),
    )
    edition_from = F.when(new_edition.eqNullSafe(edition), get("sources", "edition")).when(
        new_edition.eqNullSafe(p["variant"]), "title"
    ).otherwise(model_from)
    sources = F.map_concat(
        F.map_filter("sources", lambda k, _: ~k.isin("brand", "model", "edition")),
        title_attributes.to_map(
            {
                "brand": F.when(~F.coalesce(drop_brand, F.lit(False)), title_source(F.coalesce(take_brand, F.lit(False)), brand_from)),
                "model": title_source(take_model, model_from),
                "edition": F.when(new_edition.isNotNull(), edition_from),
            }
        ),
    )
    return rows.withColumns({"values": values, "sources": sources}).drop("__p", "__own")


def fill_specifications(specifications: Column, values: Column) -> Column:
    """Specifications plus the resolved attributes they lack (brand and model stay outside)."""
    new = F.map_filter(
        values, lambda k, _: ~k.isin("brand", "model") & ~F.coalesce(F.map_contains_key(specifications, k), F.lit(False))
    )
    return F.map_concat(specifications, new)


def variant_text(values: Column, keys: Sequence[str] = VARIANT_DIMENSIONS) -> Column:
    """``color: Blue; storage: 128 GB`` of the dimensions that have a value."""
    parts = [F.concat(F.lit(f"{k}: "), F.nullif(F.try_element_at(values, F.lit(k)), F.lit(""))) for k in keys]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def public_variant(values: Column, category: Column) -> Column:
    """The variant people see: the edition for cards and editions, dimensions otherwise."""
    edition = F.try_element_at(values, F.lit("edition"))
    dims = variant_text(values)
    chain = F.when(category == "gpu", edition)
    for name, keys in catalog.VARIANT_FROM.items():
        made = F.coalesce(edition, dims) if keys == ("edition",) else variant_text(values, keys)
        chain = chain.when(category == name, made)
    return chain.when(category.isNotNull() & edition.isNotNull(), edition).otherwise(dims)
