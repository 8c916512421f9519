"""Identity records: everything the matching rules compare, computed once per row."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammars, identifiers, models, title_attributes, titles, units
from ..functions.patterns import among, compact, let, literal_list, rx, rx_all, squash
from ..functions.text import fold_key
from ..rules import catalog
from ..schema import MONEY, STR_MAP
from ..session import spread, staged

TEXT_COLUMNS = ("title", "brand", "model", "variant", "gtin", "sku", "store", "product_id", "currency", "category")
EXTRA_KEYS = ("color", "storage", "size", "capacity", "ram", "vram", "edition", "network_lock")
MONITOR_SPECS = ("screen_size", "resolution", "refresh_rate", "panel")
SPECIAL = ("cooler", "psu", "monitor")  # categories whose own attributes are compared
COOLER_WORDS = ("water", "cooler", "liquid", "liquido", "air", "cpu", "aio", "refrigeracion")
PSU_WORDS = ("fonte", "psu", "power supply")
NOT_BRANDS = ("iphone", "galaxy", "smartphone")
LABELLED_CODE = (
    r"(?im)^\s*(?:manufacturer\s+part\s+number|manufacturer\s+sku|part\s+number|mpn|sku\s+do\s+fabricante"
    r"|c[oó]digo\s+do\s+fabricante|refer[eê]ncia)\s*[:#-]\s*(.+?)\s*$"
)


def _complete(items: DataFrame) -> DataFrame:
    """Add the columns an input lacks, so that a title alone is enough."""
    missing = {c: F.lit(None).cast("string") for c in TEXT_COLUMNS if c not in items.columns}
    for c in ("specifications", "metadata"):
        if c not in items.columns:
            missing[c] = F.create_map().cast(STR_MAP)
    if "price" not in items.columns:
        missing["price"] = F.lit(None).cast(MONEY)
    return items.withColumns(missing) if missing else items


def _meta(key: str) -> Column:
    value = F.try_element_at(F.col("metadata"), F.lit(key))
    return F.when((F.trim(value) != "") & (F.lower(F.trim(value)) != "none"), value)


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def _get(attributes: str | Column, key: str) -> Column:
    source = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.try_element_at(source, F.lit(key))


def _spec_values(labels: tuple[str, ...]) -> Column:
    """Values of the specifications whose folded label is one of the given."""
    found = F.filter(F.map_entries("specifications"), lambda e: among(squash(fold_key(e["key"])), labels))
    return F.transform(found, lambda e: e["value"])


def build_identities(items: DataFrame) -> DataFrame:
    """Add the identity of each listing or product to its row.

    The steps are separate projections, so that each piece of text is folded and
    parsed once and used by all later rules.
    """
    rows = _complete(items)
    for columns in identity_steps(id(items.sparkSession.sparkContext)):
        rows = rows.withColumns(columns)
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


class Steps(list):
    """Takes the projections of a function that adds columns to rows, without any rows."""

    def withColumns(self, columns: dict[str, Column]) -> Steps:  # noqa: N802 - as DataFrame has it
        self.append(columns)
        return self

    def withColumn(self, name: str, column: Column) -> Steps:  # noqa: N802
        return self.withColumns({name: column})


@functools.lru_cache(maxsize=1)
def identity_steps(_context: int) -> Steps:
    """The projections that make an identity. They mention columns by name only, and take long to build, so a session builds them once."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    rows = Steps().withColumns(
        {
            "specifications": F.coalesce("specifications", empty),
            "metadata": F.coalesce("metadata", empty),
        }
    )
    rows = rows.withColumns(
        {
            "__t": fold_key(F.col("title")),
            "__m": fold_key(F.col("model")),
            "__specs": F.concat_ws(" ", F.map_values("specifications")),
        }
    )
    rows = rows.withColumns(
        {
            "__blob": F.trim(F.concat_ws(" ", "__m", "__t")),
            "__raw_model": models.strip_non_model(F.col("__m")),
            "__category": F.coalesce(
                F.lower(F.nullif(F.trim("category"), F.lit(""))), F.lower(_meta("category")), title_attributes.category_of(F.col("title"))
            ),
        }
    )
    return _with_signatures(_with_brand(_with_codes(_with_category(_with_variants(rows)))))


#: What an identity is read from, and what an offer adds to it.
DESCRIPTION_TEXTS = ("title", "brand", "model", "variant", "gtin", "sku", "category")
DESCRIPTION_MAPS = ("specifications", "metadata")
OFFER_COLUMNS = ("store", "product_id", "price", "currency")


def with_description(items: DataFrame) -> DataFrame:
    """Adds ``description_id``, the SHA-256 of all that an identity is read from."""
    rows = _complete(items)
    entries = [F.array_sort(F.map_entries(c)).alias(c) for c in DESCRIPTION_MAPS]
    return rows.withColumn("description_id", F.sha2(F.to_json(F.struct(*DESCRIPTION_TEXTS, *entries), {"ignoreNullFields": "false"}), 256))


def describe(*items: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The identities of the distinct descriptions in all item tables (``description_id``, no offer columns), and each table's own columns that are no part of a description, with the id.

    A text that very many offers share is parsed once: descriptions combine before the shuffle.
    """
    rows = [with_description(spread(frame)) for frame in items]
    own = [[*[c for c in frame.columns if c not in (*DESCRIPTION_TEXTS, *DESCRIPTION_MAPS)], *[c for c in OFFER_COLUMNS if c not in frame.columns], "description_id"] for frame in items]
    entries = [F.array_sort(F.map_entries(c)).alias(c) for c in DESCRIPTION_MAPS]
    texts = [frame.select("description_id", *DESCRIPTION_TEXTS, *entries) for frame in rows]
    distinct = texts[0]
    for more in texts[1:]:
        distinct = distinct.unionByName(more)
    distinct = distinct.distinct().withColumns({c: F.map_from_entries(c) for c in DESCRIPTION_MAPS})
    return staged(build_identities(distinct).drop(*OFFER_COLUMNS)), [frame.select(*columns) for frame, columns in zip(rows, own, strict=True)]


def build_sides(refs: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identities of references and candidates, built in one pass and staged once.

    Both sides go through the same (large) projections, so they are planned and
    run together and read back as two filtered scans.
    """
    both = refs.withColumn("side", F.lit("ref")).unionByName(cands.withColumn("side", F.lit("cand")), allowMissingColumns=True)
    built = staged(build_identities(spread(both)))
    return built.where("side = 'ref'").drop("side"), built.where("side = 'cand'").drop("side")


def _with_variants(rows: Steps) -> Steps:
    """Gate attributes: variant text, specifications, metadata, then the title (first writer stays)."""
    variant = F.nullif(F.trim("variant"), F.lit(""))
    plain = F.when(~variant.contains(":") & ~among(squash(fold_key(variant)), catalog.WIFI_LABELS), variant)
    chip = models.gpu_chip(F.col("__blob")).isNotNull() | models.gpu_chip(fold_key(variant)).isNotNull()
    carrier = fold_key(_meta("carrier"))
    lock = (
        F.when(F.lower(_meta("carrier_locked")) == "true", "locked")
        .when(among(carrier, catalog.UNLOCKED_CARRIERS), "unlocked")
        .when(carrier.rlike(titles.CARRIER), "locked")
    )
    given = {k: _meta(k) for k in EXTRA_KEYS}
    given["network_lock"] = F.coalesce(given["network_lock"], lock)
    given["edition"] = F.coalesce(given["edition"], F.when(chip, plain))
    given["color"] = F.coalesce(given["color"], F.when(~chip, plain))
    entries = F.concat(
        F.coalesce(titles.variant_entries(titles.variant_pairs(variant)), F.array().cast("array<struct<key:string,value:string>>")),
        titles.variant_entries(F.col("specifications")),
        titles.variant_entries(title_attributes.to_map(given)),
    )
    rows = rows.withColumns({"__v": let(entries, titles.first_writer), "__disk": titles.storage_in_title(F.col("__t"))})
    storage = _get("__v", "storage")
    too_small = titles.capacity_gb(storage) <= catalog.RAM_LIKE_MAX_GB
    rows = rows.withColumns(
        {
            "__storage": F.when(storage.isNull() | F.coalesce(too_small, F.lit(False)), F.col("__disk")),
            "__color": F.when(_get("__v", "color").isNull(), titles.color_in_title(F.col("__t"))),
            "__lock": F.when(_get("__v", "network_lock").isNull(), titles.network_lock(F.col("__t"))),
            "__chip": models.gpu_chip(F.col("__blob")),
            # the title's line, else the one the specifications name
            "__edition": F.get(
                F.array_compact(
                    F.transform(F.array("title", "__specs"), lambda t: grammars.parse_as(t, "gpu")["variant_key"])
                ),
                F.lit(0),
            ),
            "__given_edition": titles.variant_value("edition", given["edition"]),
        }
    )
    own = title_attributes.to_map({"storage": F.col("__storage"), "color": F.col("__color"), "network_lock": F.col("__lock")})
    rows = rows.withColumn("__v", F.map_concat("__v", own))
    ram = titles.variant_value("ram", _get("__v", "ram"))
    vram = F.coalesce(ram, models.gpu_vram(F.col("__blob")))
    card = F.map_concat(
        F.map_filter("__v", lambda k, _: ~((k == "ram") & ram.isNotNull())),
        title_attributes.to_map(
            {
                "vram": vram,
                "edition": F.coalesce(F.col("__edition"), F.col("__given_edition")),
                "memory_type": F.coalesce(models.gddr(F.col("__blob")), models.gddr(fold_key(F.col("__specs")))),
            }
        ),
    )
    return rows.withColumn("variant_attrs", F.when(F.col("__chip").isNotNull(), card).otherwise(F.col("__v")))


def _from_sheet(wanted: Sequence[str]) -> Column:
    """First specification value that stands for each attribute, cleaned, as a map."""
    from .attributes import label_fits

    def first(attribute: str) -> Column:
        fitting = F.filter("__sheet", lambda e: label_fits(attribute, e["label"], e["value"]))
        return _entry(attribute, F.get(fitting, F.lit(0))["value"])

    cleaned = F.transform(
        F.array(*[first(k) for k in wanted]), lambda e: F.struct(e["key"].alias("key"), units.clean(e["key"], e["value"]).alias("value"))
    )
    return F.map_from_entries(F.filter(cleaned, lambda e: e["value"].isNotNull()))


def _with_category(rows: Steps) -> Steps:
    """Category attributes of coolers, power supplies and monitors, and the monitor's model code."""
    wanted = ("cooler_type", "radiator_size", "fan_count", "wattage", "efficiency", "modularity", "form_factor", "fan_size", *MONITOR_SPECS)
    by_title = title_attributes.rule_attributes(F.col("title"), F.col("__category"), wanted, SPECIAL)
    special = F.col("__category").isin(*SPECIAL)
    sheet = F.transform(
        F.map_entries("specifications"), lambda e: F.struct(squash(fold_key(e["key"])).alias("label"), e["value"].alias("value"))
    )
    rows = rows.withColumns({"__ta": F.when(special, by_title), "__special": special, "__sheet": sheet})
    # a sheet's value comes before the title's
    rows = rows.withColumn("__a", F.when(F.col("__special"), F.map_concat("__ta", _from_sheet(wanted))))
    value = lambda k: _get("__a", k)
    watts = rx(fold_key(value("wattage")), r"\b(\d{3,4})\b", 1)
    watts = F.when(watts.cast("int") >= 300, F.concat(watts.cast("int").cast("string"), F.lit(" w")))
    cooler = title_attributes.to_map(
        {
            "cooler_type": fold_key(value("cooler_type")),
            "radiator_size": units.normalise(F.lit("radiator_size"), value("radiator_size")),
            "fan_count": fold_key(value("fan_count")),
        }
    )
    psu = title_attributes.to_map(
        {
            "wattage": watts,
            "efficiency": F.coalesce(models.psu_efficiency(fold_key(value("efficiency"))), fold_key(value("efficiency"))),
            "modularity": fold_key(value("modularity")),
            "form_factor": fold_key(value("form_factor")),
            "fan_size": fold_key(value("fan_size")),
        }
    )
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    monitor = F.col("__category") == "monitor"
    specs = title_attributes.to_map({k: titles.variant_value(k, value(k)) for k in MONITOR_SPECS})
    rows = rows.withColumns(
        {
            "category_attrs": F.when(F.col("__category") == "cooler", cooler).when(F.col("__category") == "psu", psu).otherwise(none),
            "variant_attrs": F.when(monitor, F.map_concat("variant_attrs", specs)).otherwise(F.col("variant_attrs")),
            "__monitors": F.when(monitor, F.transform(F.array("title", "model"), lambda t: grammars.parse_as(t, "monitor"))),
            "__resolved": models.resolve_model(F.col("__raw_model"), F.col("__t")),
        }
    )
    rows = rows.withColumns({"__mt": F.get("__monitors", F.lit(0)), "__mm": F.get("__monitors", F.lit(1))})
    exact = lambda c: F.col(f"{c}.confidence") == "exact_title"
    code = F.coalesce(F.when(exact("__mt"), F.col("__mt.model")), F.when(exact("__mm"), F.col("__mm.model")))
    may_replace = F.col("model").isNull() | F.coalesce(exact("__mm"), F.lit(False))
    line = F.coalesce(F.col("__mt.product_line"), F.when(F.col("__mt.confidence") == "contextual", F.col("__mt.model")))
    return rows.withColumns(
        {
            "monitor_code": F.upper(F.regexp_replace(code, r"\s+", "")),
            "__resolved": F.when(monitor & may_replace, F.coalesce(compact(fold_key(line)), F.col("__resolved"))).otherwise(F.col("__resolved")),
        }
    )


def _with_codes(rows: Steps) -> Steps:
    """Part numbers (model, title, labelled rows and lines, then the SKU) and model numbers."""
    sheets = F.array_join(
        F.transform(_spec_values(("text", "description", "technical information")), lambda v: F.regexp_replace(v, "<[^>]*>", "\n")), "\n"
    )
    labelled = F.concat_ws(" ", F.array_join(_spec_values(catalog.PART_NUMBER_LABELS), " "), F.array_join(rx_all(sheets, LABELLED_CODE, 1), " "))
    rows = rows.withColumns({"__codes": fold_key(F.concat_ws(" ", "model", "title", labelled)), "__sku": fold_key(F.col("sku"))})
    none = F.array().cast("array<string>")
    phone_numbers = F.when(
        models.phone_line(F.col("__blob")).isNotNull(), rx_all(F.col("__t"), r"\ba\d{4}\b")
    ).otherwise(none)
    numbers = F.concat(F.transform(_spec_values(catalog.MODEL_NUMBER_LABELS), lambda v: compact(fold_key(v))), F.coalesce(phone_numbers, none))
    forms = F.concat(
        F.coalesce(identifiers.part_number_forms(F.col("__codes")), F.array().cast("array<struct<key:string,display:string>>")),
        F.coalesce(identifiers.part_number_forms(F.col("__sku"), False), F.array().cast("array<struct<key:string,display:string>>")),
    )
    rows = rows.withColumns({"__forms": forms, "model_numbers": F.array_sort(F.array_distinct(F.array_compact(numbers)))})
    return rows.withColumns(
        {
            "mpn": F.get("__forms", F.lit(0))["key"],
            "mpn_display": F.get("__forms", F.lit(0))["display"],
            "mpns": F.array_sort(F.array_distinct(F.transform("__forms", lambda f: f["key"]))),
            "own_mpns": F.coalesce(identifiers.part_numbers(F.col("__blob")), none),
        }
    )


def _with_brand(rows: Steps) -> Steps:
    """Folded brand; category words are none, and a title's first telling word may stand in."""
    given = identifiers.brand(F.col("brand"))
    rows = rows.withColumns(
        {"__given": given, "__cooler": F.when(F.col("__category") == "cooler", grammars.parse_as(F.col("title"), "cooler"))}
    )
    is_cooler, is_psu = F.col("__category") == "cooler", F.col("__category") == "psu"
    from_cooler = identifiers.brand(F.col("__cooler.brand"))
    first_of_model = identifiers.brand(F.element_at(F.split("__cooler.model", " "), 1))
    line_as_brand = F.col("__cooler.brand").isNull() & (F.col("__given") == first_of_model)
    kept = (
        F.when(is_cooler & among(F.col("__given"), COOLER_WORDS), from_cooler)
        .when(is_cooler & F.coalesce(line_as_brand, F.lit(False)), F.lit(None).cast("string"))
        .when(is_psu & among(F.col("__given"), PSU_WORDS), F.lit(None).cast("string"))
        .otherwise(F.col("__given"))
    )
    start = F.when(
        is_psu,
        F.regexp_replace(
            F.regexp_replace(F.col("__t"), r"^(?:fonte(?:\s+de\s+alimentacao)?|psu|power\s+supply)\b[\s:,-]*", ""), r"^(?:atx|sfx)\b[\s:,-]*", ""
        ),
    ).otherwise(F.col("__t"))
    word = F.get(
        F.filter(
            F.split(start, r"\s+"),
            lambda w: (w != "") & ~w.rlike(r"^\d{3,4}w?$") & ~w.isin("80", "plus", "bronze", "gold", "silver", "platinum"),
        ),
        F.lit(0),
    )
    from_title = F.when(~among(word, NOT_BRANDS), identifiers.brand(word))
    apple = F.when(F.col("__t").contains("iphone"), "apple")
    stand_in = F.when(is_cooler, from_cooler).otherwise(F.coalesce(from_title, apple))
    return rows.withColumn("__brand", F.coalesce(kept, stand_in))


def _with_signatures(rows: Steps) -> Steps:
    t, blob, category = F.col("__t"), F.col("__blob"), F.col("__category")
    condition = titles.condition(F.col("title"))
    edition = F.coalesce(F.col("__edition"), titles.variant_value("edition", _get("variant_attrs", "edition")))
    storage = F.coalesce(_get("variant_attrs", "storage"), _get("variant_attrs", "capacity"), F.col("__disk"))
    rows = rows.withColumns(
        {
            "brand": F.col("__brand"),
            "model_text": F.col("model"),
            "model": F.col("__resolved"),
            "gtin": identifiers.gtin(F.col("gtin")),
            "category": category,
            "title_normalized": titles.normalize_title(F.col("title")),
            "connectivity": models.connectivity(t),
            "market": models.market(t),
            "condition": condition,
            "sig": F.struct(
                F.col("__chip").alias("gpu"),
                edition.alias("edition"),
                models.ssd_line(blob).alias("ssd"),
                models.phone_line(blob).alias("phone"),
                models.ddr(blob).alias("ddr"),
                models.console_edition(blob).alias("console"),
                models.board_signature(blob).alias("board"),
                compact(fold_key(F.col("__cooler.model"))).alias("cooler"),
                models.psu_model(blob).alias("psu"),
                F.coalesce(_get("category_attrs", "wattage"), models.psu_wattage(blob)).alias("watts"),
                F.coalesce(_get("category_attrs", "efficiency"), models.psu_efficiency(blob)).alias("efficiency"),
                models.cpu_signature(blob).alias("cpu"),
                models.cpu_socket(blob).alias("socket"),
                models.cpu_family(blob, F.col("__resolved")).alias("cpu_family"),
                models.controllers(t).alias("controllers"),
                titles.variant_value("vram", F.coalesce(_get("variant_attrs", "vram"), models.gpu_vram(blob))).alias("vram"),
                titles.variant_value("storage", storage).alias("storage"),
                models.infer_model(t).alias("inferred"),
                compact(t).alias("compact_title"),
            ),
            "is_bundle": titles.has_bundle_marker(t),
            "is_system": titles.is_system(t),
            "is_card": titles.is_graphics_card(t),
            # gate values as they are compared, so that pairs only look them up
            "gates": F.transform_values("variant_attrs", lambda k, v: titles.variant_value(k, v)),
        }
    )
    return rows.withColumns(
        {
            "tokens": titles.title_tokens(F.col("title_normalized")),
            "soft_model": identifiers.soft_model(F.col("model")),
            "model_key": models.model_key(fold_key(F.col("model")), t),
            "variant_key": titles.map_key(F.col("variant_attrs")),
            "color": _get("gates", "color"),
        }
    ).withColumn("is_accessory", titles.has_accessory_word(F.col("tokens")))


IDENTITY_COLUMNS = [
    "store", "product_id", "price", "currency", "gtin", "brand", "model", "soft_model", "model_key", "title", "title_normalized",
    "tokens", "category", "variant_attrs", "gates", "category_attrs", "color", "mpn", "mpn_display", "mpns", "own_mpns", "model_numbers",
    "monitor_code", "condition", "is_accessory", "is_bundle", "is_system", "is_card", "sig",
]


def identity_struct(prefix: str | None = None) -> Column:
    columns = [F.col(c if prefix is None else f"{prefix}.{c}") for c in IDENTITY_COLUMNS]
    return F.struct(*columns)


def embedding_texts(rows: DataFrame) -> DataFrame:
    """Four texts per identity for semantic comparison; no exact identifiers among them."""
    variant = F.transform(
        F.array_sort(F.map_entries("variant_attrs")),
        lambda e: F.when(F.trim(e["value"]) != "", F.concat(F.lit("variant_"), e["key"], F.lit(": "), squash(e["value"]))),
    )
    lines = F.concat(
        F.array(
            *[
                F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c}: "), squash(F.col(c))))
                for c in ("category", "brand", "model")
            ]
        ),
        variant,
    )
    structured = F.array_join(F.array_compact(lines), "\n")
    raw = F.trim("title")
    return rows.withColumns(
        {
            "text_raw": raw,
            "text_normalized": titles.strip_condition(F.trim("title_normalized")),
            "text_structured": structured,
            "text_hybrid": F.concat_ws("\n", F.nullif(raw, F.lit("")), F.nullif(structured, F.lit(""))),
        }
    )


def search_queries(rows: DataFrame, locales: Sequence[str]) -> DataFrame:
    """Ordered distinct search queries per identity and locale.

    Title phrase first, then the barcode, the category's own ladder from exact to
    relaxed, and the part numbers. ``locales`` are the stores' search languages.
    """
    t = fold_key(F.col("title"))
    language = F.substring_index(F.lower("locale"), "-", 1)
    localized = None
    for name, labels in catalog.CATEGORY_SEARCH_LABELS.items():
        for lang, label in labels.items():
            hit = (F.col("category") == name) & (language == lang)
            localized = F.when(hit, label) if localized is None else localized.when(hit, label)
    color = None
    for hue, labels in catalog.COLOR_SEARCH_LABELS.items():
        for lang, label in labels.items():
            hit = (F.col("color") == hue) & (language == lang)
            color = F.when(hit, label) if color is None else color.when(hit, label)
    staged = rows.withColumn("locale", F.explode(literal_list(locales))).withColumns(
        {
            "__label": localized,
            "__hue": F.coalesce(color, F.col("color")),
            "__phrase": _title_phrase(t),
            "__short": models.search_phrase(F.col("model"), F.coalesce(fold_key(F.col("model_text")), F.lit("")), t),
            "__edition": F.lower(grammars.parse_as(F.col("title"), "gpu")["variant"]),
            "__board": models.board_phrase(t),
            "__family": models.board_family(t),
        }
    )
    storage = titles.variant_value("storage", _get("variant_attrs", "storage"))
    vram = F.col("sig.vram")
    brand, short, hue = F.col("brand"), F.col("__short"), F.col("__hue")
    row = lambda *parts: F.nullif(F.concat_ws(" ", *parts), F.lit(""))
    need = lambda first, *rest_: F.when(first.isNotNull(), row(first, *rest_))
    codes = F.col("mpns")
    gpu_type = _get("variant_attrs", "memory_type")
    by_category = (
        F.when(
            F.col("category") == "gpu",
            F.array(
                need(short, brand), F.col("mpn_display"), row(brand, short, F.col("__edition"), vram, gpu_type), row(F.col("__label"), short),
                row(brand, short, F.col("__edition"), vram), row(brand, short, F.col("__edition")), row(brand, short),
            ),
        )
        .when(F.col("category") == "cpu", F.array(row(brand, short), short, F.col("sig.cpu")))
        .when(
            F.col("category") == "psu",
            F.array(F.col("sig.psu"), need(F.col("sig.psu"), brand), row(F.col("sig.psu"), F.col("sig.watts")), F.col("mpn_display")),
        )
        .when(
            F.col("category") == "monitor",
            F.array(
                need(F.col("monitor_code"), brand), F.col("monitor_code"),
                F.when(F.col("monitor_code").isNull(), row(brand, short, _get("variant_attrs", "screen_size"), _get("variant_attrs", "refresh_rate"))),
            ),
        )
        .when(
            F.col("category") == "cooler",
            F.array(row(brand, F.col("sig.cooler"), _get("category_attrs", "radiator_size")), row(brand, F.col("sig.cooler")), F.col("sig.cooler")),
        )
        .when(
            F.col("category") == "motherboard",
            F.array(F.col("mpn_display"), row(brand, F.col("__board")), F.col("__board"), row(brand, F.col("__family")), row(brand, F.col("sig.board"))),
        )
        .when(
            F.col("category") == "smartphone",
            F.array(row(short, storage, hue), row(brand, short, storage), row(short, storage), short),
        )
        .otherwise(F.array(F.col("mpn_display"), row(brand, short), short, need(short, hue), need(short, storage)))
    )
    ladder = F.concat(F.array(F.col("__phrase"), F.col("gtin")), by_category, codes, F.array(F.col("title_normalized")))
    clean = F.transform(F.array_compact(ladder), lambda q: squash(F.lower(q)))
    distinct = F.array_distinct(F.filter(clean, lambda q: q != ""))
    return staged.withColumn("queries", distinct).drop(*[c for c in staged.columns if c.startswith("__")])


def _title_phrase(folded: Column) -> Column:
    """The title as a search phrase: no part numbers, bus widths, units or shop words."""
    text = let(folded, lambda t: F.aggregate(identifiers.part_number_matches(t), t, lambda acc, m: F.replace(acc, m, F.lit(" "))))
    for pattern in (
        r"\b\d+\s*-\s*bits?\b", r"\b\d+(?:[.,]\d+)?\s*(?:ghz|mhz|khz|hz|mah|mp)\b",
        r"\b\d+(?:[.,]\d+)?\s*(?:\"|pol(?:egadas)?|inch(?:es)?)", r"\b\d+\s*gb\s*ram\b", r"\b\d+(?:[+x]\d+){1,}(?:mp)?\b",
        r"[^a-z0-9-]+", r"(?<![a-z0-9])-(?![a-z0-9])",
    ):
        text = F.regexp_replace(text, pattern, " ")
    words = F.filter(
        F.split(F.trim(text), r"\s+"),
        lambda w: (w != "") & ~among(w, catalog.SEARCH_NOISE) & ~w.rlike(r"^\d+-?(?:core|threads?)$"),
    )
    return F.nullif(F.array_join(F.array_distinct(words), " "), F.lit(""))


