"""Titles: comparable tokens, colours, conditions, capacities and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import catalog
from . import models
from .identifiers import part_number_matches
from .patterns import among, any_of, has_any, let, literal_list, lookup, rx, rx_all, squash
from .text import fold_key

# --- tokens -----------------------------------------------------------------------------------


def normalize_title(title: Column) -> Column:
    """Comparable title: one language's words, joined units and codes, no noise words."""
    text = fold_key(title)
    for word, phrases in catalog.TITLE_ALIASES.items():
        text = F.regexp_replace(text, rf"\b{any_of(phrases)}\b", word)
    text = F.regexp_replace(text, r"\b(\d+)\s*(gb|tb|mb)\b", "$1$2")

    def with_joined_codes(t):
        codes = F.filter(part_number_matches(t), lambda m: m.rlike(r"[-/\s]"))
        return F.aggregate(codes, t, lambda acc, m: F.replace(acc, m, F.regexp_replace(m, "[^a-z0-9]+", "")))

    text = F.regexp_replace(let(text, with_joined_codes), models.BOARD_DASHED, "$1$2")
    words = F.split(F.trim(F.regexp_replace(text, r"[^a-z0-9\s]+", " ")), r"\s+")
    kept = F.filter(words, lambda w: (w != "") & ~among(w, catalog.TITLE_STOPWORDS))
    single = {w: c for w, c in {**catalog.COLOR_FINISHES, **catalog.COLORS}.items() if " " not in w}
    return F.array_join(F.transform(kept, lambda w: F.coalesce(lookup(single, w), w)), " ")


def title_tokens(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))


def similarity(left: Column, right: Column) -> Column:
    """Shared tokens over the larger token set, 0 when either is empty."""
    most = F.greatest(F.size(left), F.size(right))
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / most).otherwise(F.lit(0.0))


def search_words(title: Column) -> Column:
    """Title cut into its words: spaced dashes and bars separate, code dashes stay."""
    bare = F.regexp_replace(title, r"\s+[-–—|/,_]+\s+", " ")
    bare = squash(F.regexp_replace(bare, r"[|/,_]+", " "))
    return F.filter(F.split(bare, " "), lambda w: (w != "") & (w != "-"))


# --- colours ----------------------------------------------------------------------------------


def _words_to(table: dict[str, str], words: Column) -> Column:
    return F.transform(words, lambda w: lookup(table, w))


def canonical_color(text: Column) -> Column:
    """One name per colour; a hue with known finishes becomes its sorted parts."""
    single = {w: c for w, c in {**catalog.COLOR_FINISHES, **catalog.COLORS}.items() if " " not in w}

    def named(plain, words, parts):
        hues = F.filter(parts, lambda p: among(p, catalog.HUES))
        compound = F.when(
            ~F.exists(parts, lambda p: p.isNull()) & (F.size(hues) == 1), F.array_join(F.array_sort(parts), " ")
        )
        last = F.element_at(words, -1)
        # the longest ending that is a known colour; none of them has more than two words
        pair = F.when(F.size(words) >= 2, lookup(catalog.COLORS, F.concat_ws(" ", F.element_at(words, -2), last)))
        return F.coalesce(lookup(catalog.COLORS, plain), compound, pair, lookup(catalog.COLORS, last), plain)

    return let(
        squash(F.regexp_replace(text, "[-_]+", " ")),
        lambda plain: let(
            F.split(plain, " "),
            lambda words: let(_words_to(single, words), lambda parts: named(plain, words, parts)),
        ),
    )


def color_in_title(folded: Column) -> Column:
    """The longest colour label a title mentions."""
    plain = squash(F.regexp_replace(folded, "[-_]+", " "))
    return let(
        rx_all(plain, rf"\b{any_of(catalog.COLORS)}\b"),
        lambda found: let(
            F.array_max(F.transform(found, lambda c: F.length(c))),
            lambda longest: F.get(F.filter(found, lambda c: F.length(c) == longest), F.lit(0)),
        ),
    )


def color_hues(value: Column) -> Column:
    """Known hues in a canonical colour."""
    words = F.filter(F.split(value, " "), lambda w: among(w, catalog.HUES))
    whole = F.when(among(value, catalog.HUES), F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(words, whole)))


def colors_compatible(left: Column, right: Column) -> Column:
    """Equal hues, or a bare finish beside a hue that goes with it."""
    hue_words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: among(w, catalog.HUES))))
    a, b = hue_words(left), hue_words(right)
    finish = (among(left, catalog.FINISH_ONLY) & among(right, catalog.FINISH_HUES)) | (
        among(right, catalog.FINISH_ONLY) & among(left, catalog.FINISH_HUES)
    )
    return (left == right) | ((F.size(a) > 0) & (a == b)) | finish


def color_family(color: Column) -> Column:
    return F.coalesce(lookup(catalog.COLOR_FAMILY, color), color)


# --- variant values ---------------------------------------------------------------------------

SIZED = ("storage", "capacity", "ram", "size", "vram")


def sized_value(value: Column) -> Column:
    """256 GB -> 256gb, 12G -> 12gb (folded input)."""
    tight = F.regexp_replace(value, r"\s+", "")
    return F.regexp_replace(tight, r"^(\d+)g$", "$1gb")


INCHES = r"^(\d+(?:\.\d+)?)(?:in|inch|inches|pol|polegadas|\"|')?$"
GRID = r"(\d{3,5})\s*x\s*(\d{3,5})"


def _screen_value(text: Column) -> Column:
    tight = F.regexp_replace(text, r"\s+", "")
    return F.when(tight.rlike(INCHES), F.concat(F.regexp_extract(tight, INCHES, 1), F.lit("in"))).otherwise(tight)


def _grid_value(text: Column) -> Column:
    pair = F.concat_ws("x", F.regexp_extract(text, GRID, 1), F.regexp_extract(text, GRID, 2))
    return F.when(text.rlike(GRID), pair).otherwise(text)


# canonical value per variant attribute, from folded text
VALUE_RULES = {
    "screen_size": _screen_value,
    "resolution": _grid_value,
    "refresh_rate": lambda t: F.regexp_replace(t, r"\s+hz\b", "hz"),
    **{k: sized_value for k in SIZED},
    "edition": lambda t: F.coalesce(models.variant_key(t), F.regexp_replace(t, "[^a-z0-9]+", "")),
    "color": canonical_color,
    "network_lock": lambda t: F.coalesce(lookup(catalog.LOCK_WORDS, t), t),
}


def variant_value(key: Column | str, value: Column) -> Column:
    """Canonical value of a variant attribute."""
    if isinstance(key, str):
        return let(squash(fold_key(value)), VALUE_RULES.get(key, lambda t: t))

    def by_key(text):
        chain = None
        for name, rule in VALUE_RULES.items():
            hit = key == name
            chain = F.when(hit, rule(text)) if chain is None else chain.when(hit, rule(text))
        return chain.otherwise(text)

    return let(squash(fold_key(value)), by_key)


def capacity_gb(value: Column) -> Column:
    shape = r"^(\d{1,9})(gb|tb)?$"
    amount = rx(value, shape, 1).try_cast("long")
    return amount * F.when(F.regexp_extract(value, shape, 2) == "tb", 1024).otherwise(1)


def storage_in_title(folded: Column) -> Column:
    """Largest disk-sized capacity in a folded title, as 512gb or 2tb."""
    sizes = F.transform(
        rx_all(folded, r"\b\d{1,6}\s*(?:gb|tb)\b"), lambda m: F.regexp_replace(m, r"\s+", "")
    )
    disks = F.filter(sizes, lambda m: m.endswith("tb") | (capacity_gb(m) >= catalog.STORAGE_LIKE_MIN_GB))
    return let(
        disks,
        lambda found: let(
            F.array_max(F.transform(found, lambda m: capacity_gb(m))),
            lambda most: F.get(F.filter(found, lambda m: capacity_gb(m) == most), F.lit(0)),
        ),
    )


def variant_attribute(key: Column, value: Column) -> Column:
    """Gate attribute a specification label stands for; NULL when it is none.

    A "size" that is a disk capacity is storage.
    """
    label = F.regexp_replace(fold_key(key), " ", "_")
    mapped = F.coalesce(lookup(catalog.VARIANT_KEY_ALIASES, label), label)
    disk = capacity_gb(sized_value(squash(fold_key(value)))) >= catalog.STORAGE_LIKE_MIN_GB
    promoted = F.when((mapped == "size") & F.coalesce(disk, F.lit(False)), "storage").otherwise(mapped)
    return F.when(among(promoted, catalog.VARIANT_KEYS), promoted)


def variant_entries(source: Column) -> Column:
    """Entries of a map as gate attributes with comparable values, in order.

    A bare count such as "4" is no RAM size. Colours keep their words here and
    are only canonicalised when compared.
    """
    def valued(key, text, folded):
        bare_count = (key == "ram") & F.regexp_replace(folded, r"\s+", "").rlike(r"^\d{1,2}$")
        usable = (text != "") & (F.lower(text) != "none") & ~F.coalesce(bare_count, F.lit(False))
        value = F.when(key.isin("storage", "capacity", "ram", "size"), sized_value(folded)).when(
            key == "network_lock", F.coalesce(lookup(catalog.LOCK_WORDS, folded), folded)
        ).otherwise(folded)
        return F.struct(F.when(usable, key).alias("key"), value.alias("value"))

    def one(entry):
        return let(
            variant_attribute(entry["key"], entry["value"]),
            lambda key: let(squash(fold_key(entry["value"])), lambda folded: valued(key, F.trim(entry["value"]), folded)),
        )

    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.transform(F.coalesce(F.map_entries(source), empty), one)
    return F.filter(entries, lambda e: e["key"].isNotNull() & (e["value"] != ""))


def variant_pairs(variant: Column) -> Column:
    """``color: Blue; storage: 128 GB`` as a map, first value per key; NULL without a colon."""
    parts = F.filter(F.split(variant, ";"), lambda p: p.contains(":"))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.substring_index(p, ":", 1)).alias("key"),
            F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("value"),
        ),
    )
    return F.when(variant.contains(":"), let(pairs, first_writer))


def first_writer(entries: Column) -> Column:
    """Map of entries where the first value of a key stays."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def map_key(attributes: Column) -> Column:
    """``k=v|k=v`` in key order; NULL for an empty map."""
    pairs = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.nullif(F.array_join(pairs, "|"), F.lit(""))


def variant_key_list(product_variant: Column, variant_key: Column, edition: Column) -> Column:
    """Comparable variant keys of a product: its edition, variant and ``edition=`` part."""
    from_key = rx(variant_key, r"(?:^|\|)edition=([^|]*)", 1)
    keys = F.transform(
        F.filter(F.array(edition, product_variant, from_key), lambda v: v.isNotNull()),
        lambda v: models.variant_key(fold_key(v)),
    )
    return F.array_distinct(F.array_compact(keys))


# --- condition, lock, roles -------------------------------------------------------------------

REFURBISHED = r"\b(?:refurbished|reconditioned|recondicionad[oa]|reacondicionad[oa])\b"
OPEN_BOX = "open box|open-box|caixa aberta|caja abierta"


def _from_metadata(raw: Column) -> Column:
    def read(text):
        return (
            F.when(text.rlike("renewed|renovado"), "renewed")
            .when(text.rlike("refurbished|reconditioned|recondicionado|reacondicionado"), "refurbished")
            .when(text.contains("open") & text.contains("box"), "open_box")
            .when(text.rlike("used|usado|seminovo|cpo"), "used")
            .when(text.rlike("new|novo|nueva|nuevo"), "new")
        )

    return let(fold_key(raw), read)


def _from_title(folded: Column) -> Column:
    return (
        F.when(folded.rlike(r"\brenewed\b|\brenovad[oa]\b"), "renewed")
        .when(folded.rlike(REFURBISHED), "refurbished")
        .when(folded.rlike(OPEN_BOX), "open_box")
        .when(folded.rlike(r"\b(?:used|usad[oa]s?|seminov[oa]|cpo)\b"), "used")
        .when(folded.rlike(r"\b(?:new|novo|nova|nuevo|nueva)\b"), "new")
    )


def condition(title: Column, metadata: Column | None = None) -> Column:
    """Commercial condition and grade, from metadata first, then from the title.

    Title, metadata and each step are bound, so that the plan does not grow with how often rules mention them.
    """
    none = F.lit(None).cast("string")

    def graded(folded, raw, given, grade_given):
        premium = F.when(folded.rlike(r"\b(?:renewed|renovado)\s+premium\b"), "premium")
        noted = F.coalesce(grade_given, F.when((given == "renewed") & fold_key(raw).contains("premium"), "premium"))
        return let(
            F.coalesce(given, _from_title(folded), F.lit("unknown")),
            lambda code: F.struct(code.alias("code"), F.when(given.isNotNull(), noted).otherwise(F.when(code == "renewed", premium)).alias("grade")),
        )

    def read(folded, m):
        get = lambda k: F.nullif(F.trim(F.try_element_at(m, F.lit(k))), F.lit(""))
        grade = F.regexp_replace(fold_key(get("condition_grade")), " ", "_")
        raw = F.coalesce(get("condition"), get("item_condition"), get("offer_condition"))
        return let(raw, lambda r: let(_from_metadata(r), lambda given: graded(folded, r, given, grade)))

    if metadata is None:
        return let(fold_key(title), lambda folded: graded(folded, none, none, none))
    return let(fold_key(title), lambda folded: let(metadata, lambda m: read(folded, m)))


def blocks_against_new(code: Column) -> Column:
    return code.isin("used", "open_box")


def condition_conflict(reference: Column, candidate: Column) -> Column:
    """Used or opened goods against a reference that is new or silent; else NULL."""
    return F.when(
        blocks_against_new(candidate) & reference.isin("new", "unknown"),
        F.concat(F.lit("condition_mismatch:new!="), candidate),
    )


def strip_condition(normalized: Column) -> Column:
    words = F.filter(
        F.split(normalized, r"\s+"), lambda w: ~among(w, [*catalog.CONDITION_WORDS, "premium", "excellent"])
    )
    return F.array_join(words, " ")


CARRIER = r"\b(verizon|at\s*&\s*t|att|t[\s-]?mobile|tmobile)\b"


def carrier(folded: Column) -> Column:
    word = F.regexp_replace(rx(folded, CARRIER, 1), r"\s", "")
    return F.when(word.isin("att", "at&t"), "at&t").when(word.isin("tmobile", "t-mobile"), "t-mobile").otherwise(word)


def network_lock(folded: Column) -> Column:
    return (
        F.when(folded.rlike(r"\b(?:fully\s+)?unlocked\b|\b(?:desbloquead[oa]|liberad[oa])\b"), "unlocked")
        .when(folded.rlike(r"\b(?:locked|bloquead[oa])\b"), "locked")
        .when(folded.rlike(CARRIER), "locked")
    )


def has_accessory_word(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, literal_list(catalog.ACCESSORY_WORDS))


def has_bundle_marker(folded: Column) -> Column:
    return has_any(folded, catalog.BUNDLE_MARKERS)


def is_system(folded: Column) -> Column:
    """A computer that has a graphics chip inside, not a card on its own."""
    cpu = folded.rlike(r"\b(intel\s+core|core\s*i[3579]|ryzen\s*[3579]|i[3579]-\d{4,})\b")
    memory = folded.rlike(r"\b\d+\s*gb\s*(ddr[45]|ram)\b") | folded.rlike(r"\bssd\b")
    display = folded.rlike(r"\b\d{2}\s*(inch|hz|wuxga|fhd|qhd)\b") | folded.contains("gaming a")
    return F.coalesce(has_any(folded, catalog.SYSTEM_WORDS) | (cpu & memory & display), F.lit(False))


def is_graphics_card(folded: Column) -> Column:
    named = (
        (folded.contains("placa") & folded.contains("video"))
        | folded.contains("tarjeta de video")
        | folded.contains("graphics card")
        | folded.contains("placa grafica")
    )
    chip = models.gpu_chip(folded).isNotNull() & has_any(folded, catalog.CARD_MARKERS)
    return F.coalesce(~is_system(folded) & (named | chip), F.lit(False))


# --- links ------------------------------------------------------------------------------------


def title_from_url(url: Column) -> Column:
    """A readable title from the URL path: the part before ``/p/``, else a long last part."""
    path = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path), "/"), lambda p: p != "")
    at = F.array_position(parts, "p")
    before = F.when(at > 1, F.try_element_at(parts, (at - 1).cast("int")))
    leaf = F.try_element_at(parts, F.lit(-1))
    number = F.regexp_replace(leaf, r"\.html?$", "").rlike(r"^\d{9,}$")
    last = F.when(~number & ~F.lower(leaf).isin("dp", "gp", "product") & (F.length(leaf) > 8), leaf)
    return F.nullif(squash(F.translate(F.coalesce(before, last), "-_", "  ")), F.lit(""))


def candidate_text(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), title_from_url(url), F.lit(""))

