"""Identifiers: barcodes, brands, models and manufacturer part numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import catalog
from .patterns import among, compact, let, lookup, rx_all
from .text import fold_key


def gtin(raw: Column) -> Column:
    """EAN/UPC/GTIN with a right check digit, as digits; 12 digits gain a leading zero.

    Padded to 14 digits, the weights 3,1,3,1,... apply from the left, so that the
    weighted sum with the check digit is a multiple of ten.
    """
    def checked(digits):
        size = F.length(digits)
        padded = F.lpad(digits, 14, "0")
        total = None
        for i in range(14):
            part = F.substring(padded, i + 1, 1).cast("int") * (3 if i % 2 == 0 else 1)
            total = part if total is None else total + part
        full = F.when(size == 12, F.concat(F.lit("0"), digits)).otherwise(digits)
        return F.when(size.isin(8, 12, 13, 14), F.when(total % 10 == 0, full))

    return let(F.regexp_replace(raw, r"[^0-9]", ""), checked)


def brand(raw: Column) -> Column:
    """Folded brand words; store placeholders count as no brand."""
    words = F.trim(F.regexp_replace(fold_key(raw), "[^a-z0-9]+", " "))
    return F.when((words != "") & ~among(words, catalog.PLACEHOLDER_BRANDS), words)


def brand_alias(raw: Column) -> Column:
    """The customary spelling of a manufacturer's legal name."""
    known = lookup(catalog.BRAND_ALIASES, fold_key(raw))
    return F.coalesce(known, F.trim(raw))


def model(raw: Column) -> Column:
    return compact(fold_key(raw))


def soft_model(key: Column) -> Column:
    """Model without marketing endings, as long as six characters remain."""
    ending = "|".join(catalog.MODEL_NOISE_ENDINGS)
    return F.regexp_replace(key, rf"^(.{{6,}}?)(?:{ending})+$", "$1")


def has_family(key: Column) -> Column:
    return key.rlike("|".join(catalog.MODEL_FAMILIES))


def opaque_model(key: Column) -> Column:
    """A model key that reads like a manufacturer code and not like a product line."""
    mixed = key.rlike("[a-z]") & key.rlike("[0-9]")
    return F.coalesce((F.length(key) >= 8) & ~has_family(key) & mixed, F.lit(False))


def opaque_code(text: Column) -> Column:
    """Manufacturer or store code in free text that must not become a model."""
    def test(key):
        dashed = F.trim(text).rlike(r"(?i)^[A-Z0-9]+(?:-[A-Z0-9]+)+$")
        mixed = key.rlike("[a-z]") & key.rlike("[0-9]") & (F.length(key) >= 8)
        known = key.rlike("|".join(catalog.KNOWN_MODEL_WORDS)) | key.rlike("rx[0-9]{3,4}")
        return F.coalesce(dashed | (mixed & ~known), F.lit(False))

    return let(compact(fold_key(text)), test)


def part_number_matches(folded: Column, compact_codes: bool = True) -> Column:
    """All part-number shaped pieces of folded text, in rule order."""
    patterns = [*catalog.PART_NUMBERS, *([catalog.COMPACT_PART_NUMBER] if compact_codes else [])]
    return F.flatten(F.array(*[rx_all(folded, p) for p in patterns]))


def part_numbers(folded: Column, compact_codes: bool = True) -> Column:
    """Distinct comparable part numbers (letters and digits, at least eight)."""
    keys = F.transform(part_number_matches(folded, compact_codes), lambda m: F.regexp_replace(m, "[^a-z0-9]+", ""))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 8))


def part_number_display(match: Column) -> Column:
    """How a part number is written in searches: upper case, store-style dashes."""
    def shown(key):
        tail = F.right(key, F.lit(2))
        drive = F.concat(
            F.lit("MZ-"),
            F.when(
                tail.isin("am", "eu", "ap"),
                F.concat(F.upper(F.substr(key, F.lit(3), F.length(key) - 4)), F.lit("/"), F.upper(tail)),
            ).otherwise(F.upper(F.substr(key, F.lit(3), F.length(key)))),
        )
        console = F.concat(F.lit("CFI-"), F.upper(F.substr(key, F.lit(4), F.length(key))))
        return (
            F.when(key.startswith("mz") & (F.length(key) >= 10) & ~match.contains("/"), drive)
            .when(key.rlike("^cfi[0-9]{4}[a-z]?$"), console)
            .otherwise(F.upper(F.regexp_replace(match, r"\s", "")))
        )

    return let(F.regexp_replace(match, "[^a-z0-9]+", ""), shown)


def part_number_forms(folded: Column, compact_codes: bool = True) -> Column:
    """Distinct (key, display) of all part numbers, in rule order."""
    found = F.transform(
        part_number_matches(folded, compact_codes),
        lambda m: F.struct(F.regexp_replace(m, "[^a-z0-9]+", "").alias("key"), part_number_display(m).alias("display")),
    )
    return let(
        F.filter(found, lambda f: F.length(f["key"]) >= 8),
        lambda long: let(
            F.transform(long, lambda g: g["key"]),
            lambda keys: F.filter(long, lambda f, i: F.array_position(keys, f["key"]) == i + 1),
        ),
    )


# Brands whose name before a code makes an identifier query.
IDENTIFIER_BRANDS = ("sony", "apple", "samsung", "kingston", "corsair", "msi", "asus", "gigabyte")


def is_identifier_query(query: Column) -> Column:
    """One word of six or more characters, or two words of which the second is a part number."""
    words = F.split(F.trim(query), r"\s+")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    key = compact(fold_key(second))
    code = opaque_model(key) | (F.length(F.regexp_replace(F.lower(second), "[^a-z0-9]", "")) >= 8)
    named = among(F.lower(first), IDENTIFIER_BRANDS) & (F.length(second) >= 6)
    return F.coalesce(
        F.when(F.trim(query) == "", F.lit(False))
        .when(F.size(words) == 1, F.length(first) >= 6)
        .when(F.size(words) == 2, F.coalesce(code, F.lit(False)) | named),
        F.lit(False),
    )
