"""Unit and value normalisers for product attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import let, rx, squash
from .text import fold_key

PLACEHOLDERS = ("null", "none", "n/a", "-")


def plain_number(text: Column) -> Column:
    """1,50 -> 1.5 and 12.0 -> 12, without exponents."""
    point = F.regexp_replace(text, ",", ".")
    trimmed = F.regexp_replace(F.regexp_replace(point, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(trimmed, r"^0+(?=\d)", "")


def _whole(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\..*$", ""), r"^0+(?=\d)", "")


def _unit(text: Column, pattern: str, number=lambda n: n, unit=F.upper) -> Column:
    point = F.regexp_replace(text, ",", ".")
    return F.when(
        point.rlike(pattern),
        F.concat_ws(" ", number(F.regexp_extract(point, pattern, 1)), unit(F.regexp_extract(point, pattern, 2))),
    )


def capacity(text: Column) -> Column:
    """128GB, 1tb -> 128 GB, 1 TB."""
    return _unit(text, r"(?i)(\d+(?:[.,]\d+)?)\s*(tb|gb|mb|kb)\b")


def frequency(text: Column) -> Column:
    pattern = r"(?i)(\d+(?:[.,]\d+)?)\s*(mhz|ghz|hz|mt/?s)\b"
    names = lambda u: F.when(F.lower(u) == "mhz", "MHz").when(F.lower(u) == "ghz", "GHz").when(F.lower(u) == "hz", "Hz").otherwise("MT/s")
    return _unit(text, pattern, _whole, names)


def length(text: Column) -> Column:
    return _unit(text, r"(?i)(\d+(?:[.,]\d+)?)\s*(mm|cm|m)\b", lambda n: F.regexp_replace(n, r"^0+(?=\d+$)", ""), F.lower)


def wattage(text: Column) -> Column:
    return _unit(text, r"(?i)(\d+(?:[.,]\d+)?)\s*(w|va)\b", _whole)


def kit(text: Column) -> Column:
    """2 X 16 GB -> 2x16 GB. A total capacity alone makes no kit."""
    pattern = r"(?i)(\d+)\s*[x×]\s*(\d+)\s*(gb|tb|mb)?"
    unit = F.coalesce(F.nullif(F.upper(F.regexp_extract(text, pattern, 3)), F.lit("")), F.lit("GB"))
    return F.when(
        text.rlike(pattern),
        F.concat(_whole(F.regexp_extract(text, pattern, 1)), F.lit("x"), _whole(F.regexp_extract(text, pattern, 2)), F.lit(" "), unit),
    )


def memory_type(text: Column) -> Column:
    folded = fold_key(text)
    return F.coalesce(
        F.concat(F.lit("DDR"), rx(text, r"(?i)\bddr\s*([345])\b", 1)),
        F.when(folded.startswith("gddr"), F.concat(F.lit("GDDR"), F.regexp_replace(folded, "[^0-9]", ""))),
    )


def pcie(text: Column) -> Column:
    version = rx(text, r"(?i)\bpcie?\s*(?:gen)?\s*([345](?:\.\d)?)\b", 1)
    return F.concat(F.lit("PCIe "), version, F.when(version.contains("."), "").otherwise(".0"))


def efficiency(text: Column) -> Column:
    folded = fold_key(text)
    tier = None
    for name in ("titanium", "platinum", "gold", "silver", "bronze", "white"):
        hit = folded.contains(name)
        tier = F.when(hit, name.title()) if tier is None else tier.when(hit, name.title())
    return F.when(text.rlike(r"(?i)\b80\s*plus\b"), F.concat_ws(" ", F.lit("80 Plus"), tier))


def gpu_name(text: Column) -> Column:
    pattern = r"(?i)\b(rtx|gtx)\s*(\d{3,4})\s*(ti|super)?\b"
    return F.when(
        text.rlike(pattern),
        F.trim(
            F.concat_ws(
                " ", F.upper(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2),
                F.initcap(F.lower(F.regexp_extract(text, pattern, 3))),
            )
        ),
    )


def normalise(key: Column, value: Column) -> Column:
    """Value with the customary unit for its attribute; unknown shapes stay as they are."""
    return let(F.nullif(F.trim(value), F.lit("")), lambda text: let(F.lower(key), lambda k: _normalised(k, text)))


def _normalised(key: Column, text: Column) -> Column:
    inches = rx(text, r"(?i)(\d+(?:[.,]\d+)?)\s*(?:\"|''|in|inch|polegadas?)?", 1)
    metric = text.rlike(r"(?i)\b\d+(?:[.,]\d+)?\s*(?:mm|cm)\b")
    sized = F.when(metric, length(text)).when(
        (key == "screen_size") & inches.isNotNull(), F.concat(F.regexp_replace(inches, ",", "."), F.lit('"'))
    ).otherwise(length(text))
    made = (
        F.when(key.isin("storage", "ram", "vram", "capacity", "total_capacity", "module_capacity"), capacity(text))
        .when(key.isin("frequency", "refresh_rate"), frequency(text))
        .when(key.isin("radiator_size", "fan_size", "cooler_height", "screen_size"), sized)
        .when(key.isin("wattage", "power"), wattage(text))
        .when(key.isin("memory_type", "ddr"), memory_type(text))
        .when(key.isin("pcie_generation", "pcie"), pcie(text))
        .when(key.isin("efficiency", "efficiency_rating"), efficiency(text))
        .when(key.isin("kit_configuration", "module_count"), kit(text))
        .when(key.isin("gpu_model", "gpu"), gpu_name(text))
    )
    return F.coalesce(made, text)


def title_case(token: Column) -> Column:
    """SAMSUNG -> Samsung; codes that mix letters and digits stay."""
    shouting = ~token.rlike("[0-9]") & (F.length(token) > 1) & (token == F.upper(token)) & (token != F.lower(token))
    return F.when(shouting, F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substr(token, F.lit(2))))).otherwise(token)


SCREEN = r"(?i)\b(\d{1,2}(?:[.,]\d)?)\s*(?:\"|''|″|pol\.?|polegadas?|inch(?:es)?|pulgadas?)"
VOLTS = r"(?i)\b(\d{2,3})\s*V(?:olts?)?\b"
MEMORY = r"(?i)(\d+(?:[.,]\d+)?)\s*(GB|TB|MB)\b"


def amount(text: Column, pattern: str = MEMORY) -> Column:
    """First capacity of a text as ``1.5 TB``."""
    return F.when(
        text.rlike(pattern),
        F.concat_ws(" ", plain_number(F.regexp_extract(text, pattern, 1)), F.upper(F.regexp_extract(text, pattern, 2))),
    )


def clean(attribute: Column, raw: Column) -> Column:
    """A raw specification value, cleaned for its attribute; placeholders become NULL."""
    def cleaned(text):
        low = F.lower(text)
        screen = F.concat(plain_number(rx(text, SCREEN, 1)), F.lit('"'))
        return (
            F.when(attribute.isin("storage", "ram", "vram", "capacity", "module_capacity"), F.coalesce(amount(text), text))
            .when(attribute == "voltage", F.coalesce(F.concat(_whole(rx(text, VOLTS, 1)), F.lit(" V")), text))
            .when(attribute == "screen_size", F.when(F.size(F.split(text, r"\s+")) <= 4, screen))
            .when(attribute.isin("color", "brand"), title_case(text))
            .when(
                attribute == "wifi",
                F.when(low.isin("true", "yes", "sim", "1"), "true")
                .when(low.isin("false", "no", "nao", "não", "0"), "false")
                .when(low.contains("wi"), "true")
                .otherwise(text),
            )
            .when(attribute == "overclocked", F.when(low.isin("true", "yes", "oc", "1"), "true").otherwise(text))
            .otherwise(text)
        )

    usable = F.when(~F.lower(F.trim(raw)).isin(*PLACEHOLDERS), raw)
    tidy = F.regexp_replace(squash(usable), r"^[ .]+|[ .]+$", "")
    return F.nullif(let(tidy, cleaned), F.lit(""))
