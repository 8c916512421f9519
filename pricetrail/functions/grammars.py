"""Brand, base model and variant of a title, by category.

Every grammar is a column expression over the title's words. ``run`` reads words
from a start until a stop word, as most titles name the model right after the
brand and then turn to specifications.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import catalog
from . import models
from .identifiers import opaque_code
from .patterns import among, any_of, compact, let, rx, rx_all
from .text import fold_key
from .titles import search_words

Test = Callable[[Column], Column]
GRAMMAR_SCHEMA = "struct<brand:string,model:string,model_key:string,variant:string,variant_key:string,confidence:string,product_line:string>"


def display(word: Column) -> Column:
    """A word as shown: codes stay, short shouting stays, long shouting is calmed."""

    def shown(token):
        low = F.lower(token)
        shouting = (token == F.upper(token)) & token.rlike("[A-Za-z]")
        capital = F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substr(token, F.lit(2))))
        return (
            F.when(low.rlike(r"^\d+x$"), F.upper(token))
            .when(token.rlike("[0-9]"), token)
            .when(shouting & (F.length(token) <= 3), token)
            .when(shouting, capital)
            .when(low.isin("oc", "sff", "rgb", "aio", "tuf", "rog"), F.upper(token))
            .otherwise(F.concat(F.upper(F.substring(token, 1, 1)), F.substr(token, F.lit(2))))
        )

    return let(word, shown)


def never(_: Column) -> Column:
    return F.lit(False)


def run(tokens: Column, stop: Test, skip: Test = never, soft_stop: Test = never, most: int = 5) -> Column:
    """Words up to the first ``stop`` word or ``most`` words; ``skip`` words are left out.

    A ``soft_stop`` word ends the run once there is a word, and is left out before.
    """
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(False).alias("over"))

    def step(acc, token):
        words = acc["words"]
        some = F.size(words) > 0
        full = F.size(words) >= most
        ends = stop(token) | (soft_stop(token) & some)
        leave = skip(token) | soft_stop(token)
        grown = F.when(acc["over"] | full | ends | leave, words).otherwise(F.concat(words, F.array(display(token))))
        # a skipped word never stops the run, even if it also looks like a stop
        over = acc["over"] | full | (ends & ~skip(token))
        return F.struct(grown.alias("words"), over.alias("over"))

    kept = F.aggregate(tokens, start, step, lambda acc: acc["words"])
    return kept


def nothing() -> Column:
    return F.array().cast("array<string>")


def from_place(tokens: Column, place: Column) -> Column:
    """Tokens from a 1-based place on; empty when the place is 0 or past the end."""
    return F.when((place > 0) & (place <= F.size(tokens)), F.slice(tokens, place, F.size(tokens))).otherwise(nothing())


def drop_leading(tokens: Column, words: list[str], fold: bool = False) -> Column:
    """Tokens after the leading run of the given words."""
    low = fold_key if fold else F.lower
    first = F.array_position(F.transform(tokens, lambda t: ~among(low(t), words)), F.lit(True)).cast("int")
    return let(first, lambda at: from_place(tokens, at))


def rest(tokens: Column) -> Column:
    return from_place(tokens, F.lit(2))


def head(tokens: Column) -> Column:
    return F.get(tokens, F.lit(0))


def joined(words: Column) -> Column:
    return F.nullif(F.array_join(words, " "), F.lit(""))


def parsed(
    brand: Column | None = None, model: Column | None = None, variant: Column | None = None,
    confidence: Column | str = "contextual", line: Column | None = None, key: Column | None = None,
    variant_key: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence

    def made(name, refined):
        return F.struct(
            (none if brand is None else brand).cast("string").alias("brand"),
            name.alias("model"),
            (compact(fold_key(name)) if key is None else key).cast("string").alias("model_key"),
            refined.alias("variant"),
            (models.variant_key(fold_key(refined)) if variant_key is None else variant_key).cast("string").alias("variant_key"),
            F.when(name.isNull(), "ambiguous").otherwise(sure).alias("confidence"),
            (none if line is None else line).cast("string").alias("product_line"),
        )

    name = none if model is None else model.cast("string")
    refined = none if variant is None else variant.cast("string")
    return let(name, lambda n: let(refined, lambda v: made(n, v)))


# --- graphics cards ---------------------------------------------------------------------------


def _gpu_noise(token: Column) -> Column:
    def test(low):
        tight = F.regexp_replace(low, " ", "")
        return (
            among(low, catalog.GPU_NOISE)
            | tight.rlike(r"^\d+(?:[.,]\d+)?(?:gb|tb|mb|g)$")
            | tight.rlike(r"^\d{3,5}(?:mhz|mt/?s)?$")
            | opaque_code(token)
        )

    return let(F.lower(token), test)


def gpu_variant(title: Column, folded: Column, words: Column, brand: Column) -> Column:
    """Words of a card's title that name its line (Dual OC, Shadow 3X), joined; NULL without any."""
    nvidia = rx(folded, r"\b(?:nvidia\s+)?(?:geforce\s+)?(?:rtx|gtx)\s*\d{3,4}\s*(?:ti|super)?")
    radeon = rx(folded, r"\b(?:amd\s+)?(?:radeon\s+)?rx\s*\d{3,4}\s*(?:xtx|xt)?")
    chip = F.split(
        F.lower(F.concat_ws(" ", models.gpu_chip_display(folded), models.gpu_chip(folded), F.coalesce(nvidia, radeon))), r"\s+"
    )

    def variant_words(chip_words, own):
        def keep(token):
            def test(low, plain, key):
                mine = F.coalesce((plain == own) | (key == own), F.lit(False))
                of_chip = F.array_contains(chip_words, plain) | F.array_contains(chip_words, key)
                unit = low.contains("bit") | low.rlike("(mhz|gbps)$") | low.rlike(r"^\d+$")
                noise = (_gpu_noise(token) & ~low.rlike(r"^\d+x$")) | key.rlike(r"^\d+(?:[.,]\d+)?(?:gb|tb|mb|g)$")
                shaped = token.rlike(r"^[A-Za-z0-9][A-Za-z0-9.+/-]{0,30}$") & ~opaque_code(token)
                return ~mine & ~of_chip & ~low.isin("ti", "super", "xt", "xtx") & ~unit & ~noise & shaped

            return let(
                fold_key(token), lambda plain: test(F.lower(token), plain, F.regexp_replace(plain, "[^a-z0-9]+", ""))
            )

        return F.filter(words, keep)

    def shown(kept):
        telling = F.exists(kept, lambda t: ~among(F.lower(t), catalog.VARIANT_MODIFIERS) & ~F.lower(t).rlike(r"^\d+x$"))
        return F.when(telling, joined(F.transform(kept, display)))

    return let(chip, lambda c: let(fold_key(brand), lambda own: let(variant_words(c, own), shown)))


def gpu_brand(title: Column, folded: Column, words: Column) -> Column:
    """The board maker: a known one before the chip, else any, else the last telling word before the chip."""
    ahead = search_words(F.regexp_extract(title, rf"(?i)^(.*?)(?:{models.NVIDIA}|{models.RADEON})", 1))
    maker = lambda t: among(fold_key(t), catalog.BOARD_BRANDS) & ~among(fold_key(t), catalog.CHIP_VENDORS)
    telling = lambda t: (
        ~_gpu_noise(t) & ~among(F.lower(t), [*catalog.GPU_LINES, *catalog.CHIP_VENDORS])
        & ~F.lower(t).rlike(r"^\d+x$") & t.rlike(r"^[A-Za-z][A-Za-z0-9.&-]{1,30}$")
    )
    founders = F.when(
        folded.contains("founders"),
        F.when(folded.rlike("nvidia|geforce"), "NVIDIA").when(folded.contains("radeon"), "AMD"),
    )
    return let(
        ahead,
        lambda a: F.coalesce(
            display(F.try_element_at(F.filter(a, maker), F.lit(-1))),
            display(F.try_element_at(F.filter(words, maker), F.lit(1))),
            display(F.try_element_at(F.filter(a, telling), F.lit(-1))),
            founders,
        ),
    )


# Each grammar reads the title ``t``, its folded form ``f`` and its words ``w``.


def gpu(t: Column, f: Column, w: Column) -> Column:
    def with_parts(brand, variant, chip):
        sure = F.when(variant.isNull(), "exact_title").otherwise("contextual")
        return F.when(chip.isNotNull(), parsed(brand, models.gpu_chip_display(f), variant, sure, key=chip))

    code = ~t.contains(" ") & opaque_code(t)
    read = let(
        gpu_brand(t, f, w),
        lambda b: let(gpu_variant(t, f, w, b), lambda v: let(models.gpu_chip(f), lambda c: with_parts(b, v, c))),
    )
    return F.when(~code & models.gpu_chip(f).isNotNull(), read)


# --- phones, processors, memory, drives -------------------------------------------------------


def phone(t: Column, f: Column, w: Column) -> Column:
    first = head(w)
    brand = (
        F.when(f.rlike("iphone|apple"), "Apple")
        .when(f.rlike("galaxy|samsung"), "Samsung")
        .when(first.rlike(r"^[A-Za-z][A-Za-z0-9.&-]{1,30}$"), display(first))
    )

    def with_key(key):
        shown = F.when(
            key.startswith("iphone"), F.concat(F.lit("iPhone "), F.initcap(F.substr(models.spaced_phone(key), F.lit(8))))
        ).otherwise(F.initcap(models.spaced_phone(key)))
        return F.when(key.isNotNull(), parsed(brand, F.regexp_replace(shown, r"(\d)E\b", "$1e"), confidence="exact_title", key=key))

    return let(models.title_phone(f), with_key)


def cpu(t: Column, f: Column, w: Column) -> Column:
    ryzen = r"(?i)\bryzen\s+([3579])\s+(\d{4}[A-Za-z0-9]{0,4})\b"
    core = r"(?i)\bcore\s+(i[3579])-?(\d{4,5}[A-Za-z]{0,3})\b"
    shown = F.when(t.rlike(ryzen), F.concat_ws(" ", F.lit("Ryzen"), rx(t, ryzen, 1), rx(t, ryzen, 2))).otherwise(
        F.concat(F.lit("Core "), rx(t, core, 1), F.lit("-"), rx(t, core, 2))
    )
    return let(
        models.title_cpu(f),
        lambda key: F.when(
            key.isNotNull(),
            parsed(F.when(key.startswith("ryzen"), "AMD").otherwise("Intel"), shown, confidence="exact_title", key=key),
        ),
    )


def ram(t: Column, f: Column, w: Column) -> Column:
    at = F.array_position(F.transform(w, lambda x: F.lower(x).rlike(r"^ddr[345]$|^sodimm$|^dimm$")), F.lit(True)).cast("int")
    ahead = let(at, lambda n: F.when(n > 1, F.slice(w, F.lit(1), n - 1)).otherwise(nothing()))

    def with_lead(lead):
        line = F.filter(rest(lead), lambda x: ~F.lower(x).rlike(r"^\d+(?:[.,]\d+)?(?:gb|tb|mb|g)$"))
        return F.when(
            F.size(lead) > 0, parsed(display(head(lead)), joined(F.transform(line, display)), confidence="exact_title")
        )

    return let(ahead, lambda a: let(drop_leading(a, ["memoria", "memória", "memory", "kit", "ram"]), with_lead))


def ssd(t: Column, f: Column, w: Column) -> Column:
    line = F.regexp_replace(F.initcap(F.regexp_replace(rx(f, models.SSD_LINE, 2), r"\s+", " ")), "Evo", "EVO")
    shown = F.concat_ws(" ", rx(f, models.SSD_LINE, 1), line)
    named = F.filter(
        w, lambda x: ~F.lower(x).isin("ssd", "nvme", "hdd", "disco") & x.rlike(r"^[A-Za-z][A-Za-z0-9.&-]{1,30}$")
    )
    key = models.ssd_line(f)
    return F.when(key.isNotNull(), parsed(display(head(named)), shown, confidence="exact_title", key=key))


# --- the other grammars -----------------------------------------------------------------------

BOARD_LEAD = ["placa", "mae", "placa-mae", "motherboard", "board"]
BOARD_STOP = (
    "placa mae motherboard board ddr4 ddr5 am4 am5 socket soquete chipset amd intel matx m-atx micro-atx microatx atx e-atx "
    "mini-itx itx form factor formato"
).split()
CHIPSET = r"\b([ABZXH]\d{3}(?:E|M)?|[BbZzXx]\d{3}(?:[Ee]|[Mm])?-?(?:Plus|Pro|I|F)?)\b"
BOARD_SOCKET = r"(?i)\b(AM[45]|LGA\s?\d{3,4}|sTR[Xx5]\d*)\b"


def motherboard(t: Column, f: Column, w: Column) -> Column:
    spec = lambda x: (
        among(fold_key(x), BOARD_STOP) | x.rlike(r"(?i)^(AM[45]|LGA\d{3,4}|sTR[Xx5]\d*)$") | F.lower(x).isin("wifi", "wi-fi")
    )

    def with_words(words):
        def with_parts(parts):
            chip = F.upper(rx(t, CHIPSET, 1))

            def named(base):
                full = F.when(
                    chip.isNotNull() & ~F.coalesce(fold_key(base).contains(fold_key(chip)), F.lit(False)), F.concat_ws(" ", base, chip)
                ).otherwise(base)
                full = F.trim(F.regexp_replace(full, r"(?i)\s+wi-?fi\b", ""))
                return F.nullif(F.trim(F.regexp_replace(full, r"(?i)\s+(socket|chipset|ddr[45]|m-?atx|atx|amd|intel)\b.*$", "")), F.lit(""))

            lines = F.filter(F.slice(parts, 1, 2), lambda x: F.upper(x).isin("TUF", "ROG", "MAG", "MPG", "PRO", "AORUS", "STRIX"))
            line = F.when(F.length(head(lines)) <= 4, F.upper(head(lines))).otherwise(head(lines))
            wifi = t.rlike(r"(?i)\bwi-?fi\b")
            return parsed(
                display(head(words)), let(joined(parts), named), F.when(wifi, "WiFi"), line=line, variant_key=F.when(wifi, "wifi")
            )

        return F.when(F.size(words) > 0, let(run(rest(words), never, soft_stop=spec, most=6), with_parts))

    known = t.rlike(CHIPSET) | t.rlike(BOARD_SOCKET)
    return F.when(known, let(drop_leading(w, BOARD_LEAD, fold=True), with_words))


def notebook(t: Column, f: Column, w: Column) -> Column:
    low = F.lower
    stop = lambda x: low(x).rlike(r"^(i[3579]|ryzen|rtx|gtx|core)|^\d+(gb|tb)$") | x.rlike(r"^\d+(?:\.\d+)?[\"']?$")
    skip = lambda x: low(x).isin("notebook", "laptop", "ultrabook", "com", "de", "e", "the", "pc")
    return parsed(display(head(w)), joined(run(rest(w), stop, skip)))


def tablet(t: Column, f: Column, w: Column) -> Column:
    ipad = r"\bipad\s*(air|pro|mini)?\s*(\d{1,2}(?:\.\d)?)?"
    shown = F.concat_ws(" ", F.lit("iPad"), F.initcap(rx(f, ipad, 1)), rx(f, ipad, 2))
    link = F.when(f.rlike("cellular|lte"), "Wi-Fi + Cellular").when(f.rlike("wi-?fi"), "Wi-Fi")
    stop = lambda x: F.lower(x).rlike(r"^\d+(gb|tb)$")
    skip = lambda x: F.lower(x).isin("tablet", "tab")
    other = parsed(display(head(w)), joined(run(rest(w), stop, skip, most=4)))
    return F.when(f.contains("ipad"), parsed(F.lit("Apple"), shown, link, "exact_title")).otherwise(other)


def console(t: Column, f: Column, w: Column) -> Column:
    ps = F.coalesce(rx(f, r"\bplaystation\s*(\d)", 1), rx(f, r"\bps(\d)", 1))
    xbox = rx(f, r"\bxbox\s*series\s*([xs])\b", 1)
    switch = f.rlike(r"\bnintendo\s*switch")
    pro = f.contains("pro") & F.regexp_replace(f, " ", "").rlike(r"ps\d")
    ps_name = F.concat_ws(" ", F.lit("PlayStation"), ps, F.when(pro, "Pro").when(f.contains("slim"), "Slim"))
    shown = F.when(ps.isNotNull(), ps_name).when(xbox.isNotNull(), F.concat(F.lit("Xbox Series "), F.upper(xbox))).when(
        switch, F.concat_ws(" ", F.lit("Nintendo Switch"), F.upper(rx(f, r"\bnintendo\s*switch\s*(oled|lite)", 1)))
    )
    brand = F.when(ps.isNotNull(), "Sony").when(xbox.isNotNull(), "Microsoft").when(switch, "Nintendo")
    variant = F.when(f.rlike(r"\bdigital\b"), "Digital").when(f.rlike(r"\bdisc\b|\bedicao\s+fisica\b|\bblu-?ray\b"), "Disc")
    return F.when(ps.isNotNull() | xbox.isNotNull() | switch, parsed(brand, shown, variant, "exact_title"))


def psu(t: Column, f: Column, w: Column) -> Column:
    watt = rx(t, r"(?i)\b(\d{3,4})\s*w\b", 1)
    stop = lambda x: (
        F.lower(x).rlike(r"^\d{3,4}w?$") | x.contains("80") | F.lower(x).isin("plus", "gold", "platinum", "bronze", "full", "modular")
    )
    skip = lambda x: F.lower(x).isin("fonte", "psu", "atx")
    name = F.coalesce(joined(run(rest(w), stop, skip, most=4)), F.concat(watt, F.lit("W")))
    return F.when(watt.isNotNull() | f.rlike("fonte|psu"), parsed(display(head(w)), name))


COOLER_LEADS = (
    "liquid cpu cooler", "cpu liquid cooler", "water cooler", "air cooler", "liquid cooler", "cooler liquid", "cooler liquido",
    "cpu cooler", "cooler de agua", "refrigeracion liquida", "aio", "watercooler", "water cooling", "liquid cooling",
)
COOLER_NOISE = (
    "water cooler aio liquid liquido air cpu cooling refrigeracion liquida de agua rgb argb black white preto branco negro "
    "blanco intel amd"
).split()


def cooler(t: Column, f: Column, w: Column) -> Column:
    text = F.concat(fold_key(F.array_join(w, " ")), F.lit(" "))
    master = text.startswith("cooler master ")
    upper = lambda x: (x == F.upper(x)) & x.rlike("[A-Za-z]")
    size = lambda x: F.lower(x).rlike(r"^(?:120|240|280|360|420)(?:mm)?$|^\d{3}mm$")
    noise = lambda x: among(fold_key(x), COOLER_NOISE)

    def with_words(words, is_master):
        first, second = head(words), F.get(words, F.lit(1))
        # a short upper-case word before a title-case one is a product line, not a maker
        line_first = F.coalesce(
            ~is_master & (F.length(first) <= 3) & upper(first) & second.isNotNull() & ~upper(second) & ~second.rlike("[0-9]"), F.lit(False)
        )

        def with_size(n):
            brand = F.when(n > 0, joined(F.transform(F.slice(words, F.lit(1), n), display)))
            return parsed(brand, joined(run(from_place(words, n + 1), never, skip=noise, soft_stop=size)))

        brand_words = F.when(line_first, 0).when(is_master, 2).otherwise(1)
        return F.when(F.size(words) > 0, let(brand_words, with_size))

    def with_lead(lead, is_master):
        skipped = F.when(is_master | lead.isNull(), 0).otherwise(F.size(F.split(F.trim(lead), " ")))
        return let(from_place(w, skipped + 1), lambda words: with_words(words, is_master))

    return let(rx(text, rf"^{any_of(COOLER_LEADS)} "), lambda lead: let(master, lambda m: with_lead(lead, m)))


def monitor_codes(title: Column) -> Column:
    """Model codes in a monitor title: letters and digits, no units, sizes or ports."""
    def code(text):
        return let(
            F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", "")),
            lambda key: (F.length(key) >= 5) & key.rlike("[a-z]") & key.rlike("[0-9]")
            & ~key.isin("displayport", "hdmi", "usb") & ~key.rlike("^(hdr|hdmi|displayport|usb|bt)")
            & ~key.rlike("(hz|khz|mhz|ghz|ms|mm|cm|in|bit|bpc)$") & ~key.rlike(r"^\d{3,4}x\d{3,4}$") & ~F.lower(text).rlike("^dci-?p3$"),
        )

    return F.filter(rx_all(title, r"(?i)\b[A-Z0-9]+(?:-[A-Z0-9]+)*\b"), code)


def monitor(t: Column, f: Column, w: Column) -> Column:
    key_of = lambda x: F.regexp_replace(fold_key(x), "[^a-z0-9]", "")
    low = F.lower
    skip = lambda x: low(x).isin("monitor", "gaming")

    def with_codes(codes, words):
        keys = F.transform(codes, key_of)
        longest = F.array_max(F.transform(codes, lambda c: F.length(c)))
        code = F.upper(head(F.filter(codes, lambda c: F.length(c) == longest)))

        def with_keys(known):
            stop = lambda x: (
                F.array_contains(known, key_of(x)) | low(x).rlike(r"\d+\s*(hz|\"|polegada)") | x.rlike(r"^\d+(?:\.\d+)?\"?$")
            )
            line = F.regexp_replace(joined(run(rest(words), stop, skip, most=4)), "(?i)ultragear", "UltraGear")
            sure = F.when(F.size(codes) > 0, "exact_title").otherwise("contextual")
            return let(line, lambda x: parsed(display(head(words)), F.coalesce(code, x), confidence=sure, line=x))

        return F.when(F.size(words) > 0, let(keys, with_keys))

    lead = ["monitor", "gamer", "gaming"]
    return let(monitor_codes(t), lambda c: let(drop_leading(w, lead), lambda words: with_codes(c, words)))


GEAR_LEAD = (
    "carregador charger cabo cable teclado mouse headset headphone fone controle gamepad gabinete case fan ventoinha suporte "
    "mesa cadeira hub dock adaptador roteador router"
).split()
GEAR_STOP = (
    "rgb argb wireless wired bluetooth usb abnt2 switch red brown blue black white teclado mouse headset headphone controle "
    "gamepad fan cooler gabinete case pwm gan pd"
).split()


def gear(t: Column, f: Column, w: Column) -> Column:
    """Peripherals, network gear and the rest: brand and a short model line."""
    stop = lambda x: F.lower(x).rlike(r"^\d+(mm|w)$")
    soft = lambda x: among(F.lower(x), GEAR_STOP)

    def with_words(words):
        usable = (F.size(words) >= 2) & ~F.lower(head(words)).isin("gan", "usb", "usb-c", "type-c")
        return F.when(usable, parsed(display(head(words)), joined(run(rest(words), stop, soft_stop=soft))))

    return let(drop_leading(w, GEAR_LEAD), with_words)


def tv(t: Column, f: Column, w: Column) -> Column:
    series = rx(t, r"\b([A-Z]{1,3}\d{2}[A-Z0-9]{0,4})\b", 1)
    return F.when(F.length(series) >= 3, parsed(display(head(w)), series, confidence="exact_title")).otherwise(gear(t, f, w))


GRAMMARS: dict[str, Callable[[Column], Column]] = {
    "gpu": gpu, "smartphone": phone, "cpu": cpu, "ram": ram, "ssd": ssd, "motherboard": motherboard, "notebook": notebook,
    "tablet": tablet, "console": console, "psu": psu, "cooler": cooler, "monitor": monitor, "tv": tv,
}
GENERIC = [c for c, _, _ in catalog.CATEGORIES if c not in GRAMMARS]


def parse(title: Column, category: Column) -> Column:
    """Brand, base model, variant and confidence of a title in its category."""
    def read(t, f, w):
        chain = None
        for name, grammar in GRAMMARS.items():
            hit = category == name
            chain = F.when(hit, grammar(t, f, w)) if chain is None else chain.when(hit, grammar(t, f, w))
        return F.coalesce(chain.when(among(category, GENERIC), gear(t, f, w)), parsed())

    text = F.nullif(F.trim(title), F.lit(""))
    return let(text, lambda t: let(fold_key(t), lambda f: let(search_words(t), lambda w: read(t, f, w))))


def parse_as(title: Column, category: str) -> Column:
    """``parse`` for one known category."""
    grammar = GRAMMARS.get(category, gear)
    text = F.nullif(F.trim(title), F.lit(""))
    made = let(text, lambda t: let(fold_key(t), lambda f: let(search_words(t), lambda w: grammar(t, f, w))))
    return F.coalesce(made, parsed())


# --- base models ------------------------------------------------------------------------------


def is_base_model(category: Column, value: Column) -> Column:
    """A structured model that already is what people search for."""
    def test(text, folded):
        code = opaque_code(text)
        chip = models.gpu_chip(folded).isNotNull()
        plain_card = gpu_variant(text, folded, search_words(text), F.lit(None).cast("string")).isNull()
        of = lambda name: F.coalesce(category, F.lit(name)) == name
        return (
            F.when(category == "console", folded.rlike("playstation|ps5|ps4|xbox|switch|cfi") | (~code & (F.length(text) >= 3)))
            .when(category == "psu", folded.rlike(r"\b[a-z]{1,5}\d{3,5}[a-z0-9]*\b"))
            .when(code, F.lit(False))
            .when((category == "gpu") | chip, chip & plain_card)
            .when(of("smartphone") & models.title_phone(folded).isNotNull(), F.lit(True))
            .when(of("cpu") & models.title_cpu(folded).isNotNull(), F.lit(True))
            .when(of("ssd") & models.ssd_line(folded).isNotNull(), F.lit(True))
            .when(category == "ram", ~F.regexp_replace(folded, " ", "").rlike(r"^\d+(?:[.,]\d+)?(?:gb|tb|mb|g)$"))
            .when(category.isin("motherboard", "notebook", "monitor", "cooler"), F.length(text) >= 3)
            .otherwise(F.lit(False))
        )

    answer = let(F.nullif(F.trim(value), F.lit("")), lambda t: let(fold_key(t), lambda f: test(t, f)))
    return F.coalesce(answer, F.lit(False))


def base_model_display(category: Column, value: Column, own: Column) -> Column:
    """Canonical spelling of a base model; ``own`` is ``parse(value, category)``."""
    return F.when(category == "console", F.trim(value)).otherwise(
        F.coalesce(own["model"], F.when(category == "gpu", models.gpu_chip_display(fold_key(value))), F.trim(value))
    )
