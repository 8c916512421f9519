"""Product matching: candidate pairs, the decision rules, best picks and semantic support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers, titles
from ..functions.money import price_extreme
from ..functions.vectors import cosine
from ..rules import catalog
from ..schema import CONFIDENCE, REASON, SCORE
from ..session import staged
from .identity import IDENTITY_COLUMNS, OFFER_COLUMNS, describe

# Decision thresholds and weights.
AUTO, REVIEW = "0.92", "0.75"
TITLE_WEIGHT, TITLE_CAP = "0.35", "0.74"
BRAND_POINTS, MODEL_POINTS, MONITOR_POINTS = "0.25", "0.45", "0.11"
SOFT_TITLE_MIN = 0.75
GATES = ("color", "storage", "size", "capacity", "ram", "pack", "network_lock", "vram", "edition", "memory_type",
         "screen_size", "resolution", "refresh_rate", "panel")
MONITOR_KEYS = ("screen_size", "resolution", "refresh_rate", "panel")


def number(text: str) -> Column:
    return F.lit(text).cast(CONFIDENCE)


def _at(side: Column, key: str, field: str = "variant_attrs") -> Column:
    return F.try_element_at(side[field], F.lit(key))


def _differs(a: Column, b: Column) -> Column:
    """Both known and unequal: a missing value is never a conflict."""
    return a.isNotNull() & b.isNotNull() & (a != b)


def _conflict(name: str, a: Column, b: Column) -> Column:
    return F.when(
        _differs(a, b), F.concat(F.lit(f"{name}_mismatch:"), a.cast("string"), F.lit("!="), b.cast("string"))
    )


def brands_compatible(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or one unknown."""
    return F.coalesce((a == b) | a.contains(b) | b.contains(a), F.lit(True))


def color_relation(a: Column, b: Column) -> Column:
    """same, conflict or uncertain; NULL when a side has no colour."""
    known = (F.size(titles.color_hues(a)) > 0) & (F.size(titles.color_hues(b)) > 0)
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.when(titles.colors_compatible(a, b), "same").when(known, "conflict").otherwise("uncertain"),
    )


def variant_conflict(ref: Column, cand: Column, color: Column) -> Column:
    """First gate attribute on which both sides differ."""
    checks = []
    for key in GATES:
        if key == "color":
            hit = color == "conflict"
        else:
            hit = _differs(_at(ref, key, "gates"), _at(cand, key, "gates"))
        text = F.concat(F.lit(f"variant_{key}_mismatch:"), _at(ref, key), F.lit("!="), _at(cand, key))
        checks.append(F.when(hit, text))
    return F.coalesce(*checks)


def critical_conflict(ref: Column, cand: Column) -> Column:
    """First critical attribute on which both sides differ, in the order of the rules."""
    a, b = ref["sig"], cand["sig"]
    either = lambda name: F.coalesce(ref["category"] == name, F.lit(False)) | F.coalesce(cand["category"] == name, F.lit(False))
    small = titles.capacity_gb
    disks = (small(a["storage"]) >= catalog.STORAGE_LIKE_MIN_GB) & (small(b["storage"]) >= catalog.STORAGE_LIKE_MIN_GB)
    group = lambda name: _conflict(name, _at(ref, name, "category_attrs"), _at(cand, name, "category_attrs"))
    return F.coalesce(
        _conflict("gpu", a["gpu"], b["gpu"]),
        _conflict("gpu_edition", a["edition"], b["edition"]),
        _conflict("ssd", a["ssd"], b["ssd"]),
        _conflict("phone", a["phone"], b["phone"]),
        _conflict("ddr", a["ddr"], b["ddr"]),
        _conflict("console_edition", a["console"], b["console"]),
        _conflict("motherboard", a["board"], b["board"]),
        F.when(
            either("cooler"),
            F.coalesce(_conflict("cooler_model", a["cooler"], b["cooler"]), group("cooler_type"), group("radiator_size")),
        ),
        F.when(
            either("psu"),
            F.coalesce(
                _conflict("psu_model", a["psu"], b["psu"]), _conflict("psu_wattage", a["watts"], b["watts"]),
                _conflict("psu_efficiency", a["efficiency"], b["efficiency"]), _conflict("psu_mpn", ref["mpn"], cand["mpn"]),
            ),
        ),
        _conflict("processor_model", a["cpu"], b["cpu"]),
        F.when(either("cpu") & (a["cpu"].isNotNull() | b["cpu"].isNotNull()), _conflict("processor_socket", a["socket"], b["socket"])),
        _conflict("controller_count", a["controllers"], b["controllers"]),
        _conflict("vram", a["vram"], b["vram"]),
        F.when(F.coalesce(disks & (small(a["storage"]) != small(b["storage"])), F.lit(False)), _conflict("storage", a["storage"], b["storage"])),
    )


def models_compatible(ref: Column, cand: Column) -> Column:
    """The same product line, with the few endings that may differ."""
    a, b = ref["sig"], cand["sig"]
    ma, mb, sa, sb = ref["model"], cand["model"], ref["soft_model"], cand["soft_model"]
    both = lambda name: a[name].isNotNull() & b[name].isNotNull()
    one_sided = (a["ssd"] == b["inferred"]) | (b["ssd"] == a["inferred"])
    code_in_title = (
        identifiers.opaque_model(ma) & b["ssd"].isNotNull() & b["compact_title"].contains(F.array_min(ref["own_mpns"]))
    ) | (identifiers.opaque_model(mb) & a["ssd"].isNotNull() & a["compact_title"].contains(F.array_min(cand["own_mpns"])))
    console = lambda m: m.contains("playstation5") | m.startswith("ps5")
    a_short = F.length(sa) <= F.length(sb)
    shorter, longer = F.when(a_short, sa).otherwise(sb), F.when(a_short, sb).otherwise(sa)
    tail = F.substr(longer, F.length(shorter) + 1)
    prefix = (F.length(shorter) >= 10) & longer.startswith(shorter) & tail.isin("", "digital", "disc", "bluray", "slim", "ps5", "i", "air")
    answer = (
        F.when(F.arrays_overlap(ref["own_mpns"], cand["own_mpns"]), F.lit(True))
        .when(both("ssd"), a["ssd"] == b["ssd"])
        .when(both("gpu"), a["gpu"] == b["gpu"])
        .when(both("phone"), a["phone"] == b["phone"])
        .when(both("board"), a["board"] == b["board"])
        .when(ma.isNull() | mb.isNull(), F.coalesce(one_sided, F.lit(False)))
        .when(_differs(a["cpu_family"], b["cpu_family"]), F.lit(False))
        .when(_differs(a["cpu"], b["cpu"]), F.lit(False))
        .when((ma == mb) | F.coalesce(code_in_title, F.lit(False)) | (sa == sb), F.lit(True))
        .when((F.concat(sa, F.lit("i")) == sb) | (F.concat(sb, F.lit("i")) == sa), F.lit(True))
        .when(console(sa) & console(sb), ~F.coalesce(_differs(a["console"], b["console"]), F.lit(False)))
        .otherwise(prefix)
    )
    return F.coalesce(answer, F.lit(False))


def title_exempt(ref: Column, cand: Column) -> Column:
    """Consoles, graphics cards and boards whose exact signature makes up for differing titles."""
    a, b = ref["sig"], cand["sig"]
    console = lambda m: m.contains("playstation5") | m.startswith("ps5")
    consoles = console(ref["soft_model"]) & console(cand["soft_model"])
    return F.coalesce(consoles, F.lit(False)) | F.coalesce(a["gpu"] == b["gpu"], F.lit(False)) | F.coalesce(a["board"] == b["board"], F.lit(False))


def _reason(code: str, detail: Column | str, score: Column | float | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    value = score if isinstance(score, Column) else F.lit(str(score))
    return F.struct(
        F.lit(code).alias("code"), text.cast("string").alias("detail"), value.cast("decimal(6,4)").alias("score")
    )


def _score(decision: Column | str, confidence: Column, reasons: Column) -> Column:
    d = F.lit(decision) if isinstance(decision, str) else decision
    return F.struct(d.alias("decision"), confidence.cast(CONFIDENCE).alias("confidence"), reasons.alias("reasons")).cast(SCORE)


def score_pairs(pairs: DataFrame, ref: str = "ref", cand: str = "cand", prices_apart: Column | None = None, same_offer: Column | None = None) -> DataFrame:
    """Add ``score`` STRUCT(decision, confidence, reasons) to rows with two identity structs.

    The two facts that come from the offers rather than their descriptions, extreme prices and an equal store id, are
    taken from the structs unless they are given.

    Facts about the pair are computed in one projection and the decision order
    is a single CASE over them. A rule's facts are compared, never re-parsed:
    all text work was done once per identity.
    """
    r, c = F.col(ref), F.col(cand)
    rows = pairs.withColumn("__color", color_relation(r["color"], c["color"]))
    rows = rows.withColumns(
        {
            "__code": F.when(r["monitor_code"].isNotNull() & c["monitor_code"].isNotNull(), F.lower(r["monitor_code"]) == F.lower(c["monitor_code"])),
            "__variant": variant_conflict(r, c, F.col("__color")),
            "__critical": critical_conflict(r, c),
            "__unsure": F.when(
                F.col("__color") == "uncertain", F.concat(F.lit("color:"), _at(r, "color"), F.lit("!="), _at(c, "color"))
            ),
            "__condition": titles.condition_conflict(r["condition"]["code"], c["condition"]["code"]),
            "__form": F.when(r["is_card"] & c["is_system"], "form_factor_mismatch:gpu!=system").when(
                r["is_system"] & c["is_card"], "form_factor_mismatch:system!=gpu"
            ),
            "__brands": r["brand"].isNotNull() & c["brand"].isNotNull(),
            "__compatible": brands_compatible(r["brand"], c["brand"]),
            "__sim": titles.similarity(r["tokens"], c["tokens"]),
            "__price": price_extreme(r["price"], c["price"], r["currency"], c["currency"]) if prices_apart is None else prices_apart,
            "__offer": (r["store"] == c["store"]) & (r["product_id"] == c["product_id"]) if same_offer is None else same_offer,
            "__carrier": _at(r, "network_lock").isNull() & F.coalesce(_at(c, "network_lock") == "locked", F.lit(False)),
            "__mpn": F.array_min(F.array_intersect(r["mpns"], c["mpns"])),
            "__number": F.array_min(F.array_intersect(r["model_numbers"], c["model_numbers"])),
            "__models": models_compatible(r, c),
            "__exempt": title_exempt(r, c),
            "__cooler": F.coalesce((r["category"] == "cooler") & (c["category"] == "cooler") & (r["sig"]["cooler"] == c["sig"]["cooler"]), F.lit(False)),
            "__cpu": F.coalesce((r["category"] == "cpu") & (c["category"] == "cpu") & (r["sig"]["cpu"] == c["sig"]["cpu"]), F.lit(False)),
            "__screens": F.when(
                F.coalesce((r["category"] == "monitor") & (c["category"] == "monitor"), F.lit(False)),
                F.array_compact(F.array(*[F.when(_at(r, k) == _at(c, k), F.lit(k)) for k in MONITOR_KEYS])),
            ).otherwise(F.array().cast("array<string>")),
        }
    )
    clash = F.col("__brands") & ~F.col("__compatible")
    agree = F.col("__brands") & F.col("__compatible")
    same_model = r["model"].eqNullSafe(c["model"])
    soft = (F.col("__models") & r["model"].isNotNull() & c["model"].isNotNull() & agree) | (F.col("__cooler") & agree)
    titles_far = ~same_model & (F.col("__sim") < SOFT_TITLE_MIN) & ~(F.col("__exempt") | F.col("__cpu") | F.col("__cooler"))
    rows = rows.withColumns({"__clash": clash, "__agree": agree, "__soft": soft & ~titles_far})
    rows = rows.withColumn("score", _decide(r, c))
    return rows.drop(*[x for x in rows.columns if x.startswith("__")])


def _decide(r: Column, c: Column) -> Column:
    none = F.array().cast(f"array<{REASON.simpleString()}>")
    one = lambda *reasons: F.array(*reasons)
    flag = F.col
    renewed = c["condition"]["code"].isin("renewed", "refurbished")
    first = F.when(
        renewed, one(_reason("offer_condition", F.concat_ws(":", c["condition"]["code"], c["condition"]["grade"]), 1))
    ).otherwise(none)
    also = lambda *reasons: F.concat(first, one(*reasons))
    reject = lambda code, detail: _score("reject", number("0"), one(_reason(code, detail, 0)))
    unsure = _reason("variant_semantic_uncertain", flag("__unsure"), "0.5")
    carrier = _reason("carrier_variant_uncertain", "reference_lock_unknown:candidate_locked", "0.5")

    def exact(code: str, detail: Column, clash_code: str, clash_detail: str, confidence: str, extra=None):
        """An equal identifier: review when the brands differ, else automatic."""
        found = _reason(code, detail, 1)
        chain = F.when(flag("__clash"), _score("review", number("0.85"), also(found, _reason(clash_code, clash_detail, "0.5"))))
        for when_, result in extra(found) if extra else []:
            chain = chain.when(when_, result)
        return chain.otherwise(_score("auto_match", number(confidence), also(found)))

    gtin = r["gtin"].isNotNull() & (r["gtin"] == c["gtin"])
    with_carrier = lambda f: [(flag("__carrier"), _score("review", number("0.88"), also(f, carrier)))]
    number_found = _reason("model_number_exact", F.concat(F.lit("model_number="), flag("__number")), 1)

    # points so far
    brand = F.when(flag("__agree"), number(BRAND_POINTS)).otherwise(number("0"))
    screens = F.size("__screens")
    base = brand + (screens * F.lit(MONITOR_POINTS).cast("decimal(4,2)")).cast(CONFIDENCE)
    brand_reason = F.when(flag("__agree"), one(_reason("brand_match", r["brand"], 1))).otherwise(none)
    screen_reason = F.when(
        screens > 0,
        one(_reason("monitor_specs_agree", F.concat(F.lit("attributes="), F.array_join("__screens", ",")), screens / F.lit(4))),
    ).otherwise(none)
    start = F.concat(first, brand_reason, screen_reason)
    title_reason = F.when(
        flag("__sim") > 0, one(_reason("title_similarity", F.format_string("token_set_ratio=%.3f", flag("__sim")), flag("__sim")))
    ).otherwise(none)

    # soft model
    model_detail = F.concat_ws("", r["brand"], F.lit(":"), F.coalesce(r["model"], F.lit("None")), F.lit("~"), F.coalesce(c["model"], F.lit("None")))
    soft_points = F.greatest((base + number(MODEL_POINTS)).cast("decimal(6,4)"), F.lit(AUTO).cast("decimal(6,4)"))
    soft_reasons = F.concat(start, one(_reason("brand_model_exact", model_detail, 1)), title_reason)
    soft = (
        F.when(
            flag("__unsure").isNotNull(),
            _score("review", F.least(soft_points, F.lit("0.89").cast("decimal(6,4)")), F.concat(soft_reasons, one(unsure))),
        )
        .when(flag("__price"), _score("review", number("0.88"), F.concat(soft_reasons, one(_reason("price_deviation", "extreme_price_ratio", 0)))))
        .when(flag("__carrier"), _score("review", F.least(soft_points, F.lit("0.88").cast("decimal(6,4)")), F.concat(soft_reasons, one(carrier))))
        .otherwise(_score("auto_match", F.least(soft_points, F.lit("0.97").cast("decimal(6,4)")), soft_reasons))
    )

    # title only
    similarity = F.round(flag("__sim"), 4).cast("decimal(6,4)")
    title_points = F.when(
        flag("__sim") > 0, F.bround((similarity * F.lit(TITLE_WEIGHT).cast("decimal(3,2)")).cast("decimal(10,6)"), 4)
    ).otherwise(F.lit(0))
    wide = "decimal(6,4)"
    total = (base.cast(wide) + title_points.cast(wide)).cast(wide)
    uncapped = (r["gtin"].isNotNull() & c["gtin"].isNotNull()) | (screens >= 3)
    total = F.when(uncapped, total).otherwise(F.least(total, F.lit(TITLE_CAP).cast(wide)))
    total = F.when(flag("__price") & (total >= F.lit(AUTO).cast(wide)), F.lit(REVIEW).cast(wide)).otherwise(total)
    total = F.least(total, F.lit("1").cast(wide))
    weak_reasons = F.concat(
        start, title_reason, F.when(flag("__price"), one(_reason("price_deviation", "extreme_price_ratio", 0))).otherwise(none)
    )
    weak = (
        F.when(total >= F.lit(REVIEW).cast(wide), _score("review", total, weak_reasons))
        .when(flag("__unsure").isNotNull(), _score("review", number(REVIEW), F.concat(weak_reasons, one(unsure))))
        .otherwise(_score("reject", total, weak_reasons))
    )

    same_code = F.coalesce(flag("__code"), F.lit(False))
    return (
        F.when(~flag("__code"), reject("monitor_model_code_conflict", F.concat(r["monitor_code"], F.lit("!="), c["monitor_code"])))
        .when(~same_code & flag("__variant").isNotNull(), reject("variant_mismatch", flag("__variant")))
        .when(~same_code & flag("__critical").isNotNull(), reject("critical_conflict", flag("__critical")))
        .when(c["is_accessory"] & ~r["is_accessory"], reject("accessory_reject", "candidate_title_looks_like_accessory"))
        .when(c["is_bundle"] & ~r["is_bundle"], reject("bundle_reject", "candidate_title_looks_like_bundle"))
        .when(flag("__form").isNotNull(), reject("form_factor_reject", flag("__form")))
        .when(flag("__condition").isNotNull(), reject("condition_reject", flag("__condition")))
        .when(
            (_at(r, "network_lock") == "unlocked") & (_at(c, "network_lock") == "locked"),
            _score("reject", number("0"), also(_reason("carrier_lock_reject", "network_lock:unlocked!=locked", 0))),
        )
        .when(
            same_code,
            exact("monitor_model_code_exact", F.concat(F.lit("model_code="), r["monitor_code"]),
                  "monitor_model_code_brand_conflict", "model_code_match_but_brand_diverges", "0.99"),
        )
        .when(flag("__offer"), _score("auto_match", number("1"), also(_reason("same_store_product_id", "identical_store_local_id", 1))))
        .when(
            gtin,
            exact("gtin_exact", F.concat(F.lit("gtin="), r["gtin"]), "gtin_brand_conflict", "gtin_match_but_brand_diverges", "0.99", with_carrier),
        )
        .when(
            flag("__mpn").isNotNull(),
            exact("mpn_exact", F.concat(F.lit("mpn="), flag("__mpn")), "mpn_brand_conflict", "mpn_match_but_brand_diverges", "0.98"),
        )
        .when(
            flag("__number").isNotNull(),
            F.when(flag("__unsure").isNotNull(), _score("review", number("0.85"), also(number_found, unsure))).otherwise(
                exact("model_number_exact", F.concat(F.lit("model_number="), flag("__number")), "model_number_brand_conflict",
                      "model_number_match_but_brand_diverges", "0.98")
            ),
        )
        .when(
            flag("__cpu"),
            exact("processor_model_exact", F.concat(F.coalesce(r["model"], F.lit("title")), F.lit("~"), F.coalesce(c["model"], F.lit("title"))),
                  "processor_brand_conflict", "brands_differ", "0.98"),
        )
        .when(flag("__clash"), _score("reject", number("0"), also(_reason("brand_mismatch", F.concat(r["brand"], F.lit("!="), c["brand"]), 0))))
        .when(flag("__soft"), soft)
        .otherwise(weak)
    )


def title_prefilter(pairs: DataFrame, ref: str = "ref", cand: str = "cand") -> DataFrame:
    """Add ``reject_reason``: a clear conflict that titles alone show; NULL keeps the pair."""
    r, c = F.col(ref), F.col(cand)
    named = F.nullif(F.trim(c["title"]), F.lit("")).isNotNull()
    reason = F.coalesce(
        F.when(c["is_accessory"] & ~r["is_accessory"], "accessory_reject"),
        F.when(c["is_bundle"] & ~r["is_bundle"], "bundle_reject"),
        titles.condition_conflict(r["condition"]["code"], c["condition"]["code"]),
        F.when(r["is_card"] & c["is_system"], "form_factor_mismatch:gpu!=system").when(
            r["is_system"] & c["is_card"], "form_factor_mismatch:system!=gpu"
        ),
        critical_conflict(r, c),
        F.when(
            r["brand"].isNotNull() & c["brand"].isNotNull() & ~brands_compatible(r["brand"], c["brand"]),
            F.concat(F.lit("brand_mismatch:"), r["brand"], F.lit("!="), c["brand"]),
        ),
    )
    return pairs.withColumn("reject_reason", F.when(named, reason))


# --- candidate pairs --------------------------------------------------------------------------


def blocking_keys(identities: DataFrame, id_column: str) -> DataFrame:
    """(id, kind, key) rows: everything two descriptions of one product may share."""
    one = lambda kind, key: F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    many = lambda kind, keys: F.transform(
        F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    )
    joined = lambda *parts: F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("|", *parts))
    keys = F.concat(
        F.array_compact(
            F.array(
                one("gtin", F.col("gtin")),
                *([one("offer", joined(F.col("store"), F.col("product_id")))] if "store" in identities.columns else []),
                one("monitor", F.lower("monitor_code")),
                one("model", joined(F.col("brand"), F.col("model_key"))),
            )
        ),
        many("mpn", F.col("mpns")),
        many("number", F.col("model_numbers")),
    )
    return identities.select(F.col(id_column), F.explode(keys).alias("k")).select(id_column, "k.kind", "k.key")


TILE = 2048  # rows of a block that meet as many of the other side in one piece of work


def tiled(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tile: int = TILE) -> DataFrame:
    """All (left row, right row) with equal keys, as an equi join in which no piece of work has more than about ``tile`` rows of a side.

    The sides of a block of n and m rows are cut into ceil(n / tile) and ceil(m / tile) tiles by a hash of ``a`` and ``b``. A
    row goes once to each tile of the other side, so each pair of tiles meets once, somewhere of its own; smaller
    blocks are one tile a side and cost an equi join. Only blocks that both sides have are read any further.
    """
    sizes = left.groupBy(*keys).agg(F.count("*").alias("__n")).join(right.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
    tiles = lambda n: F.ceil(F.col(n) / F.lit(tile)).cast("int")
    sizes = staged(sizes.select(*keys, tiles("__n").alias("__i_all"), tiles("__m").alias("__j_all")))

    def side(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(by), F.col(f"{own}_all")).cast("int")
        # the sizes have one row for each key, so that a hot block is split here as any skewed join is
        return rows.join(sizes, keys).withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_all") - 1))).drop("__i_all", "__j_all")

    return side(left, a, "__i", "__j").join(side(right, b, "__j", "__i"), [*keys, "__i", "__j"]).drop("__i", "__j")


def candidate_pairs(refs: DataFrame, cands: DataFrame, ref_id: str = "ref_id", cand_id: str = "cand_id") -> DataFrame:
    """Distinct (ref_id, cand_id) that share a blocking key. Equi joins only, hot blocks in tiles."""
    left, right = blocking_keys(refs, ref_id), blocking_keys(cands, cand_id)
    return tiled(left, right, ["kind", "key"], ref_id, cand_id).select(ref_id, cand_id).dropDuplicates([ref_id, cand_id])


def block_report(refs: DataFrame, cands: DataFrame, ref_id: str = "ref_id", cand_id: str = "cand_id") -> DataFrame:
    """Rows per block on both sides and the comparisons they cost, to see oversized blocks first."""
    left = blocking_keys(refs, ref_id).groupBy("kind", "key").agg(F.count("*").alias("refs"))
    right = blocking_keys(cands, cand_id).groupBy("kind", "key").agg(F.count("*").alias("cands"))
    return left.join(right, ["kind", "key"]).withColumn("pairs", F.col("refs") * F.col("cands"))


#: Facts of a description that reject a pair for certain where both sides know them and differ: all gates but colour, whose names may agree.
PLAIN_GATES = tuple(k for k in GATES if k != "color")


def gate_facts() -> Column:
    """The plain gates and the monitor's code as hashes, 0 where unknown: enough to turn most pairs of a block away before anything wide is joined."""
    known = [F.col("gates")[k] for k in PLAIN_GATES] + [F.lower("monitor_code")]
    return F.array(*[F.when(v.isNull(), F.lit(0)).otherwise(F.hash(v)) for v in known])


def surely_rejected(a: Column, b: Column) -> Column:
    """By ``gate_facts`` of both sides: different codes, or a gate in conflict without equal codes. Equal hashes keep a pair, so none is lost."""
    differ = lambda k: (F.get(a, F.lit(k)) != 0) & (F.get(b, F.lit(k)) != 0) & (F.get(a, F.lit(k)) != F.get(b, F.lit(k)))
    code = len(PLAIN_GATES)
    same_code = (F.get(a, F.lit(code)) != 0) & (F.get(a, F.lit(code)) == F.get(b, F.lit(code)))
    return differ(code) | (~same_code & reduce(lambda x, y: x | y, [differ(k) for k in range(code)]))


def match(refs: DataFrame, cands: DataFrame, ref_id: str = "ref_id", cand_id: str = "cand_id", rejects: bool = True) -> DataFrame:
    """Score every candidate against the references it shares a key with: ``ref_id``, ``cand_id``, ``score``.

    References and candidates are item tables. Their descriptions are parsed once each, however many offers share one;
    descriptions meet by blocking keys, hot blocks in tiles, and each pair of descriptions is scored once, at most
    once more for offers whose prices are far apart. Offers with an equal store id meet by that id. Without
    ``rejects`` pairs that a few hashed facts reject go before the identities are joined, and no rejected pair comes out.
    """
    identities, (left, right) = describe(refs, cands)
    left = staged(left.select(F.col(ref_id), F.col("description_id").alias("rd"), *[F.col(c).alias(f"r_{c}") for c in OFFER_COLUMNS]))
    right = staged(right.select(F.col(cand_id), F.col("description_id").alias("cd"), *[F.col(c).alias(f"c_{c}") for c in OFFER_COLUMNS]))
    priced = lambda rows, d, price: rows.groupBy(d).agg(F.max(F.col(price) > 0).alias(f"{d}_priced"))
    sides = identities.withColumn("facts", gate_facts())
    one = sides.join(priced(left, "rd", "r_price"), identities["description_id"] == F.col("rd"))
    two = sides.join(priced(right, "cd", "c_price"), identities["description_id"] == F.col("cd"))
    pairs = staged(candidate_pairs(one, two, "rd", "cd"))
    narrow = pairs.join(one.select("rd", "rd_priced", F.col("facts").alias("a")), "rd").join(two.select("cd", "cd_priced", F.col("facts").alias("b")), "cd")
    if not rejects:
        narrow = narrow.where(~surely_rejected(F.col("a"), F.col("b")))
    both = F.coalesce(F.col("rd_priced") & F.col("cd_priced"), F.lit(False))
    asked = narrow.select("rd", "cd", F.explode(F.when(both, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("apart"), F.lit(False).alias("offer"))
    same_id = [F.col(f"r_{c}") == F.col(f"c_{c}") for c in ("store", "product_id")]
    offers = staged(left.join(right, same_id[0] & same_id[1]).select(ref_id, cand_id, "rd", "cd"))
    asked = asked.unionByName(offers.select("rd", "cd", F.lit(False).alias("apart"), F.lit(True).alias("offer")).distinct())
    struct = F.struct(*[F.col(c) for c in IDENTITY_COLUMNS if c not in OFFER_COLUMNS])
    wide = asked.join(identities.select(F.col("description_id").alias("rd"), struct.alias("ref")), "rd").join(identities.select(F.col("description_id").alias("cd"), struct.alias("cand")), "cd")
    # staged before any filter: pushing one into the decision rules would repeat them
    scored = staged(score_pairs(wide, prices_apart=F.col("apart"), same_offer=F.col("offer")).select("rd", "cd", "apart", "offer", "score"))
    if not rejects:
        scored = scored.where("score.decision <> 'reject'")
    by_text = scored.where("not offer").drop("offer").join(left, "rd").join(right, "cd")
    by_text = by_text.where(F.col("apart") == price_extreme(F.col("r_price"), F.col("c_price"), F.col("r_currency"), F.col("c_currency")))
    by_text = by_text.where(~F.coalesce(same_id[0] & same_id[1], F.lit(False))).select(ref_id, cand_id, "score")
    by_offer = scored.where("offer").join(offers, ["rd", "cd"]).select(ref_id, cand_id, "score")
    return by_text.unionByName(by_offer)


# --- best picks -------------------------------------------------------------------------------


def best_per_store(hits: DataFrame) -> DataFrame:
    """Best hit per reference and store: highest confidence, the first seen on ties.

    ``hits`` has ref_id, store, confidence, seq. An aggregate, so no group is sorted.
    """
    rest = [c for c in hits.columns if c not in ("ref_id", "store")]
    rank = F.struct(F.col("confidence"), (-F.col("seq")).alias("first"))
    return hits.groupBy("ref_id", "store").agg(F.max_by(F.struct(*rest), rank).alias("b")).select("ref_id", "store", "b.*")


def best_product(scored: DataFrame) -> DataFrame:
    """Best product per incoming listing from (cand_id, ref_id, decision, confidence, same_store).

    Automatic before review, then confidence, then product id. An automatic match
    becomes a review when the store already has a listing of that product, or
    when two products are equally good.
    """
    kept = scored.where(F.col("decision") != "reject").withColumn(
        "decision",
        F.when((F.col("decision") == "auto_match") & F.col("same_store"), "review").otherwise(F.col("decision")),
    )
    auto = (F.col("decision") == "auto_match").cast("int")
    # most matches first, smallest id on ties: two aggregates instead of a sorted window
    ranked = kept.withColumn("rank", F.struct(auto.alias("auto"), F.col("confidence").alias("confidence")))
    top = ranked.groupBy("cand_id").agg(F.max("rank").alias("top"), F.count("*").alias("candidates"))
    best = ranked.join(top, "cand_id").where(F.col("rank") == F.col("top"))
    picked = best.groupBy("cand_id").agg(
        F.min("ref_id").alias("ref_id"), F.count("*").alias("ties"), F.first("top").alias("top"), F.first("candidates").alias("candidates")
    )
    decision = F.when((F.col("top.auto") == 1) & (F.col("ties") == 1), "auto_match").otherwise("review")
    return picked.select("cand_id", "ref_id", decision.alias("decision"), F.col("top.confidence").alias("confidence"), "candidates")


# --- learned barcodes -------------------------------------------------------------------------


def gtin_consensus(references: DataFrame, hits: DataFrame) -> DataFrame:
    """One barcode per reference where all trusted sources agree; none on any conflict.

    ``references``: ref_id, gtin, brand (folded). ``hits``: ref_id, store, decision, gtin, brand, seq.
    """
    own = references.select(
        "ref_id", identifiers.gtin(F.col("gtin")).alias("value"), F.lit("reference").alias("source"), F.lit(2**62).alias("place")
    )
    brands = references.select("ref_id", F.col("brand").alias("ref_brand"))
    trusted = (
        hits.where(F.col("decision") == "auto_match")
        .withColumns({"value": identifiers.gtin(F.col("gtin")), "b": identifiers.brand(F.col("brand"))})
        .where(F.col("value").isNotNull())
        .join(brands, "ref_id")
        .where(brands_compatible(F.col("ref_brand"), F.col("b")))
        .select("ref_id", "value", F.concat(F.lit("auto_match:"), F.col("store")).alias("source"), F.col("seq").cast("long").alias("place"))
    )
    seen = own.where(F.col("value").isNotNull()).unionByName(trusted)
    return (
        seen.groupBy("ref_id")
        .agg(F.min("value").alias("gtin"), F.max("value").alias("other"), F.min_by("source", "place").alias("source"))
        .where(F.col("gtin") == F.col("other"))
        .drop("other")
    )


def with_learned_gtin(items: DataFrame, learned: DataFrame, id_column: str = "ref_id") -> DataFrame:
    """Items with the learned barcode filled in where they have none."""
    known = learned.select(F.col("ref_id").alias(id_column), F.col("gtin").alias("__learned"))
    return items.join(known, id_column, "left").withColumn("gtin", F.coalesce(identifiers.gtin(F.col("gtin")), "__learned")).drop("__learned")


def match_and_learn(refs: DataFrame, cands: DataFrame, ref_id: str = "ref_id", cand_id: str = "cand_id") -> DataFrame:
    """``match`` without rejects, repeated with the barcodes that it teaches the references until none learns any more.

    Each pass is semi-naive: only references that have just learned a barcode are scored again, and only with the
    candidates they met before or that carry this barcode, as no other pair can have changed. A reference learns once, by
    the consensus of its automatic matches, so the passes come to an end.
    """
    refs = refs if "gtin" in refs.columns else refs.withColumn("gtin", F.lit(None).cast("string"))
    cands = staged(cands.withColumn("__code", identifiers.gtin(F.col("gtin"))))
    plain = cands.drop("__code")
    scored = staged(match(refs, plain, ref_id, cand_id, rejects=False))
    while True:
        taught = refs.select(F.col(ref_id).alias("ref_id"), identifiers.gtin(F.col("gtin")).alias("gtin"), identifiers.brand(F.col("brand")).alias("brand"))
        sources = cands.select(cand_id, F.coalesce("store", F.lit("")).alias("store"), F.col("__code").alias("gtin"), "brand").where("gtin is not null")
        hits = scored.join(sources, cand_id).select(F.col(ref_id).alias("ref_id"), "store", F.col("score.decision").alias("decision"), "gtin", "brand", F.xxhash64(cand_id).alias("seq"))
        untaught = taught.where("gtin is null").select("ref_id")
        new = staged(gtin_consensus(taught, hits).join(untaught, "ref_id").select("ref_id", "gtin"))
        if new.isEmpty():
            return scored
        keys = new.select(F.col("ref_id").alias(ref_id))
        touched = staged(with_learned_gtin(refs.join(keys, ref_id, "left_semi"), new, ref_id))
        met = scored.join(keys, ref_id, "left_semi").select(cand_id).unionByName(cands.join(new.select(F.col("gtin").alias("__code")).distinct(), "__code").select(cand_id))
        again = match(touched, plain.join(met.distinct(), cand_id, "left_semi"), ref_id, cand_id, rejects=False)
        scored = staged(scored.join(keys, ref_id, "left_anti").unionByName(again))
        refs = staged(with_learned_gtin(refs, new, ref_id))


# --- semantic support -------------------------------------------------------------------------


def needs_semantics(score: Column) -> Column:
    return (score["decision"] == "review") & F.exists(score["reasons"], lambda x: x["code"] == "variant_semantic_uncertain")


def promote(score: Column, similarity: Column, threshold: float, prices_apart: Column) -> Column:
    """A review becomes automatic when the texts are close and only the colour wording is unclear."""
    codes = F.transform(score["reasons"], lambda x: x["code"])
    ok = (
        needs_semantics(score)
        & (similarity >= F.lit(threshold))
        & F.array_contains(codes, "brand_model_exact")
        & ~F.array_contains(codes, "price_deviation")
        & ~prices_apart
    )
    support = _reason("embedding_variant_support", F.format_string("cosine_similarity=%.6f", similarity), similarity)
    better = _score("auto_match", F.greatest(score["confidence"], number("0.9")), F.concat(score["reasons"], F.array(support)))
    return F.when(F.coalesce(ok, F.lit(False)), better).otherwise(score.cast(SCORE))


def semantic_evidence(
    scored: DataFrame, vectors: DataFrame, threshold: float | None, active: bool = True
) -> DataFrame:
    """Compare the texts of unclear pairs and promote close ones.

    ``scored``: run_id, seq, ref_text_key, cand_text_key, prices_apart, score.
    ``vectors``: text_key, vector. All pairs that need it are compared.
    """
    asked = scored.where(needs_semantics(F.col("score")))
    side = lambda name: vectors.select(F.col("text_key").alias(f"{name}_text_key"), F.col("vector").alias(f"__{name}"))
    within = asked.join(side("ref"), "ref_text_key", "left").join(side("cand"), "cand_text_key", "left")
    compared = within.withColumn("similarity", F.round(cosine(F.col("__ref"), F.col("__cand")), 6)).withColumn(
        "evidence_status", F.when(F.col("similarity").isNotNull(), "ok").otherwise("skipped_empty")
    )
    if active and threshold is not None:
        compared = compared.withColumn("score", promote(F.col("score"), F.col("similarity"), threshold, F.col("prices_apart")))
    rest = scored.where(~F.coalesce(needs_semantics(F.col("score")), F.lit(False))).withColumn("evidence_status", F.lit(None).cast("string"))
    empty = lambda df: df.withColumn("similarity", F.lit(None).cast("double"))
    columns = [*scored.columns, "similarity", "evidence_status"]
    return compared.select(columns).unionByName(empty(rest).select(columns))
