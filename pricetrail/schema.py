"""Column types of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
RATE = T.DecimalType(24, 12)
CONFIDENCE = T.DecimalType(5, 4)
STR_MAP = T.MapType(T.StringType(), T.StringType())


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, B, I, L, TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.TimestampType()

# One offer as a store showed it, plus how the check ended (ok, failed, removed).
OFFER = struct(
    ("store", S), ("country", S), ("product_id", S), ("sku", S), ("url", S), ("canonical_url", S),
    ("title", S), ("currency", S), ("price", MONEY), ("pix_price", MONEY), ("original_price", MONEY),
    ("seller", S), ("availability", S), ("available", B), ("metadata", STR_MAP), ("scraped_at", TS),
)
OBSERVATION = T.StructType(
    [
        *struct(("listing_id", S), ("observation_id", S), ("outcome", S), ("failure_kind", S)).fields,
        *OFFER.fields,
    ]
)
DETAILS = struct(
    ("store", S), ("country", S), ("product_id", S), ("sku", S), ("title", S), ("brand", S),
    ("model", S), ("variant", S), ("gtin", S), ("description", S),
    ("specifications", STR_MAP), ("images", T.ArrayType(S)),
    ("metadata", STR_MAP), ("sources", STR_MAP),
)
PROMOTION = struct(
    ("promotion_price", S), ("price", S), ("expires_at", S), ("starts_at", S), ("type", S),
)
# State of an offer around an event. Money is text, as in imported histories.
PAYLOAD = struct(
    ("price", S), ("currency", S), ("seller", S), ("availability", S), ("available", B),
    ("pix_price", S), ("original_price", S), ("scraped_at", S), ("product_id", S), ("sku", S),
    ("url", S), ("canonical_url", S), ("store", S), ("country", S),
    ("condition", S), ("condition_grade", S), ("carrier", S),
    ("promotion_price", S), ("promotion_status", S), ("promotion_expires_at", S),
    ("promotion_payload", PROMOTION), ("source", S),
    ("error", S), ("code", S), ("kind", S), ("observed", B),
)
EVENT = struct(
    ("id", S), ("listing_id", S), ("event_type", S), ("before", PAYLOAD), ("after", PAYLOAD),
    ("detected_at", TS),
)
SNAPSHOT = struct(
    ("id", S), ("listing_id", S), ("price", MONEY), ("currency", S), ("seller", S),
    ("availability", S), ("available", B), ("fingerprint", S), ("payload", PAYLOAD),
    ("scraped_at", TS),
)
PRODUCT = struct(
    ("id", S), ("owner_user_id", S), ("title", S), ("brand", S), ("model", S), ("variant_key", S),
    ("attributes", STR_MAP), ("created_at", TS), ("updated_at", TS),
)
LISTING = struct(
    ("id", S), ("canonical_product_id", S), ("store", S), ("country", S), ("product_id", S),
    ("sku", S), ("gtin", S), ("url", S), ("canonical_url", S), ("title", S),
    ("match_decision", S), ("confidence", CONFIDENCE), ("status", S),
)
RATES = struct(
    ("base_currency", S), ("quote_currency", S), ("rate_type", S), ("rate", RATE), ("source", S),
    ("source_timestamp", TS), ("fetched_at", TS), ("status", S),
)
REASON = struct(("code", S), ("detail", S), ("score", T.DecimalType(6, 4)))
SCORE = struct(("decision", S), ("confidence", CONFIDENCE), ("reasons", T.ArrayType(REASON)))


def empty_payload() -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in PAYLOAD.fields}
