"""Catalog tables: composing offers, finding listings, resolving products, upserts and intake."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, titles, units, urls
from ..functions.money import any_amount
from ..functions.patterns import let
from ..functions.text import blank_to_null, fold_key
from ..schema import CONFIDENCE, PAYLOAD
from ..session import dealt, settled, shuffles_go, spread, staged
from . import fx, matching
from .changes import fingerprint, latest_per_key, money_text
from .feed import visible
from .identity import IDENTITY_COLUMNS, OFFER_COLUMNS as IDENTITY_OFFER_COLUMNS, build_identities, describe
from .monitoring import initial_schedule, promotion_in_force



# --- offers and details -----------------------------------------------------------------------


def compose_items(offers: DataFrame, details: DataFrame, keys: Sequence[str] = ("store", "country", "product_id")) -> DataFrame:
    """Offer and details of one product as one item: the offer's ids and metadata win.

    Map entries of both stay; ``sources`` merge with the details winning.
    """
    mine = {c: F.col(f"d.{c}").alias(f"d_{c}") for c in details.columns if c not in keys}
    joined = offers.alias("o").join(details.alias("d"), list(keys), "left").select(
        *keys, *[F.col(f"o.{c}") for c in offers.columns if c not in keys], *mine.values()
    )
    empty = F.create_map().cast("map<string,string>")
    either = lambda c: F.coalesce(c, empty)
    out = {
        "sku": F.coalesce(F.col("sku"), F.col("d_sku")),
        "metadata": F.map_concat(either(F.col("d_metadata")), either(F.col("metadata"))),
    }
    if "sources" in offers.columns:
        out["sources"] = F.map_concat(either(F.col("sources")), either(F.col("d_sources")))
    plain = [c for c in details.columns if c not in {*keys, *offers.columns, "metadata", "sources", "sku"}]
    for c in plain:
        out[c] = F.col(f"d_{c}")
    return joined.withColumns(out).drop(*[f"d_{c}" for c in details.columns if c not in keys])


OFFER_COLUMNS = (
    "store", "country", "product_id", "sku", "seller", "url", "canonical_url", "currency", "price", "original_price",
    "pix_price", "availability", "available", "scraped_at", "metadata",
)


def offers_of(items: DataFrame) -> DataFrame:
    return items.select(*[c for c in OFFER_COLUMNS if c in items.columns])


def commercial_metadata(title: Column, metadata: Column) -> Column:
    """Metadata with condition, grade and carrier filled in from the title where missing."""
    def filled(meta, state):
        known = F.when(state["code"] != "unknown", state["code"])
        given = lambda k: blank_to_null(F.try_element_at(meta, F.lit(k)))
        entries = [
            ("condition", F.coalesce(given("condition"), known)),
            ("condition_grade", F.coalesce(given("condition_grade"), F.when(known.isNotNull(), state["grade"]))),
            ("carrier", F.coalesce(given("carrier"), titles.carrier(fold_key(title)))),
        ]
        rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries])
        return F.map_concat(meta, F.map_from_entries(F.filter(rows, lambda e: e["value"].isNotNull())))

    return let(metadata, lambda meta: let(titles.condition(title, meta), lambda state: filled(meta, state)))


def snapshot_payload(title: Column | None = None) -> Column:
    """Payload struct of an offer row, with money as text and the derived condition."""
    name = F.coalesce(F.col("title") if title is None else title, F.try_element_at(F.col("metadata"), F.lit("title")))

    def payload(meta, state):
        made = {
            "price": money_text(F.col("price")), "pix_price": money_text(F.col("pix_price")),
            "original_price": money_text(F.col("original_price")), "available": F.col("available"),
            "scraped_at": F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
            "condition": F.when(state["code"] != "unknown", state["code"]),
            "condition_grade": F.when(state["code"] != "unknown", state["grade"]),
            "carrier": F.try_element_at(meta, F.lit("carrier")),
        }
        for c in ("currency", "seller", "availability", "product_id", "sku", "url", "canonical_url", "store", "country"):
            made[c] = F.col(c)
        return F.struct(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields])

    # the condition is read from the filled-in metadata, which is read from the condition: bound, or the plan multiplies with each mention
    return let(commercial_metadata(name, F.col("metadata")), lambda meta: let(titles.condition(name, meta), lambda state: payload(meta, state)))


def snapshots(offers: DataFrame) -> DataFrame:
    """Snapshot rows to append: the offer's columns, its fingerprint and payload.

    The id is derived from listing, time and content, so a retried append writes
    the same rows again and a de-duplicating read sees them once.
    """
    offer = F.struct("price", "pix_price", "currency", "seller", "availability")
    made = offers.withColumns({"fingerprint": fingerprint(offer), "payload": snapshot_payload()})
    return made.select(
        F.sha2(F.concat_ws("|", "listing_id", F.unix_micros("scraped_at").cast("string"), "fingerprint"), 256).alias("id"),
        "listing_id", "price", "currency", "seller", "availability", "available", "fingerprint", "payload", "scraped_at",
    )


# --- finding listings and products ------------------------------------------------------------

LISTINGS_A_PASS = 10_000_000
MOST_PASSES = 4  # each reads all listings again; with these, other steps of an upsert take more disk


def is_synthetic(store: Column, url: Column, product_id: Column) -> Column:
    """Placeholder listings that only carry an identity for a search."""
    return F.coalesce(
        (F.lower(store) == "synthetic") & (F.lower(url).rlike("^[a-z]+://identity/") | F.lower(product_id).startswith("identity:")),
        F.lit(False),
    )


def _listing_keys(rows: DataFrame, id_column: str, ranks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(id, rank, hash, key): link, then store id, then SKU, those of ``ranks``.

    The hash goes before the key in joins and groups: keys begin alike, so sorting them by their text alone compares all of it each time.
    """
    key = lambda kind, *parts: F.when(
        F.greatest(*[p.isNull().cast("int") for p in parts]) == 0, F.concat_ws("|", F.lit(kind), *parts)
    )
    # each part is read once a row, and is a column of its own as keys mention it more than once
    named = rows.select(F.col(id_column), *[blank_to_null(F.col(c)).alias(c) for c in ("store", "country", "product_id", "sku", "canonical_url")])
    rows = named.withColumn("link", urls.canonical(F.col("canonical_url")))
    kinds = (
        (1, key("url", F.col("store"), F.col("canonical_url"))), (1, key("url", F.col("store"), F.col("link"))),
        (2, key("id", F.col("store"), F.col("country"), F.col("product_id"))), (3, key("sku", F.col("store"), F.col("country"), F.col("sku"))),
    )
    entries = F.array(*[F.struct(F.lit(rank).alias("rank"), made.alias("key")) for rank, made in kinds if rank in ranks])
    known = F.filter(F.array_distinct(entries), lambda e: e["key"].isNotNull())
    return rows.select(F.col(id_column), F.explode(known).alias("k")).select(id_column, "k.rank", F.xxhash64("k.key").alias("hash"), "k.key")


def find_listings(incoming: DataFrame, listings: DataFrame, id_column: str = "request_id") -> DataFrame:
    """The listing of each incoming row: by link, else by store id, else by SKU. One equi join."""
    wanted = _listing_keys(incoming, id_column)
    have = _listing_keys(listings.withColumnRenamed("id", "listing_id"), "listing_id").drop("rank")
    # a key shared by several listings gives the smallest id, decided before the join; keys of three kinds, dealt once for both
    met = _key_matches(wanted, have, 3 * _counted(listings)).groupBy(id_column).agg(F.min(F.struct("rank", "listing_id")).alias("first"))
    return met.select(id_column, "first.listing_id", F.col("first.rank").alias("found_by"))


def find_listings_in_turn(incoming: DataFrame, listings: DataFrame, id_column: str = "request_id") -> DataFrame:
    """What find_listings gives, a kind of key at a time: the next kind is dealt only for what no kind before has found, and once the files of that are gone.

    A batch that updates known listings needs the links alone, a third of the keys. Every key names its store, so of very many
    listings a part of the stores at a time is dealt.
    """
    left, found, count = incoming, [], _counted(listings)
    passes = max(1, min(MOST_PASSES, -(-count // LISTINGS_A_PASS)))
    part = lambda rows, k: rows if passes == 1 else rows.where(F.pmod(F.xxhash64(blank_to_null(F.col("store"))), F.lit(passes)) == k)
    for rank in (1, 2, 3):
        met = []
        for k in range(passes):
            wanted = _listing_keys(part(left, k), id_column, (rank,))
            have = _listing_keys(part(listings, k).withColumnRenamed("id", "listing_id"), "listing_id", (rank,)).drop("rank")
            met.append(staged(_key_matches(wanted, have, -(-count // passes)).select(id_column, "rank", "listing_id")))
        found.append(reduce(DataFrame.unionByName, met))
        left = left.join(found[-1], id_column, "left_anti")
        with shuffles_go(left.sparkSession):
            if rank < 3 and left.select(id_column).isEmpty():
                break
    met = reduce(DataFrame.unionByName, found).groupBy(id_column).agg(F.min(F.struct("rank", "listing_id")).alias("first"))
    return met.select(id_column, "first.listing_id", F.col("first.rank").alias("found_by"))


def _counted(rows: DataFrame) -> int:
    with shuffles_go(rows.sparkSession):
        return rows.count()


def _key_matches(wanted: DataFrame, have: DataFrame, count: int) -> DataFrame:
    keys = ["hash", "key"]
    have = dealt(have, count, *keys).groupBy(*keys).agg(F.min("listing_id").alias("listing_id"))
    return dealt(wanted, count, *keys).join(have, keys)


def products_by_gtin(rows: DataFrame, identifiers_table: DataFrame) -> DataFrame:
    """Add ``gtin_product_id``: the product that owns the row's validated barcode."""
    owners = identifiers_table.where("type = 'gtin'").groupBy(F.col("value_normalized").alias("__g")).agg(
        F.min("product_id").alias("gtin_product_id")
    )
    keyed = rows.withColumn("__g", identifiers.gtin(F.col("gtin")))
    return keyed.join(owners, "__g", "left").drop("__g")


def visible_products(products: DataFrame, viewer: str, is_admin: bool = False) -> DataFrame:
    return products.where(visible(F.col("owner_user_id"), viewer, is_admin))


def search_products(
    products: DataFrame, viewer: str, *, is_admin: bool = False, brand: str | None = None, model: str | None = None,
    variant: str | None = None, category: str | None = None, attributes: dict[str, str] | None = None, limit: int = 50,
) -> DataFrame:
    """Products that meet every given filter, newest first, at most ``limit`` (1..100).

    All filters run before the limit, so a match is never missed; a limit outside its bounds is an error.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    wanted = {k: v.strip() for k, v in (attributes or {}).items() if v and v.strip()}
    if not any((brand, model, variant, category, wanted)):
        raise ValueError("a search needs at least one filter")
    rows = visible_products(products, viewer, is_admin)
    attr = lambda k: blank_to_null(F.try_element_at(F.col("attributes"), F.lit(k)))
    if brand:
        rows = rows.where(identifiers.brand(F.col("brand")) == identifiers.brand(F.lit(brand)))
    if model:
        from ..functions.models import model_key

        asked = model_key(fold_key(F.lit(model)), F.lit(None).cast("string"))
        rows = rows.where(model_key(fold_key(F.col("model")), fold_key(F.col("title"))) == asked)
    if variant:
        from ..functions.models import variant_key

        keys = titles.variant_key_list(attr("variant"), F.col("variant_key"), attr("edition"))
        rows = rows.where(F.array_contains(keys, variant_key(fold_key(F.lit(variant)))))
    if category:
        rows = rows.where(F.lower(attr("category")) == category.strip().lower())
    for key, value in wanted.items():
        name = F.lit(key.lower())
        rows = rows.where(F.lower(units.normalise(name, attr(key.lower()))) == F.lower(units.normalise(name, F.lit(value))))
    return rows.orderBy(F.desc("updated_at"), "id").limit(limit)


def product_page(products: DataFrame, viewer: str, limit: int, offset: int = 0, is_admin: bool = False) -> DataFrame:
    """Offset page by last update; a keyset page is the better choice for deep pages."""
    return visible_products(products, viewer, is_admin).orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)


def listing_stores(listings: DataFrame) -> DataFrame:
    """(product, store, country) of listings that are still there, one row each."""
    live = listings.where(F.col("status") != "removed")
    return live.select(F.col("canonical_product_id").alias("ref_id"), "store", "country").distinct()


# --- resolution -------------------------------------------------------------------------------


def resolve_products(
    requests: DataFrame, products: DataFrame, identifiers_table: DataFrame, listings: DataFrame
) -> DataFrame:
    """What each incoming listing is: a known listing, an offer of a known product, unclear, or new.

    Requests: request_id, store, country, product_id, sku, url, canonical_url,
    title, brand, model, variant, category, gtin, target_product_id,
    create_new_product, viewer_id, is_admin. The first rule that answers wins:
    same-store listing, barcode, confirmed target, asked for as new, identity.
    """
    rows = requests.withColumn("__gtin", identifiers.gtin(F.col("gtin")))
    rows = rows.join(find_listings(requests, listings), "request_id", "left").join(
        listings.select(F.col("id").alias("listing_id"), F.col("canonical_product_id").alias("listing_product_id")), "listing_id", "left"
    )
    has_store = blank_to_null(F.col("store")).isNotNull() & blank_to_null(F.col("product_id")).isNotNull() & F.col("country").isNotNull()
    rows = rows.withColumn("listing_product_id", F.when(has_store, F.col("listing_product_id")))
    rows = products_by_gtin(rows, identifiers_table)
    open_requests = rows.where(
        F.col("listing_product_id").isNull() & F.col("gtin_product_id").isNull() & F.col("target_product_id").isNull()
        & ~F.coalesce(F.col("create_new_product"), F.lit(False))
    )
    by_identity = identity_matches(open_requests, products, identifiers_table, listings).select(
        F.col("cand_id").alias("request_id"), F.col("ref_id").alias("identity_product_id"),
        F.col("decision").alias("identity_decision"), F.col("confidence").alias("identity_confidence"),
    )
    rows = rows.join(by_identity, "request_id", "left")
    conflict = F.col("gtin_product_id").isNotNull() & F.col("target_product_id").isNotNull() & (F.col("gtin_product_id") != F.col("target_product_id"))
    matched_by = (
        F.when(F.col("listing_product_id").isNotNull(), "store_identity")
        .when(F.col("gtin_product_id").isNotNull(), "gtin")
        .when(F.col("target_product_id").isNotNull(), "user_confirmed")
        .when(F.coalesce(F.col("create_new_product"), F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("identity_product_id").isNotNull(), "identity")
    )
    picked = (
        F.when(F.col("matched_by") == "store_identity", F.col("listing_product_id"))
        .when(F.col("matched_by") == "gtin", F.col("gtin_product_id"))
        .when(F.col("matched_by") == "user_confirmed", F.col("target_product_id"))
        .when(F.col("matched_by") == "identity", F.col("identity_product_id"))
    )
    rows = rows.withColumn("matched_by", matched_by).withColumn("resolved_product_id", picked)
    owners = products.select(F.col("id").alias("resolved_product_id"), F.col("owner_user_id").alias("__owner"), F.lit(True).alias("__known"))
    rows = rows.join(owners, "resolved_product_id", "left")
    allowed = F.coalesce(F.col("is_admin"), F.lit(False)) | F.col("__owner").isNull() | (F.col("__owner") == F.col("viewer_id"))
    hidden = F.col("resolved_product_id").isNotNull() & (~F.coalesce(allowed, F.lit(False)) | F.col("__known").isNull())
    kind = (
        F.when(hidden & (F.col("matched_by") == "user_confirmed"), "product_not_found")
        .when(hidden, "forbidden")
        .when(conflict & (F.col("matched_by") == "gtin"), "identity_conflict")
        .when(F.col("matched_by") == "store_identity", "existing_listing")
        .when(F.col("matched_by").isin("gtin", "user_confirmed"), "existing_product_new_listing")
        .when(F.col("matched_by").isNull(), "new_product")
        .when(F.col("identity_decision") == "auto_match", "existing_product_new_listing")
        .otherwise("needs_review")
    )
    return rows.select(
        "request_id", kind.alias("kind"), "matched_by", F.col("resolved_product_id").alias("product_id"),
        F.when(F.col("matched_by") == "store_identity", F.col("listing_id")).alias("listing_id"),
        F.when(F.col("matched_by") == "identity", F.col("identity_confidence")).alias("confidence"),
    )


def identity_matches(requests: DataFrame, products: DataFrame, identifiers_table: DataFrame, listings: DataFrame) -> DataFrame:
    """Best product per request among those with the same model and a compatible brand.

    Blocks are (brand, model key); products without a brand form blocks of the
    model key alone. Products the viewer may not see never take part. Descriptions
    are parsed once each and meet by block, large blocks in tiles; each pair of
    descriptions is scored once, whatever number of requests share it.
    """
    barcode = identifiers_table.where("type = 'gtin'").groupBy(F.col("product_id").alias("ref_id")).agg(F.min("value_normalized").alias("gtin"))
    attrs = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    known = products.select(
        F.col("id").alias("ref_id"), "owner_user_id", "title", F.col("brand"), F.col("model"),
        F.try_element_at(attrs, F.lit("variant")).alias("variant"), F.try_element_at(attrs, F.lit("category")).alias("category"),
        attrs.alias("metadata"),
    ).join(barcode, "ref_id", "left")
    known = known.withColumn("stored_brand", identifiers.brand(F.col("brand")))
    asked = requests.select("request_id", "viewer_id", "is_admin", "store", "country", "title", "brand", "model", "variant", "category", "gtin")
    identities, (left, right) = describe(known, asked.withColumn("product_id", F.lit(None).cast("string")))
    left = staged(left.select("ref_id", "owner_user_id", "stored_brand", F.col("description_id").alias("rd")))
    right = staged(right.select(F.col("request_id").alias("cand_id"), "viewer_id", "is_admin", F.col("store").alias("in_store"), "country", F.col("description_id").alias("cd")))
    keyed = identities.select("description_id", "brand", F.col("model_key").alias("__key"), matching.gate_facts().alias("facts"))
    refs = left.select("rd", "stored_brand").distinct().join(
        keyed.select(F.col("description_id").alias("rd"), "__key", F.col("brand").alias("r_brand"), F.col("facts").alias("a")), "rd"
    )
    cands = right.select("cd").distinct().join(keyed.select(F.col("description_id").alias("cd"), "__key", F.col("brand").alias("__brand"), F.col("facts").alias("b")), "cd")
    cands = cands.where(F.col("__brand").isNotNull() & F.col("__key").isNotNull())
    named = matching.tiled(refs.where("stored_brand is not null").withColumnRenamed("stored_brand", "__brand"), cands, ["__brand", "__key"], "rd", "cd")
    nameless = matching.tiled(refs.where("stored_brand is null").drop("stored_brand"), cands, ["__key"], "rd", "cd")
    columns = ["rd", "cd", "r_brand", "__brand", "a", "b"]
    pairs = named.select(columns).unionByName(nameless.select(columns)).where(F.col("r_brand").isNull() | (F.col("r_brand") == F.col("__brand")))
    # a rejected pair is never the best product, so what a few hashed facts reject goes before the identities are joined
    pairs = spread(pairs.where(~matching.surely_rejected(F.col("a"), F.col("b"))).select("rd", "cd"))
    struct = F.struct(*[F.col(c) for c in IDENTITY_COLUMNS if c not in IDENTITY_OFFER_COLUMNS])
    wide = pairs.join(identities.select(F.col("description_id").alias("rd"), struct.alias("ref")), "rd").join(
        identities.select(F.col("description_id").alias("cd"), struct.alias("cand")), "cd"
    )
    # staged before any filter: pushing one into the decision rules would repeat them. Prices and store ids take no part here.
    scored = staged(matching.score_pairs(wide, prices_apart=F.lit(False), same_offer=F.lit(False)).select("rd", "cd", "score"))
    seen = scored.where("score.decision <> 'reject'").join(left, "rd").join(right, "cd")
    scored = seen.where(F.coalesce(F.col("is_admin"), F.lit(False)) | F.col("owner_user_id").isNull() | (F.col("owner_user_id") == F.col("viewer_id")))
    stores = listing_stores(listings).select("ref_id", F.col("store").alias("in_store"), "country", F.lit(True).alias("same_listing"))
    scored = scored.join(stores, ["ref_id", "in_store", "country"], "left")
    return matching.best_product(
        scored.select(
            "cand_id", "ref_id", "score.decision", "score.confidence", F.coalesce("same_listing", F.lit(False)).alias("same_store")
        )
    )


# --- upserts ----------------------------------------------------------------------------------


def newest_values(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per key and column the last non-null value. Combines before the shuffle."""
    return rows.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def merge_attributes(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Attribute maps of a key's rows merged, later rows winning per attribute."""
    entries = rows.select(*keys, order, F.explode("attributes").alias("name", "value"))
    last = entries.groupBy(*keys, "name").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attributes"))


def upsert_products(products: DataFrame, identifiers_table: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The product table after a batch of identities with barcodes (gtin, seq, title, brand, model, variant_key, attributes).

    Non-null new values win, attributes merge, unknown barcodes become products.
    Rows of one barcode inside the batch collapse first.
    """
    batch = incoming.withColumn("gtin", identifiers.gtin(F.col("gtin"))).where(F.col("gtin").isNotNull())
    collapsed = newest_values(batch, ["gtin"], "seq", ["title", "brand", "model", "variant_key"]).join(
        merge_attributes(batch, ["gtin"], "seq"), "gtin", "left"
    )
    owners = identifiers_table.where("type = 'gtin'").select(F.col("value_normalized").alias("gtin"), F.col("product_id").alias("id"))
    keyed = collapsed.join(owners, "gtin", "left").withColumn("id", F.coalesce(F.col("id").cast("string"), F.sha2(F.concat(F.lit("gtin|"), "gtin"), 256)))
    new = keyed.select("id", *[F.col(c).alias(f"n_{c}") for c in ("title", "brand", "model", "variant_key", "attributes")])
    old = products.withColumn("id", F.col("id").cast("string"))
    empty = F.create_map().cast("map<string,string>")
    touched = F.col("n_title").isNotNull()
    merged = old.join(new, "id", "full").withColumns(
        {
            "title": F.coalesce("n_title", "title"),
            "brand": F.coalesce("n_brand", "brand"),
            "model": F.coalesce("n_model", "model"),
            "variant_key": F.coalesce("n_variant_key", "variant_key"),
            "attributes": F.map_concat(F.coalesce("attributes", empty), F.coalesce("n_attributes", empty)),
            "created_at": F.coalesce("created_at", now),
            "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
        }
    )
    return merged.select(*products.columns)


def upsert_listings(listings: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The listing table after a batch (canonical_product_id, item columns, decision, confidence, status, allow_reparent, seq).

    A listing of another product changes only where re-parenting is allowed. An
    empty SKU or title keeps the old one. Several rows of one listing: the last.
    Which row that is, is decided by ids alone and staged; whole rows are shuffled once, and only the columns that are read.
    """
    parts = ("store", "country", "product_id")
    own_id = F.substring(F.unhex(F.sha2(F.concat_ws("|", *parts, F.col("seq").cast("string")), 256)), 1, 16)
    given = "request_id" in incoming.columns
    keyed = incoming if given else incoming.withColumn("request_id", own_id)
    fresh_id = lambda prefix="": F.sha2(F.concat_ws("|", *[f"{prefix}{c}" for c in parts]), 256)

    def last() -> DataFrame:
        found = find_listings_in_turn(keyed, listings).select("request_id", "listing_id")
        rows = keyed.select("request_id", "seq", *parts).join(found, "request_id", "left")
        rows = rows.select(F.coalesce(F.col("listing_id").cast("string"), fresh_id()).alias("id"), "seq", "request_id", F.col("listing_id").isNotNull().alias("known"))
        return rows.groupBy("id").agg(F.max(F.struct("seq", "request_id", "known")).alias("last")).select("id", *[F.col(f"last.{c}").alias(f"__{c}") for c in ("seq", "request_id", "known")])

    rows = keyed.select([F.col(c).alias(f"n_{c}") for c in keyed.columns if c != "id"])
    same = F.col("__request_id").eqNullSafe(F.col("n_request_id"))
    if given:  # requests of one id, or of none, may be of several new listings; an id of our own is of one row's place in one listing
        new = settled(last).join(rows, same & F.col("__seq").eqNullSafe(F.col("n_seq"))).where(F.col("__known") | (F.col("id") == fresh_id("n_")))
    else:
        new = settled(lambda: last().select("id", "__request_id")).join(rows, same)
    # one of rows that repeat both, by an aggregate over what the next join is dealt by
    new = new.select("id", *rows.columns).dropDuplicates(["id"])
    joined = listings.withColumn("id", F.col("id").cast("string")).withColumn("__old", F.lit(True)).join(new, "id", "full")
    is_new = F.col("__old").isNull()
    same_parent = F.col("canonical_product_id") == F.col("n_canonical_product_id")
    change = F.col("n_store").isNotNull() & (is_new | same_parent | F.coalesce(F.col("n_allow_reparent"), F.lit(False)))
    out = {c: F.when(change, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("canonical_product_id", "product_id", "gtin", "url", "canonical_url", "confidence", "status", "store", "country")}
    out["match_decision"] = F.when(change, F.col("n_decision")).otherwise(F.col("match_decision"))
    out["sku"] = F.when(change, F.coalesce(blank_to_null(F.col("n_sku")), F.col("sku"))).otherwise(F.col("sku"))
    out["title"] = F.when(change, F.coalesce(blank_to_null(F.col("n_title")), F.col("title"))).otherwise(F.col("title"))
    kept = joined.withColumns({"__changed": change, **out}).withColumn("updated_at", F.when(F.col("__changed"), now).otherwise(F.col("updated_at") if "updated_at" in listings.columns else F.lit(None).cast("timestamp")))
    return kept.select(*listings.columns)


def new_rows(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of a batch whose key does not exist yet, the first of each key."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
    return first.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def new_gtins(identifiers_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Barcodes to attach (product_id, gtin, source, seq): none for products that have one, none owned elsewhere."""
    have = identifiers_table.where("type = 'gtin'")
    rows = wanted.withColumn("value_normalized", identifiers.gtin(F.col("gtin"))).where(F.col("value_normalized").isNotNull())
    free = rows.join(have.select("product_id").distinct(), "product_id", "left_anti").join(
        have.select("value_normalized").distinct(), "value_normalized", "left_anti"
    )
    # first one barcode per product, then one product per barcode
    one = free.groupBy("product_id").agg(F.min_by(F.struct("value_normalized", "source"), F.struct("seq", "value_normalized")).alias("r"))
    one = one.select("product_id", "r.*").groupBy("value_normalized").agg(F.min(F.struct("product_id", "source")).alias("r"))
    return one.select("r.product_id", F.lit("gtin").alias("type"), "value_normalized", "r.source")


# --- intake -----------------------------------------------------------------------------------


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with canonical links, validated barcode, country and an ``error`` where unusable."""
    code = identifiers.gtin(F.col("gtin"))
    store = blank_to_null(F.col("store"))
    identity = store.isNotNull() & blank_to_null(F.col("product_id")).isNotNull()
    error = F.when(blank_to_null(F.col("gtin")).isNotNull() & code.isNull(), "invalid_gtin").when(
        code.isNull() & ~identity, "missing_identity"
    )
    return requests.withColumns(
        {
            "url": urls.canonical(F.col("url")),
            "canonical_url": urls.canonical(F.col("canonical_url")),
            "country": F.when(store.isNotNull(), F.upper(F.coalesce("country", F.lit("BR")))),
            "error": error,
        }
    )


def intake(
    requests: DataFrame, products: DataFrame, identifiers_table: DataFrame, listings: DataFrame, snapshots_table: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """Register a batch of offers: rejects, resolutions, and the new rows of five tables.

    Ids of new rows derive from what they identify. Two new listings of one new
    product therefore share it, and running a batch again adds nothing.
    """
    checked = validate_requests(requests)
    good = checked.where(F.col("error").isNull())
    resolved = staged(resolve_products(good, products, identifiers_table, listings))
    described = staged(
        build_identities(
            spread(good.select("request_id", "title", "brand", "model", "variant", "category", "gtin", F.col("store"), "product_id"))
        ).select(
            "request_id", F.col("gtin").alias("v_gtin"), F.col("brand").alias("v_brand"), "model_key",
            F.col("variant_key").alias("v_variant"), F.col("category").alias("v_category"),
        )
    )
    rows = good.drop("category").join(resolved.withColumnsRenamed({"product_id": "resolved_id", "listing_id": "known_listing"}), "request_id").join(described, "request_id")
    rows = staged(rows)
    identity_key = F.coalesce(
        F.concat(F.lit("gtin|"), F.col("v_gtin")),
        F.when(F.col("v_brand").isNotNull() & F.col("model_key").isNotNull(), F.concat_ws("|", F.lit("model"), "v_brand", "model_key", F.coalesce("v_variant", F.lit("")))),
        F.concat_ws("|", F.lit("offer"), "store", "country", "product_id"),
    )
    new = F.col("kind") == "new_product"
    usable = F.col("kind").isin("new_product", "existing_product_new_listing", "existing_listing")
    rows = rows.withColumn("target_id", F.when(new, F.sha2(identity_key, 256)).otherwise(F.col("resolved_id").cast("string")))
    attach = usable & blank_to_null(F.col("store")).isNotNull() & blank_to_null(F.col("product_id")).isNotNull()
    link = F.coalesce("canonical_url", F.concat_ws("/", F.concat(F.lit("offer://"), "store"), "country", "product_id"))
    rows = rows.withColumns(
        {
            "new_listing_id": F.when(
                attach, F.coalesce(F.col("known_listing").cast("string"), F.sha2(F.concat_ws("|", "store", "country", "product_id"), 256))
            ),
            "link": link,
        }
    )
    created = new_rows(
        products.select(F.col("id").cast("string").alias("id")),
        rows.where(new).select(
            F.col("target_id").alias("id"), F.col("owner_user_id"), "title", "brand", "model",
            F.col("v_variant").alias("variant_key"), F.col("v_category").alias("category"), "request_id",
        ),
        ["id"], "request_id",
    )
    listing_rows = rows.where(attach & (F.col("kind") != "existing_listing")).select(
        F.col("new_listing_id").alias("id"), F.col("target_id").alias("canonical_product_id"), "store", "country", "product_id",
        blank_to_null(F.col("sku")).alias("sku"), F.col("v_gtin").alias("gtin"), F.coalesce("url", "link").alias("url"), F.col("link").alias("canonical_url"),
        "title", F.lit("auto_match").alias("match_decision"), F.lit(1).cast(CONFIDENCE).alias("confidence"),
        F.lit("active").alias("status"), "request_id",
    )
    new_listings = new_rows(listings.select(F.col("id").cast("string").alias("id")), listing_rows, ["id"], "request_id")
    codes = new_gtins(
        identifiers_table.withColumn("product_id", F.col("product_id").cast("string")),
        rows.where(usable & F.col("target_id").isNotNull()).select(F.col("target_id").alias("product_id"), "gtin", F.lit("product_register").alias("source"), F.col("request_id").alias("seq")),
    )
    amount = F.coalesce("price", "pix_price", "original_price")
    available = F.coalesce("available", F.lit(True))
    seeds = rows.where(attach & (F.col("kind") != "existing_listing") & amount.isNotNull()).select(
        F.col("new_listing_id").alias("listing_id"), amount.alias("price"), "pix_price", "original_price",
        F.upper(F.coalesce("currency", F.lit("BRL"))).alias("currency"), "seller", available.alias("available"),
        F.when(available, "available").otherwise("out_of_stock").alias("availability"), "store", "country", "product_id", "sku",
        F.coalesce("url", "link").alias("url"), F.col("link").alias("canonical_url"), "title",
        F.create_map(F.lit("source"), F.lit("product_register_preview")).alias("metadata"), now.alias("scraped_at"), "request_id",
    )
    seeds = new_rows(snapshots_table.select(F.col("listing_id").cast("string").alias("listing_id")), seeds, ["listing_id"], "request_id")
    shots = snapshots(seeds)
    events = shots.select(
        F.sha2(F.concat(F.lit("offer_created|"), "id"), 256).alias("id"), "listing_id", F.lit("offer_created").alias("event_type"),
        F.lit(None).cast(PAYLOAD).alias("before"),
        F.col("payload").withField("source", F.lit("product_register_preview")).alias("after"), F.col("scraped_at").alias("detected_at"),
    )
    return {
        "rejects": checked.where(F.col("error").isNotNull()).select("request_id", "error"),
        "resolutions": rows.select("request_id", "kind", "matched_by", F.col("target_id").alias("product_id"), F.col("new_listing_id").alias("listing_id"), "confidence"),
        "products": created.drop("request_id"),
        "listings": new_listings.drop("request_id"),
        "identifiers": codes,
        "snapshots": shots,
        "events": events,
    }


def apply_reviews(listings: DataFrame, decisions: DataFrame, snapshots_table: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Approve reviewed listings (listing_id, product_id, approved_by): new listing state, events, and errors.

    An already approved listing is left alone without an event; one that is not
    under review, or of another product, is an error.
    """
    asked = decisions.groupBy("listing_id").agg(F.min(F.struct("product_id", "approved_by")).alias("d"))
    joined = asked.join(listings.withColumnRenamed("id", "listing_id"), "listing_id", "left")
    missing = F.col("canonical_product_id").isNull() | (F.col("canonical_product_id") != F.col("d.product_id"))
    done = (F.col("status") == "active") & (F.col("match_decision") == "auto_match")
    open_ = (F.col("status") == "review") | (F.col("match_decision") == "review")
    outcome = F.when(missing, "review_offer_not_found").when(done, "already_approved").when(open_, "approved").otherwise("offer_not_reviewable")
    judged = joined.withColumn("outcome", outcome)
    approved = judged.where("outcome = 'approved'").select("listing_id", F.col("d.approved_by").alias("approved_by"), F.col("status").alias("old_status"), F.col("match_decision").alias("old_decision"))
    checked = latest_per_key(snapshots_table.select("listing_id", "scraped_at", "id"), ["listing_id"], ["scraped_at", "id"]).select(
        "listing_id", F.col("scraped_at").alias("checked_at")
    )
    state = listings.withColumnRenamed("id", "listing_id").join(approved.select("listing_id", F.lit(True).alias("__yes")), "listing_id", "left").join(checked, "listing_id", "left")
    yes = F.coalesce("__yes", F.lit(False))
    changed = state.withColumns(
        {
            "status": F.when(yes, "active").otherwise(F.col("status")),
            "match_decision": F.when(yes, "auto_match").otherwise(F.col("match_decision")),
        }
    )
    if "promotion_status" not in changed.columns:
        changed = changed.withColumns({"promotion_status": F.lit("none"), "promotion_expires_at": F.lit(None).cast("timestamp")})
    scheduled = initial_schedule(changed.where(yes), now).drop("__yes", "checked_at")
    events = approved.select(
        F.sha2(F.concat(F.lit("approved|"), F.col("listing_id").cast("string")), 256).alias("id"), "listing_id",
        F.lit("match_review_approved").alias("event_type"),
        F.struct(F.col("old_status").alias("status"), F.col("old_decision").alias("match_decision")).alias("before"),
        F.struct(F.lit("active").alias("status"), F.lit("auto_match").alias("match_decision"), "approved_by").alias("after"),
        now.alias("detected_at"),
    )
    return {"listings": scheduled, "events": events, "outcomes": judged.select("listing_id", "outcome")}


def match_outcome(
    references: DataFrame, hits: DataFrame, learned: DataFrame, products: DataFrame
) -> dict[str, DataFrame]:
    """What a finished match run writes, ready for the append and upsert operators.

    ``references``: ref_id (product id), identity columns, identity_only, url,
    scraped_at. ``hits``: ref_id, decision, confidence and the hit's offer
    columns. Rejects are left out; a product's brand and model fill only gaps.
    """
    rows = products.join(references.select(F.col("ref_id").alias("id"), F.col("brand").alias("__b"), F.col("model").alias("__m")), "id", "left")
    enriched = rows.withColumns({"brand": F.coalesce("brand", "__b"), "model": F.coalesce("model", "__m")}).select(*products.columns)
    kept = hits.where(F.col("decision") != "reject")
    upserts = kept.withColumns(
        {
            "canonical_product_id": F.col("ref_id"),
            "status": F.when(F.col("decision") == "review", "review").otherwise("active"),
            "allow_reparent": F.lit(True),
        }
    )
    codes = learned.select(F.col("ref_id").alias("product_id"), "gtin", "source", F.lit(0).alias("seq"))
    shown = references.where(~F.coalesce(F.col("identity_only"), F.lit(False)))
    learned_events = learned.where(F.col("source") != "reference").join(shown.select("ref_id", "listing_id", "scraped_at"), "ref_id").select(
        "listing_id", F.lit("gtin_learned").alias("event_type"), F.struct("gtin", "source").alias("after"), F.col("scraped_at").alias("detected_at")
    )
    return {"products": enriched, "listing_upserts": upserts, "gtins": codes, "events": learned_events}


# --- views ------------------------------------------------------------------------------------


def listing_view(listings: DataFrame, snapshots_table: DataFrame, rates: DataFrame, now: Column) -> DataFrame:
    """Current view of each listing: newest snapshot, condition, promotion flag and BRL price."""
    # of the payload only what the view shows goes along
    read = ("condition", "condition_grade", "carrier", "pix_price", "original_price")
    shots = snapshots_table.select(
        "listing_id", F.col("id").alias("snapshot_id"), "price", "currency", "seller", "availability", "available",
        *[F.col(f"payload.{c}").alias(f"__{c}") for c in read], "scraped_at",
    )
    shot = latest_per_key(shots, ["listing_id"], ["scraped_at", "snapshot_id"])
    rows = listings.withColumnRenamed("id", "listing_id").join(shot, "listing_id", "left")
    given = F.map_filter(
        F.create_map(F.lit("condition"), F.col("__condition"), F.lit("condition_grade"), F.col("__condition_grade"), F.lit("carrier"), F.col("__carrier")),
        lambda _, v: v.isNotNull(),
    )
    meta = commercial_metadata(F.col("title"), F.coalesce(given, F.create_map().cast("map<string,string>")))
    rows = rows.withColumns(
        {
            "pix_price": any_amount(F.col("__pix_price")),
            "original_price": any_amount(F.col("__original_price")),
            "condition": F.try_element_at(meta, F.lit("condition")),
            "condition_grade": F.try_element_at(meta, F.lit("condition_grade")),
            "carrier": F.try_element_at(meta, F.lit("carrier")),
            "promotion_commercially_active": promotion_in_force(now),
            "amount": F.col("price"),
        }
    )
    return fx.enrich(rows, rates).drop("amount", *[f"__{c}" for c in read])


def product_view(products: DataFrame, listings: DataFrame, identifiers_table: DataFrame, images: DataFrame) -> DataFrame:
    """Product with its barcodes, live listings and main image.

    Placeholder listings are left out. Barcodes come from the identifiers, or
    from the listings where there are none.
    """
    real = listings.where(~is_synthetic(F.col("store"), F.col("url"), F.col("product_id")))
    codes = identifiers_table.where("type = 'gtin'").groupBy(F.col("product_id").alias("id")).agg(
        F.array_sort(F.collect_set("value_normalized")).alias("__own")
    )
    offers = real.groupBy(F.col("canonical_product_id").alias("id")).agg(
        F.count("*").alias("listings"), F.array_sort(F.collect_set("gtin")).alias("__theirs"),
        F.array_sort(F.collect_set("store")).alias("stores"),
    )
    pictures = images.groupBy(F.col("product_id").alias("id")).agg(
        F.min_by(
            F.struct("display_url", "image_status"), F.struct((~F.col("is_main")).alias("m"), F.col("position"), F.col("created_at"))
        ).alias("__main")
    )
    rows = products.join(codes, "id", "left").join(offers, "id", "left").join(pictures, "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "gtins": F.coalesce("__own", "__theirs", none),
            "listings": F.coalesce("listings", F.lit(0).cast("long")),
            "primary_image_url": F.col("__main.display_url"),
            "primary_image_status": F.coalesce(F.col("__main.image_status"), F.lit("missing")),
        }
    ).drop("__own", "__theirs", "__main")


def duplicate_listings(listings: DataFrame, column: str = "product_id") -> DataFrame:
    """Keys (store, country, product_id or sku) that more than one listing has."""
    keys = ["store", "country", column]
    known = listings.where(blank_to_null(F.col(column)).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("listings")).where("listings > 1")
