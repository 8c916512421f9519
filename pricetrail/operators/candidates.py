"""Search candidates: ranking, repeats and the listings a refresh asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers, titles, urls
from ..functions.patterns import literal_list
from ..functions.text import blank_to_null, fold_key, words
from ..rules import catalog
from ..sequences import KeyedSequence
from ..session import dealt, spread, staged
from .matching import brands_compatible

# How long a compact query must be to count as a whole, and how much of a title's length counts.
WHOLE_QUERY_CHARS = 8
TITLE_WEIGHT = 200


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(words(text), " "), lambda t: t != ""))


def _ranked(rows: DataFrame, keys: list[str], seq: str, scores: dict[str, Column], helpers: list[str]) -> DataFrame:
    """Adds ``rank`` from one per key: larger scores first, then the order in which the rows came.

    Scores are staged, so that a sequence with cut keys reads them again instead of the titles. The ``helpers``, columns that only scores need, go.
    """
    order = {f"__{k}": -v for k, v in scores.items()}
    scored = staged(rows.withColumns(order).drop(*helpers))
    numbered = KeyedSequence(scored, keys, [*order, seq]).running({"rank": F.lit(1)}).result()
    return numbered.drop(*order)


def rank_for_query(candidates: DataFrame, query: Column, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rank the hits of each search (title, url): the whole query first, then its colours and sizes, its words, and longer titles.

    Words are looked for in the title and the path of the link; what follows the path may
    repeat the query and is left out. Nothing is dropped.
    """
    rows = spread(candidates).withColumns(
        {
            "__title": fold_key(titles.candidate_text(F.col("title"), F.col("url"))),
            "__path": F.coalesce(fold_key(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)), F.lit("")),
            "__asked": F.filter(_tokens(query), lambda t: F.length(t) >= 2),
            "__whole": F.regexp_replace(fold_key(query), "[^a-z0-9]", ""),
        }
    )
    rows = rows.withColumn("__found", F.array_union(_tokens(F.col("__title")), _tokens(F.col("__path"))))
    hues = [*catalog.COLORS, *catalog.HUES]
    special = F.filter("__asked", lambda t: t.rlike(r"^\d+[gt]b$") | t.isin(*[h for h in hues if " " not in h]))
    whole = F.col("__whole")
    in_one = lambda c: F.regexp_replace(c, "[^a-z0-9]", "").contains(whole)
    exact = (F.length(whole) >= WHOLE_QUERY_CHARS) & (in_one(F.col("__title")) | in_one(F.col("__path")))
    scores = {
        "exact": F.coalesce(exact, F.lit(False)).cast("int"),
        "special": F.size(F.array_intersect(special, "__found")),
        "hits": F.size(F.array_intersect("__asked", "__found")),
        "length": F.least(F.length("__title"), F.lit(TITLE_WEIGHT)),
    }
    return _ranked(rows, keys, seq, scores, ["__title", "__path", "__asked", "__whole", "__found"])


def prefer_aligned(candidates: DataFrame, color: Column, storage: Column, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rank the hits of each search by how often their titles name the reference's colour, in any of its words, and its storage.

    Without either the order stays.
    """
    # the colour's canonical name is read once a row, not once for each colour it is compared with
    asked = spread(candidates).withColumns({"__hue": titles.variant_value("color", color), "__size": fold_key(storage)})
    asked = asked.withColumn("__hues", F.split("__hue", " "))
    names, hues = (literal_list(side) for side in (catalog.COLORS, catalog.COLORS.values()))
    named = F.transform(F.arrays_zip(names.alias("name"), hues.alias("to")), lambda c: F.when(F.array_contains("__hues", c["to"]) | (F.col("__hue") == c["to"]), c["name"]))
    none = F.array().cast("array<string>")
    boost = F.concat(
        F.array(fold_key(color), *[F.get("__hues", F.lit(k)) for k in range(3)]),
        F.when(F.col("__hue").isNull(), none).otherwise(named),
        F.array("__size", F.regexp_replace("__size", r"\s+", "")),
    )
    rows = asked.withColumns(
        {
            "__title": fold_key(titles.candidate_text(F.col("title"), F.col("url"))),
            "__boost": F.array_distinct(F.filter(boost, lambda t: t.isNotNull() & (F.length(t) >= 2))),
        }
    )
    rows = rows.withColumn("__one", F.regexp_replace("__title", "[^a-z0-9]", ""))
    hits = F.size(F.array_intersect("__boost", _tokens(F.col("__title")))) + F.size(F.filter("__boost", lambda t: F.col("__one").contains(t)))
    none = F.size("__boost") == 0
    scores = {"hits": F.when(none, 0).otherwise(hits), "length": F.when(none, 0).otherwise(F.least(F.length("__title"), F.lit(TITLE_WEIGHT)))}
    return _ranked(rows, keys, seq, scores, ["__title", "__hue", "__size", "__hues", "__boost", "__one"])


def candidate_key(store: Column, product_id: Column, url: Column) -> Column:
    """What makes two hits of a store the same: the product id where the store's links name one, else the link. NULL: neither."""
    named = F.coalesce(urls.host(url).rlike(r"(^|\.)amazon\.[a-z.]+$"), F.lit(False))
    return F.coalesce(
        F.when(named, F.concat(store, F.lit(":"), F.upper(blank_to_null(product_id)))), blank_to_null(url)
    )


def first_of_each(
    candidates: DataFrame, keys: list[str], identity: Column, limit: int | None = None, order: str = "rank", within: DataFrame | None = None
) -> DataFrame:
    """The first hit of each search for every identity, in order, at most ``limit`` of a search; hits without one go.

    ``within``: a table with the keys and order of all candidates that is read to find hot searches, where it costs less than they do.
    Without a hot search one shuffle does all; with one, firsts are an aggregate that combines before its shuffle.
    """
    known = candidates.withColumn("__key", identity).dropna(subset=["__key", order, *keys])
    sequence = KeyedSequence(known, keys, [order], within=within)
    if sequence.cut:
        firsts = known.groupBy(*keys, "__key").agg(F.min(order).alias(order))
        sequence.df = sequence.df.join(firsts, [*keys, "__key", order], "left_semi")
    else:
        first = F.min(order).over(Window.partitionBy(*keys, "__key"))
        sequence.df = sequence.df.repartition(*keys).withColumn("__first", first).where(F.col(order) == F.col("__first")).drop("__first")
    numbered = sequence.running({"place": F.lit(1)}).result().drop("__key")
    return numbered if limit is None else numbered.where(F.col("place") <= limit)


def without_reference(candidates: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Hits that are not the reference itself: ``references`` has the keys and ``reference_url``."""
    own = references.select(*keys, urls.canonical(F.col("reference_url")).alias("__url")).distinct()
    return candidates.withColumn("__url", urls.canonical(F.col("url"))).join(own, [*keys, "__url"], "left_anti").drop("__url")


def choose_listings(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Listings that requests (request_id, listing_id, product_id, url) ask for, with ``request_id``.

    A request with a listing id means that listing, else one with a product all its listings,
    else one with a link the listing with that canonical link and the least id.
    """
    by_id = requests.where("listing_id is not null").select("request_id", F.col("listing_id").alias("id"))
    by_product = requests.where("listing_id is null and product_id is not null").select("request_id", F.col("product_id").alias("canonical_product_id"))
    by_url = requests.where("listing_id is null and product_id is null and url is not null").select("request_id", urls.canonical(F.col("url")).alias("canonical_url"))
    linked = by_url.join(listings.select("id", "canonical_url"), "canonical_url").groupBy("request_id", "canonical_url").agg(F.min("id").alias("id"))
    columns = ["request_id", *listings.columns]
    found = [by_id.join(listings, "id"), by_product.join(listings, "canonical_product_id"), linked.select("request_id", "id").join(listings, "id")]
    return found[0].select(columns).unionByName(found[1].select(columns)).unionByName(found[2].select(columns))


def running_gtin(references: DataFrame, hits: DataFrame, cut_rows: int | None = None) -> DataFrame:
    """The barcode known for a reference after each of its hits (ref_id, store, decision, gtin, brand, seq): ``learned``, ``learned_from``.

    The reference's own barcode stays. Else an automatic match of a compatible brand teaches its
    barcode; one with another barcode unlearns it, and the next may teach again.
    """
    own = references.select("ref_id", F.col("brand").alias("ref_brand"), identifiers.gtin(F.col("gtin")).alias("own_gtin"))
    # what a hit may teach is found before the join, so that rows are sorted without what only this needs
    code = F.when(F.col("decision") == "auto_match", identifiers.gtin(F.col("gtin")))
    taught = F.col("__code").isNotNull()
    told = hits.withColumn("__code", code).withColumns({"__maker": F.when(taught, identifiers.brand(F.col("brand"))), "__shop": F.when(taught, F.coalesce("store", F.lit("")))})
    count = hits.count()
    rows = dealt(told, count, "ref_id").join(dealt(own, count, "ref_id"), "ref_id")
    teaches = taught & brands_compatible(F.col("ref_brand"), F.col("__maker")) & F.col("own_gtin").isNull()
    rows = rows.withColumn("seen_gtin", F.when(F.coalesce(teaches, F.lit(False)), F.col("__code"))).drop("__code", "__maker", "ref_brand")

    seen = F.col("seen_gtin")
    rows = KeyedSequence(rows, ["ref_id"], ["seq"], cut_rows, within=hits).carry({"gtin_before": seen})
    again = F.coalesce(seen == F.col("gtin_before"), F.lit(False))
    # A barcode seen twice running is known whatever came before; after that every other one unlearns or teaches in turn.
    rows = rows.streak("turns", seen.isNotNull() & ~again, again).carry({"__again": F.when(again, F.lit(True)), "__gtin": seen}, inclusive=True)
    known = F.col("turns") % 2 == F.when(F.col("__again"), F.lit(0)).otherwise(F.lit(1))
    rows = rows.with_columns({"__known": known}).carry({"__known_before": F.when(seen.isNotNull(), F.col("__known"))})
    teaches = seen.isNotNull() & ~F.coalesce("__known_before", F.lit(False))
    rows = rows.carry({"__from": F.when(teaches, F.concat(F.lit("auto_match:"), "__shop"))}, inclusive=True)
    learned = {"learned": F.when(F.col("__known"), F.col("__gtin")), "learned_from": F.when(F.col("__known"), F.col("__from"))}
    found = rows.result().withColumns(learned).drop("gtin_before", "turns", "__again", "__gtin", "__known", "__known_before", "__from")
    fixed = F.col("own_gtin").isNotNull()
    return found.withColumns(
        {
            "learned": F.coalesce("own_gtin", "learned"),
            "learned_from": F.when(fixed, "reference").otherwise(F.col("learned_from")),
        }
    ).drop("own_gtin", "seen_gtin", "__shop")
