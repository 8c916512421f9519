"""Registered queries over the catalog: matching, resolution, upserts, intake and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.patterns import literal_list
from ..functions.vectors import cosine
from ..operators import attributes, catalog, identity, matching
from ..schema import CONFIDENCE, MONEY, PAYLOAD, REASON
from ..sequences import KeyedSequence
from ..session import dealt
from .views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# --- phones: every part is an offer of one of 45 phones ----------------------------------------

COLORS_PT, COLORS_EN = ["Preto", "Azul", "Branco"], ["Black", "Blue", "White"]


def phone_columns() -> dict:
    key, size = F.col("p_partkey"), F.col("p_size")
    color = (size % 3).cast("int")
    return {
        "n": (key % 5 + 12).cast("string"),
        "gb": F.get(literal_list(["128", "256", "512"]), (F.floor(key / 5) % 3).cast("int")),
        "c": F.get(literal_list(["black", "blue", "white"]), color),
        "color": F.when(key % 2 == 0, F.get(literal_list(COLORS_PT), color)).otherwise(F.get(literal_list(COLORS_EN), color)),
    }


def phone_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("p_type") == "PROMO", " (Usado)").when(F.col("p_type") == "SMALL", " Renewed").otherwise("")
    key = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part").withColumns(phone_columns())
        .select(
            key.alias("cand_id"),
            F.concat(F.lit("Apple iPhone "), "n", F.lit(" Pro "), "gb", F.when(key % 2 == 0, " GB ").otherwise("GB "), "color", ending).alias("title"),
            F.when(key % 17 == 0, "Genérico").otherwise("Apple").alias("brand"),
            F.concat(F.lit("iPhone "), "n", F.lit(" Pro")).alias("model"),
            F.col("p_brand").alias("store"), F.lit("BR").alias("country"), key.cast("string").alias("product_id"),
            F.col("p_retailprice").cast(MONEY).alias("price"), F.lit("BRL").alias("currency"), "n", "gb", "c", F.col("p_type").alias("kind"),
        )
    )


def phone_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct phones of the offers, as canonical products."""
    rows = table(spark, sf_dir, "part").withColumns(phone_columns()).select("n", "gb", "c").distinct()
    return rows.select(
        F.concat_ws("|", "n", "gb", "c").alias("ref_id"),
        F.concat(F.lit("Apple iPhone "), "n", F.lit(" Pro "), "gb", F.lit("GB "), F.initcap("c")).alias("title"),
        F.lit("Apple").alias("brand"), F.concat(F.lit("iPhone "), "n", F.lit(" Pro")).alias("model"), "n", "gb", "c",
    )


PHONES_SQL = """
ph AS (
  SELECT p_partkey AS cand_id, p_partkey % 5 + 12 AS n, ([128, 256, 512])[p_partkey // 5 % 3 + 1] AS gb, (['black', 'blue', 'white'])[CAST(p_size % 3 AS INTEGER) + 1] AS c,
    p_type AS kind, p_brand AS store, p_partkey FROM part
),
ref AS (SELECT DISTINCT n, gb, c, CAST(n AS VARCHAR) || '|' || CAST(gb AS VARCHAR) || '|' || c AS ref_id FROM ph),
scored AS (
  SELECT ref.ref_id, ph.cand_id, ph.store, CASE WHEN ref.gb = ph.gb AND ref.c = ph.c AND ph.kind <> 'PROMO' THEN 'auto_match' ELSE 'reject' END AS decision,
    CAST(CASE WHEN ref.gb = ph.gb AND ref.c = ph.c AND ph.kind <> 'PROMO' THEN 0.92 ELSE 0 END AS DECIMAL(5,4)) AS confidence
  FROM ph JOIN ref ON ref.n = ph.n
)"""


def phone_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Identities of the canonical phones and of all offers."""
    return identity.build_sides(phone_products(spark, sf_dir).drop("n", "gb", "c"), phone_offers(spark, sf_dir).drop("n", "gb", "c", "kind"))


def phone_scores(spark: SparkSession, sf_dir: str, rejects: bool = True) -> DataFrame:
    offers = phone_offers(spark, sf_dir).drop("n", "gb", "c", "kind")
    return matching.match(phone_products(spark, sf_dir).drop("n", "gb", "c"), offers, rejects=rejects).select("ref_id", "cand_id", "score.*")


@query("er_candidates", "WITH " + PHONES_SQL + " SELECT ref_id, cand_id FROM scored")
def er_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, offers = phone_sides(spark, sf_dir)
    return matching.candidate_pairs(products, offers)


@query("er_score", "WITH " + PHONES_SQL + " SELECT ref_id, cand_id, decision, confidence FROM scored")
def er_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phone_scores(spark, sf_dir).select("ref_id", "cand_id", "decision", "confidence")


@query(
    "er_reasons",
    "WITH " + PHONES_SQL + """ SELECT code, count(*) AS pairs FROM (
      SELECT unnest(CASE WHEN ref.gb <> ph.gb OR ref.c <> ph.c THEN ['variant_mismatch'] WHEN ph.kind = 'PROMO' THEN ['condition_reject']
        WHEN ph.kind = 'SMALL' THEN ['offer_condition', 'brand_match', 'brand_model_exact', 'title_similarity']
        ELSE ['brand_match', 'brand_model_exact', 'title_similarity'] END) AS code
      FROM ph JOIN ref ON ref.n = ph.n) GROUP BY code""",
)
def er_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = phone_scores(spark, sf_dir).select(F.explode("reasons").alias("r")).select(F.col("r.code").alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("pairs"))


@query(
    "er_best",
    "WITH " + PHONES_SQL + """ SELECT ref_id, store, min(cand_id) AS cand_id, CAST(0.92 AS DECIMAL(5,4)) AS confidence FROM scored WHERE decision = 'auto_match' GROUP BY ALL""",
)
def er_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = phone_scores(spark, sf_dir, rejects=False)
    offers = phone_offers(spark, sf_dir).select("cand_id", "store")
    hits = scores.join(offers, "cand_id").select("ref_id", "store", "cand_id", "confidence", F.col("cand_id").alias("seq"))
    return matching.best_per_store(hits).select("ref_id", "store", "cand_id", "confidence")


@query(
    "er_best_product",
    "WITH " + PHONES_SQL + """ SELECT cand_id, ref_id, CASE WHEN cand_id % 10 = 0 THEN 'review' ELSE 'auto_match' END AS decision, confidence
    FROM scored WHERE decision = 'auto_match'""",
)
def er_best_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = phone_scores(spark, sf_dir, rejects=False).withColumn("same_store", F.col("cand_id") % 10 == 0)
    return matching.best_product(scores.drop("reasons")).select("cand_id", "ref_id", "decision", "confidence")


@query(
    "er_blocks",
    "WITH " + PHONES_SQL + """ SELECT 'model' AS kind, 'apple|iphone' || CAST(n AS VARCHAR) || 'pro' AS key, refs, cands, refs * cands AS pairs
    FROM (SELECT n, count(*) AS cands FROM ph GROUP BY n) JOIN (SELECT n, count(*) AS refs FROM ref GROUP BY n) USING (n)""",
)
def er_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, offers = phone_sides(spark, sf_dir)
    return matching.block_report(products, offers).select("kind", "key", "refs", "cands", "pairs")


@query(
    "title_prefilter",
    "WITH " + PHONES_SQL + """ SELECT reason, count(*) AS pairs FROM (SELECT CASE WHEN ph.kind = 'PROMO' THEN 'condition_mismatch:new!=used'
        WHEN ref.gb <> ph.gb THEN 'storage_mismatch' END AS reason FROM ph JOIN ref ON ref.n = ph.n) GROUP BY reason""",
)
def title_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, offers = phone_sides(spark, sf_dir)
    pairs = matching.candidate_pairs(products, offers)
    # offers first: the pairs are dealt by offer while they are two ids, and not with a product's facts in each
    sides = pairs.join(offers.select("cand_id", identity.identity_struct().alias("cand")), "cand_id").join(
        products.select("ref_id", identity.identity_struct().alias("ref")), "ref_id"
    )
    reason = F.regexp_replace("reject_reason", "^(storage_mismatch):.*$", "$1")
    return matching.title_prefilter(sides).groupBy(reason.alias("reason")).agg(F.count("*").alias("pairs"))


@query(
    "embedding_texts",
    "WITH " + PHONES_SQL + """ SELECT cand_id, 'category: smartphone' || chr(10) || 'brand: apple' || chr(10) || 'model: iphone' || CAST(n AS VARCHAR) || 'pro' || chr(10) ||
      'variant_color: ' || CASE WHEN cand_id % 2 = 0 THEN CASE c WHEN 'black' THEN 'preto' WHEN 'blue' THEN 'azul' ELSE 'branco' END ELSE c END || chr(10) ||
      'variant_storage: ' || CAST(gb AS VARCHAR) || 'gb' AS text_structured FROM ph""",
)
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.embedding_texts(phone_sides(spark, sf_dir)[1]).select("cand_id", "text_structured")


@query("search_queries")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phone_sides(spark, sf_dir)[0]
    asked = identity.search_queries(rows, ["pt-BR", "en-US", "es-PY"])
    return asked.select("ref_id", "locale", F.posexplode("queries").alias("position", "query"))


# --- barcodes ---------------------------------------------------------------------------------

GOOD_CODES = ["7891991010863", "0036000291452"]


@query(
    "gtin_consensus",
    """WITH h AS (SELECT l_orderkey AS ref_id, l_linenumber AS seq, CASE WHEN l_partkey % 7 = 0 THEN '0036000291452' WHEN l_partkey % 11 = 0 THEN '123' ELSE '7891991010863' END AS g,
        l_returnflag, 'store-' || CAST(l_suppkey % 9 AS VARCHAR) AS store, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
    s AS (SELECT ref_id, g, 'auto_match:' || store AS source, l_partkey * 1000000 + l_suppkey AS place FROM h
        WHERE l_returnflag = 'A' AND g <> '123'
      UNION ALL SELECT o_orderkey, '7891991010863', 'reference', 4611686018427387904 FROM orders WHERE o_orderkey % 5 = 0)
    SELECT ref_id, min(g) AS gtin, arg_min(source, place) AS source FROM s GROUP BY ref_id HAVING count(DISTINCT g) = 1""",
)
def gtin_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ref_id"),
        F.concat(F.lit("store-"), (F.col("l_suppkey") % 9).cast("string")).alias("store"),
        F.when(F.col("l_returnflag") == "A", "auto_match").when(F.col("l_returnflag") == "N", "review").otherwise("reject").alias("decision"),
        F.when(F.col("l_partkey") % 7 == 0, "036000291452").when(F.col("l_partkey") % 11 == 0, "123").otherwise("789-1991010863").alias("gtin"),
        F.lit("Acme Corp").alias("brand"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"),
    )
    refs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ref_id"), F.when(F.col("o_orderkey") % 5 == 0, "7891991010863").alias("gtin"), F.lit("acme").alias("brand")
    )
    return matching.gtin_consensus(refs, hits)


def phone_gtin() -> Column:
    """A valid barcode for each phone: twelve digits from its number, size and colour, and the check digit."""
    colour = F.when(F.col("c") == "black", "1").when(F.col("c") == "blue", "2").otherwise("3")
    body = F.concat(F.lit("78910"), F.col("n"), F.col("gb"), colour, F.lit("0"))
    digits = [F.substring(body, k + 1, 1).cast("int") * (3 if k % 2 else 1) for k in range(12)]
    return F.concat(body, F.pmod(-sum(digits[1:], digits[0]), F.lit(10)).cast("string"))


@query(
    "gtin_second_pass",
    "WITH " + PHONES_SQL + """,
    o AS (SELECT *, p_partkey % 6 = 1 AS opaque, p_partkey % 4 = 0 AS coded FROM ph),
    learned AS (SELECT DISTINCT n, gb, c, true AS known FROM o WHERE NOT opaque AND coded AND kind <> 'PROMO')
    SELECT ref.ref_id, o.cand_id, 'auto_match' AS decision, CAST(CASE WHEN l.known AND (opaque OR coded) THEN 0.99 ELSE 0.92 END AS DECIMAL(5,4)) AS confidence
    FROM o JOIN ref ON ref.n = o.n AND ref.gb = o.gb AND ref.c = o.c LEFT JOIN learned l ON l.n = o.n AND l.gb = o.gb AND l.c = o.c
    WHERE CASE WHEN opaque THEN l.known ELSE kind <> 'PROMO' END""",
)
def gtin_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixth of all offers name only their brand and a barcode, which the products learn from the others."""
    key = F.col("cand_id")
    opaque, coded = key % 6 == 1, key % 4 == 0
    offers = phone_offers(spark, sf_dir).withColumns(
        {
            "gtin": F.when(opaque | coded, phone_gtin()), "title": F.when(opaque, F.concat(F.lit("Oferta "), key.cast("string"))).otherwise(F.col("title")),
            "brand": F.when(opaque, "Apple").otherwise(F.col("brand")), "model": F.when(~opaque, F.col("model")),
        }
    ).drop("n", "gb", "c", "kind")
    found = matching.match_and_learn(phone_products(spark, sf_dir).drop("n", "gb", "c"), offers)
    return found.select("ref_id", "cand_id", "score.decision", "score.confidence")


# --- vectors ----------------------------------------------------------------------------------


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one before it of the same label and of the whole sequence of its hundred."""
    rows = table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 10))
    paired = KeyedSequence(rows, ["block"], ["vec_id"]).carry(
        {"left": F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("l"))}
    ).result()
    return paired.where(F.col("left").isNotNull()).select(
        F.col("left.id").alias("left_id"), F.col("vec_id").alias("right_id"), F.col("left.l").alias("left_label"), "label",
        F.col("left.v").alias("left_v"), F.col("embedding").alias("right_v"),
    )


PAIRS_SQL = """
vp AS (SELECT lag(vec_id) OVER w AS left_id, vec_id AS right_id, lag(label) OVER w AS left_label, label, lag(embedding) OVER w AS lv, embedding AS rv
  FROM embeddings WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id)),
sim AS (SELECT *, list_sum(list_transform(range(1, len(lv) + 1), lambda i: CAST(lv[i] AS DOUBLE) * CAST(rv[i] AS DOUBLE)))
    / (sqrt(list_sum(list_transform(lv, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(rv, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS s
  FROM vp WHERE left_id IS NOT NULL)"""


@query("cosine_pairs", "WITH " + PAIRS_SQL + " SELECT left_id, right_id, CAST(round(s, 5) AS DECIMAL(9,5)) AS similarity FROM sim")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = F.round(cosine(F.col("left_v"), F.col("right_v")), 5).cast("decimal(9,5)")
    return vector_pairs(spark, sf_dir).select("left_id", "right_id", similarity.alias("similarity"))


@query(
    "embedding_promote",
    "WITH " + PAIRS_SQL + """
    SELECT left_id, right_id, 'ok' AS evidence_status, CASE WHEN s >= 0.05 AND right_id % 5 <> 0 THEN 'auto_match' ELSE 'review' END AS decision FROM sim WHERE right_id % 3 <> 0
    UNION ALL SELECT left_id, right_id, NULL, 'auto_match' FROM sim WHERE right_id % 3 = 0""",
)
def embedding_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = lambda code: F.struct(F.lit(code).alias("code"), F.lit("").alias("detail"), F.lit(1).cast("decimal(6,4)").alias("score")).cast(REASON)
    unclear = F.struct(
        F.lit("review").alias("decision"), F.lit("0.89").cast(CONFIDENCE).alias("confidence"),
        F.array(reason("brand_model_exact"), reason("variant_semantic_uncertain")).alias("reasons"),
    )
    sure = F.struct(F.lit("auto_match").alias("decision"), F.lit("0.92").cast(CONFIDENCE).alias("confidence"), F.array(reason("brand_model_exact")).alias("reasons"))
    pairs = vector_pairs(spark, sf_dir)
    scored = pairs.select(
        F.floor(F.col("right_id") / 10).alias("run_id"), F.col("right_id").alias("seq"), F.col("left_id").alias("ref_text_key"), F.col("right_id").alias("cand_text_key"),
        (F.col("right_id") % 5 == 0).alias("prices_apart"), F.when(F.col("right_id") % 3 != 0, unclear).otherwise(sure).alias("score"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("text_key"), F.col("embedding").alias("vector"))
    done = matching.semantic_evidence(scored, vectors, 0.05)
    return done.select(
        F.col("ref_text_key").alias("left_id"), F.col("cand_text_key").alias("right_id"), "evidence_status", F.col("score.decision").alias("decision")
    )


# --- tables of the catalog --------------------------------------------------------------------


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"),
        F.when(key % 3 != 0, F.concat(F.lit("user-"), (key % 7).cast("string"))).alias("owner_user_id"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.when(key % 4 != 0, F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit("-"), (key % 50).cast("string"))).alias("model"),
        F.concat(F.lit("edition="), F.col("p_type")).alias("variant_key"),
        F.create_map(F.lit("category"), F.lower("p_type"), F.lit("storage"), F.concat(F.col("p_size").cast("string"), F.lit("gb"))).alias("attributes"),
        F.timestamp_seconds(F.lit(1704067200) + key).alias("created_at"), F.timestamp_seconds(F.lit(1704067200) + key % 1000).alias("updated_at"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as store listings: one per supplier and part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
    # nearly every line is a listing of its own, so combining before the shuffle saves nothing and fills memory
    rows = dealt(lines, lines.count(), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_linestatus").alias("st"), F.count("*").alias("seen")
    )
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return rows.select(
        F.concat_ws("-", part, supp).alias("id"), part.alias("canonical_product_id"), F.concat(F.lit("store"), supp).alias("store"),
        F.lit("BR").alias("country"), F.concat(F.lit("P"), part).alias("product_id"), F.concat(F.lit("SKU"), (F.col("l_partkey") % 500).cast("string")).alias("sku"),
        F.lit(None).cast("string").alias("gtin"), F.concat(F.lit("https://s"), supp, F.lit(".example/item/"), part).alias("url"),
        F.concat(F.lit("https://s"), supp, F.lit(".example/item/"), part).alias("canonical_url"), F.lit("item").alias("title"),
        F.when(F.col("seen") > 1, "review").otherwise("auto_match").alias("match_decision"), F.lit(1).cast(CONFIDENCE).alias("confidence"),
        F.when(F.col("st") == "F", "active").otherwise("review").alias("status"),
    )


LISTINGS_SQL = """
lst AS (SELECT l_partkey, l_suppkey, min(l_linestatus) AS st, count(*) AS seen, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS id FROM lineitem GROUP BY 1, 2)"""


@query(
    "listing_lookup",
    "WITH " + LISTINGS_SQL + """, o AS (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM part) AS pk, o_orderkey % (SELECT count(*) FROM supplier) AS sk FROM orders),
    sku AS (SELECT l_suppkey, l_partkey % 500 AS sku, min(id) AS id FROM lst GROUP BY 1, 2)
    SELECT o.o_orderkey AS request_id, coalesce(lst.id, sku.id) AS listing_id, CASE WHEN lst.id IS NOT NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END ELSE 3 END AS found_by
    FROM o LEFT JOIN lst ON lst.l_partkey = o.pk AND lst.l_suppkey = o.sk LEFT JOIN sku ON sku.l_suppkey = o.sk AND sku.sku = o.pk % 500
    WHERE lst.id IS NOT NULL OR sku.id IS NOT NULL""",
)
def listing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    rows = table(spark, sf_dir, "orders").withColumns({"pk": F.col("o_custkey") % parts, "sk": F.col("o_orderkey") % suppliers})
    pk, sk = F.col("pk").cast("string"), F.col("sk").cast("string")
    incoming = rows.select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("store"), sk).alias("store"), F.lit("BR").alias("country"),
        F.concat(F.lit("P"), pk).alias("product_id"), F.concat(F.lit("SKU"), (F.col("pk") % 500).cast("string")).alias("sku"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("HTTPS://S"), sk, F.lit(".example/item/"), pk, F.lit("/?utm_source=x#top"))).alias("canonical_url"),
    )
    return catalog.find_listings(incoming, listings(spark, sf_dir)).select("request_id", "listing_id", "found_by")


@query("dup_keys", "WITH " + LISTINGS_SQL + """ SELECT 'store' || CAST(l_suppkey AS VARCHAR) AS store, 'SKU' || CAST(l_partkey % 500 AS VARCHAR) AS sku, count(*) AS listings
    FROM lst GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_listings(listings(spark, sf_dir), "sku").select("store", "sku", "listings")


@query(
    "product_search",
    """SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_brand = 'Brand#7' AND lower(p_type) = 'economy' AND (p_partkey % 3 = 0 OR p_partkey % 7 = 2)
    ORDER BY p_partkey % 1000 DESC, CAST(p_partkey AS VARCHAR) LIMIT 100""",
)
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search_products(products(spark, sf_dir), "user-2", brand="BRAND 7", variant="Economy", category="economy", limit=100)
    return found.select("id")


@query(
    "product_page",
    """SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 7 = 2 ORDER BY p_partkey % 1000 DESC, CAST(p_partkey AS VARCHAR) LIMIT 30 OFFSET 60""",
)
def product_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.product_page(products(spark, sf_dir), "user-2", 30, 60).select("id")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes of every product whose key gives a valid one."""
    from ..functions.identifiers import gtin

    code = gtin((F.lit(7890000000000) + F.col("p_partkey") * 31).cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.lit("gtin").alias("type"), code.alias("value_normalized")
    ).where(F.col("value_normalized").isNotNull())


CODE_OK = """list_sum(list_transform(range(1, 15), lambda i: CAST(substr(lpad(CAST(7890000000000 + {0} * 31 AS VARCHAR), 14, '0'), i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0"""


@query(
    "product_view",
    "WITH " + LISTINGS_SQL + f""", l AS (SELECT l_partkey, count(*) AS n FROM lst GROUP BY 1)
    SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(l.n, 0) AS listings,
      CASE WHEN {CODE_OK.format('p_partkey')} THEN CAST(7890000000000 + p_partkey * 31 AS VARCHAR) ELSE '' END AS gtins, 'missing' AS primary_image_status
    FROM part LEFT JOIN l ON l.l_partkey = p_partkey""",
)
def product_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "product_id string, display_url string, image_status string, is_main boolean, position int, created_at timestamp")
    seen = catalog.product_view(products(spark, sf_dir), listings(spark, sf_dir), codes(spark, sf_dir), none)
    return seen.select("id", "listings", F.array_join("gtins", ",").alias("gtins"), "primary_image_status")


@query(
    "upsert_products",
    f"""WITH b AS (SELECT p_partkey, l_orderkey, l_linenumber, l_returnflag, l_extendedprice, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {CODE_OK.format('p_partkey')}),
    n AS (SELECT p_partkey, max(l_orderkey * 10 + l_linenumber) AS last_seq, arg_max('new ' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), l_orderkey * 10 + l_linenumber) AS title,
      arg_max(CASE WHEN l_returnflag = 'A' THEN 'B' || CAST(l_orderkey AS VARCHAR) END, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'A') AS brand FROM b GROUP BY 1)
    SELECT CAST(p.p_partkey AS VARCHAR) AS id, coalesce(n.title, p.p_name) AS title, coalesce(n.brand, p.p_brand) AS brand, lower(p.p_type) AS category,
      n.p_partkey IS NOT NULL AS touched FROM part p LEFT JOIN n USING (p_partkey)""",
)
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    batch = table(spark, sf_dir, "lineitem").select(
        (F.lit(7890000000000) + F.col("l_partkey") * 31).cast("string").alias("gtin"), seq.alias("seq"),
        F.concat(F.lit("new "), seq.cast("string")).alias("title"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("B"), F.col("l_orderkey").cast("string"))).alias("brand"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("variant_key"),
        F.create_map(F.lit("seen"), seq.cast("string")).alias("attributes"),
    )
    after = catalog.upsert_products(products(spark, sf_dir), codes(spark, sf_dir), batch, now())
    return after.select("id", "title", "brand", F.col("attributes")["category"].alias("category"), (F.col("updated_at") == now()).alias("touched"))


@query(
    "upsert_listings",
    "WITH " + LISTINGS_SQL + """, b AS (SELECT l_partkey, l_suppkey, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT lst.id, CASE WHEN b.seq % 3 = 0 THEN 'moved' ELSE CAST(lst.l_partkey AS VARCHAR) END AS canonical_product_id,
      CASE WHEN b.seq IS NOT NULL AND NOT (b.seq % 3 = 1) THEN 'review' ELSE CASE WHEN st = 'F' THEN 'active' ELSE 'review' END END AS status
    FROM lst LEFT JOIN b USING (l_partkey, l_suppkey)""",
)
def upsert_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that re-parents a third of its rows with leave, a third without, and updates the rest."""
    last = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(
        F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    third = F.col("seq") % 3
    link = F.concat(F.lit("https://s"), supp, F.lit(".example/item/"), part)
    batch = last.select(
        F.when(third == 2, part).otherwise("moved").alias("canonical_product_id"), F.concat(F.lit("store"), supp).alias("store"),
        F.lit("BR").alias("country"), F.concat(F.lit("P"), part).alias("product_id"), F.lit("").alias("sku"), F.lit(None).cast("string").alias("gtin"),
        link.alias("url"), link.alias("canonical_url"), F.lit(None).cast("string").alias("title"), F.lit("review").alias("decision"),
        F.lit("0.8").cast(CONFIDENCE).alias("confidence"), F.lit("review").alias("status"), (third == 0).alias("allow_reparent"), "seq",
    )
    return catalog.upsert_listings(listings(spark, sf_dir), batch, now()).select("id", "canonical_product_id", "status")


@query(
    "attach_gtins",
    f"""WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_partkey FROM part WHERE NOT {CODE_OK.format('p_partkey')})
    SELECT min(product_id) AS product_id, CAST(7890000000000 + (p_partkey // 100 + 1000000) * 31 AS VARCHAR) AS value_normalized FROM w
    WHERE {CODE_OK.format('(p_partkey // 100 + 1000000)')} GROUP BY 2""",
)
def attach_gtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        (F.lit(7890000000000) + (F.floor(F.col("p_partkey") / 100) + 1000000) * 31).cast("string").alias("gtin"),
        F.lit("match").alias("source"), F.col("p_partkey").alias("seq"),
    )
    return catalog.new_gtins(codes(spark, sf_dir), wanted).select("product_id", "value_normalized")


# --- resolution and intake --------------------------------------------------------------------


def phone_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phone offer as an incoming registration; some ask for a product, some to create one."""
    key = F.col("cand_id")
    return phone_offers(spark, sf_dir).select(
        key.cast("string").alias("request_id"), "store", "country", "product_id", F.lit(None).cast("string").alias("sku"),
        F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("url"),
        F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("canonical_url"), "title", "brand", "model",
        F.lit(None).cast("string").alias("variant"), F.lit("smartphone").alias("category"),
        F.when(key % 19 == 0, "7891991010863").alias("gtin"),
        F.when(key % 23 == 0, F.lit("12|128|black")).alias("target_product_id"), (key % 29 == 0).alias("create_new_product"),
        F.lit("user-1").alias("viewer_id"), F.lit(False).alias("is_admin"), F.lit("user-1").alias("owner_user_id"),
        "price", F.lit(None).cast(MONEY).alias("pix_price"), F.lit(None).cast(MONEY).alias("original_price"), "currency",
        F.lit("Seller").alias("seller"), F.lit(True).alias("available"),
    )


def phone_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical phones, the one barcode, and a listing for every thirteenth offer."""
    phones = phone_products(spark, sf_dir).select(
        F.col("ref_id").alias("id"), F.when(F.col("c") == "white", "user-9").alias("owner_user_id"), "title", "brand", "model",
        F.lit(None).cast("string").alias("variant_key"), F.create_map(F.lit("category"), F.lit("smartphone")).alias("attributes"),
        now().alias("created_at"), now().alias("updated_at"),
    )
    barcode = phones.where("id = '13|256|blue'").select(F.col("id").alias("product_id"), F.lit("gtin").alias("type"), F.lit("7891991010863").alias("value_normalized"))
    key = F.col("cand_id")
    known = phone_offers(spark, sf_dir).where(key % 13 == 0).select(
        F.concat(F.lit("L"), key.cast("string")).alias("id"), F.concat_ws("|", "n", "gb", "c").alias("canonical_product_id"), "store", "country", "product_id",
        F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("gtin"),
        F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("url"), F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("canonical_url"),
        "title", F.lit("auto_match").alias("match_decision"), F.lit(1).cast(CONFIDENCE).alias("confidence"), F.lit("removed").alias("status"),
    )
    return phones, barcode, known


RESOLVE_SQL = PHONES_SQL + """,
own AS (SELECT *, CAST(n AS VARCHAR) || '|' || CAST(gb AS VARCHAR) || '|' || c AS same_id FROM ph),
hasref AS (SELECT count(*) AS k FROM ref WHERE ref_id = '13|256|blue'),
res AS (
  SELECT CAST(cand_id AS VARCHAR) AS request_id, cand_id, same_id, n, gb, c, store,
    CASE WHEN cand_id % 13 = 0 THEN 'store_identity' WHEN cand_id % 19 = 0 THEN 'gtin' WHEN cand_id % 23 = 0 THEN 'user_confirmed'
      WHEN cand_id % 29 = 0 THEN NULL WHEN kind <> 'PROMO' AND c <> 'white' THEN 'identity' END AS matched_by,
    CASE WHEN cand_id % 13 = 0 THEN same_id WHEN cand_id % 19 = 0 THEN '13|256|blue' WHEN cand_id % 23 = 0 THEN '12|128|black'
      WHEN cand_id % 29 = 0 THEN NULL WHEN kind <> 'PROMO' AND c <> 'white' THEN same_id END AS product_id
  FROM own
),
kinds AS (SELECT *, CASE WHEN matched_by = 'store_identity' AND c = 'white' THEN 'forbidden'
    WHEN matched_by = 'store_identity' THEN 'existing_listing' WHEN matched_by = 'gtin' AND cand_id % 23 = 0 THEN 'identity_conflict'
    WHEN matched_by IN ('gtin', 'user_confirmed', 'identity') THEN 'existing_product_new_listing' ELSE 'new_product' END AS kind FROM res)"""


@query("resolve_products", "WITH " + RESOLVE_SQL + " SELECT request_id, kind, matched_by, product_id FROM kinds")
def resolve_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    phones, barcode, known = phone_tables(spark, sf_dir)
    done = catalog.resolve_products(phone_requests(spark, sf_dir), phones, barcode, known)
    return done.select("request_id", "kind", "matched_by", "product_id")


def run_intake(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    phones, barcode, known = phone_tables(spark, sf_dir)
    empty = spark.createDataFrame([], "listing_id string")
    return catalog.intake(phone_requests(spark, sf_dir), phones, barcode, known, empty, now())


@query(
    "intake_listings",
    "WITH " + RESOLVE_SQL + """ SELECT sha256(store || '|BR|' || request_id) AS id, CASE WHEN kind = 'new_product' THEN 'new' ELSE product_id END AS product
    FROM kinds WHERE kind IN ('new_product', 'existing_product_new_listing')""",
)
def intake_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_intake(spark, sf_dir)["listings"]
    return made.select("id", F.when(F.length("canonical_product_id") == 64, "new").otherwise(F.col("canonical_product_id")).alias("product"))


@query(
    "intake_products",
    "WITH " + RESOLVE_SQL + """, np AS (SELECT DISTINCT n, gb, c FROM kinds WHERE kind = 'new_product')
    SELECT n AS phone, count(*) AS products FROM np GROUP BY n""",
)
def intake_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_intake(spark, sf_dir)["products"]
    phone = F.regexp_extract("title", r"iPhone (\d+)", 1).cast("int")
    # several colour spellings of one phone are several variant keys; count the phones they stand for
    words = titles.variant_value("color", titles.color_in_title(F.lower("title")))
    return made.select(phone.alias("phone"), F.regexp_extract("title", r"(\d+) ?GB", 1).alias("gb"), words.alias("c")).distinct().groupBy("phone").agg(
        F.count("*").alias("products")
    )


@query(
    "review_approvals",
    "WITH " + LISTINGS_SQL + """ SELECT id AS listing_id, CASE WHEN l_suppkey % 10 = 0 THEN 'review_offer_not_found' WHEN st = 'F' AND seen = 1 THEN 'already_approved'
      ELSE 'approved' END AS outcome FROM lst""",
)
def review_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = listings(spark, sf_dir)
    supp = F.substring_index("id", "-", -1).cast("int")
    asked = known.select(
        F.col("id").alias("listing_id"), F.when(supp % 10 == 0, "other").otherwise(F.col("canonical_product_id")).alias("product_id"), F.lit("user-1").alias("approved_by")
    )
    shots = spark.createDataFrame([], "listing_id string, id string, scraped_at timestamp")
    return catalog.apply_reviews(known, asked, shots, now())["outcomes"]


@query(
    "listing_view",
    """SELECT l_suppkey % 3 AS currency_group, count(*) AS listings, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS total,
      count(*) FILTER (l_returnflag = 'A') AS used FROM (SELECT l_partkey, l_suppkey, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS l_extendedprice,
        arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    used = F.when(F.col("l_returnflag") == "A", "used")
    payload = F.struct(*[(used if f.name == "condition" else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields])
    shots = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("listing_id"), seq.cast("string").alias("id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"), F.element_at(literal_list(["BRL", "USD", "PYG"]), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("currency"),
        F.lit("s").alias("seller"), F.lit("available").alias("availability"), F.lit(True).alias("available"), payload.alias("payload"),
        F.timestamp_seconds(seq).alias("scraped_at"),
    )
    rates = spark.createDataFrame([], "base_currency string, quote_currency string, rate_type string, rate decimal(24,12), source string, fetched_at timestamp, status string")
    states = listings(spark, sf_dir).withColumns({"promotion_status": F.lit("none"), "promotion_expires_at": F.lit(None).cast("timestamp")})
    seen = catalog.listing_view(states, shots, rates, now())
    group = F.when(F.col("currency") == "BRL", 0).when(F.col("currency") == "USD", 1).otherwise(2).cast("long")
    return seen.groupBy(group.alias("currency_group")).agg(
        F.count("*").alias("listings"), F.sum("price").cast("decimal(38,4)").alias("total"), F.count_if(F.col("condition") == "used").alias("used")
    )


@query(
    "compose_items",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_name AS title, p_brand AS brand,
      CASE WHEN l_linenumber % 2 = 0 THEN 'offer' ELSE p_type END AS origin, p_size AS size FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def compose_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey").cast("string")
    offers = table(spark, sf_dir, "lineitem").select(
        F.lit("s").alias("store"), F.lit("BR").alias("country"), key.alias("product_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.lit(None).cast("string").alias("sku"),
        F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("origin"), F.lit("offer"))).otherwise(F.create_map(F.lit("line"), F.lit("x"))).alias("metadata"),
    )
    details = table(spark, sf_dir, "part").select(
        F.lit("s").alias("store"), F.lit("BR").alias("country"), F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"), F.lit("sku").alias("sku"),
        F.create_map(F.lit("origin"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("metadata"),
    )
    items = catalog.compose_items(offers, details)
    meta = F.col("metadata")
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "title", "brand", meta["origin"].alias("origin"), meta["size"].cast("int").alias("size")
    )


# --- attributes -------------------------------------------------------------------------------


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specification rows of every part in three sources with differing labels."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type")
    size = F.col("p_size").cast("string")
    entry = lambda pos, source, label, value: F.struct(F.lit(pos).alias("position"), F.lit(source).alias("source"), F.lit(label).alias("label"), value.alias("value"))
    odd = F.col("p_partkey") % 2 == 1
    entries = F.array(
        entry(0, "specifications", "Memória RAM", F.concat(size, F.lit("GB"))),
        entry(1, "specifications", "Cor", F.when(odd, F.upper("p_name")).otherwise("n/a")),
        entry(2, "structured", "Armazenamento", F.concat((F.col("p_size") * 10).cast("string"), F.lit(" gb"))),
        entry(3, "structured", "Color", F.col("p_name")),
        entry(4, "selected_variant", "Internal Storage", F.when(F.col("p_partkey") % 5 == 0, F.concat((F.col("p_size") * 20).cast("string"), F.lit("GB")))),
    )
    return rows.select(F.col("p_partkey").alias("product_id"), F.explode(entries).alias("e")).select("product_id", "e.*")


WANTED = ("storage", "ram", "color")


@query(
    "attribute_rank",
    """SELECT p_partkey AS product_id, unnest(['ram', 'storage', 'color']) AS attribute,
      unnest([CAST(p_size AS VARCHAR) || ' GB', CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size * 20 AS VARCHAR) || ' GB' ELSE CAST(p_size * 10 AS VARCHAR) || ' GB' END,
        CASE WHEN p_partkey % 2 = 1 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END]) AS value,
      unnest(['specifications', CASE WHEN p_partkey % 5 = 0 THEN 'selected_variant' ELSE 'structured' END, CASE WHEN p_partkey % 2 = 1 THEN 'specifications' ELSE 'structured' END]) AS source
    FROM part""",
)
def attribute_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.resolve(attributes.from_specifications(specifications(spark, sf_dir), WANTED))


@query(
    "attribute_conflicts",
    """SELECT p_partkey AS product_id, 'storage' AS attribute, 'selected_variant' AS winner_source, CAST(p_size * 20 AS VARCHAR) || ' GB' AS winner_value,
      'structured' AS other_source, CAST(p_size * 10 AS VARCHAR) || ' GB' AS other_value FROM part WHERE p_partkey % 5 = 0""",
)
def attribute_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attributes.conflicts(attributes.from_specifications(specifications(spark, sf_dir), WANTED))
    return found.select("product_id", "attribute", "winner_source", "winner_value", "other_source", "other_value")


@query(
    "category_identity",
    """SELECT p_partkey AS product_id, 'MSI' AS brand, 'GeForce RTX 50' || CAST((p_size % 3 + 6) * 10 AS VARCHAR) AS model, 'Ventus 2X' AS edition, 'Ventus 2X' AS variant FROM part""",
)
def category_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Placa de Vídeo MSI GeForce RTX 50"), ((F.col("p_size") % 3 + 6) * 10).cast("string"), F.lit(" Ventus 2X 8GB"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), title.alias("title"), F.lit("gpu").alias("category"))
    code = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.lit(0).alias("position"), F.lit("specifications").alias("source"), F.lit("Modelo").alias("label"), F.lit("912-V532-232").alias("value")
    )
    evidence = attributes.from_titles(rows).unionByName(attributes.from_specifications(code, ["model"]))
    wide = attributes.to_wide(attributes.resolve(evidence)).join(rows, "product_id")
    done = attributes.apply_category_identity(wide)
    get = lambda k: F.col("values")[k].alias(k)
    return done.select("product_id", get("brand"), get("model"), get("edition"), attributes.public_variant(F.col("values"), F.col("category")).alias("variant"))


