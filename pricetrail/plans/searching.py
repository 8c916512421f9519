"""Registered queries over search candidates, chosen listings and running barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.patterns import literal_list
from ..operators import candidates, fx
from . import rates
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


ASKED = ["Red Widget 16GB", "blue bolt", "small-ring/economy", "HOT gear, 32GB", "widget"]
HITS_SQL = """
h AS (SELECT p_size % 10 AS search, p_partkey AS seq, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) || 'GB' END AS title,
  '/produto/' || CAST(p_partkey AS VARCHAR) || '/' || replace(p_name, ' ', '-') AS path, (['red widget 16gb', 'blue bolt', 'small ring economy', 'hot gear 32gb', 'widget'])[CAST(p_size % 5 AS INTEGER) + 1] AS q FROM part),
f AS (SELECT *, lower(coalesce(title, replace(p, '-', ' '))) AS t FROM (SELECT *, CASE WHEN length(regexp_extract(path, '[^/]*$')) > 8 THEN regexp_extract(path, '[^/]*$') ELSE '' END AS p FROM h)),
k AS (SELECT *, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS tt, list_distinct(regexp_extract_all(t || ' ' || path, '[a-z0-9]+')) AS found, list_distinct(regexp_extract_all(q, '[a-z0-9]+')) AS asked,
  replace(q, ' ', '') AS whole, regexp_replace(t, '[^a-z0-9]', '', 'g') AS one FROM f)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as hits of ten searches; every eleventh has no title."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (F.col("p_size") % 10).alias("search"), key.alias("seq"),
        F.when(key % 11 != 0, F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit("GB"))).alias("title"),
        F.concat(F.lit("https://www.kabum.com.br/produto/"), key.cast("string"), F.lit("/"), F.translate("p_name", " ", "-"), F.lit("?keywords=red+widget+16gb")).alias("url"),
        F.get(literal_list(ASKED), (F.col("p_size") % 5).cast("int")).alias("q"),
    )


@query(
    "candidate_rank",
    "WITH " + HITS_SQL + """ SELECT search, seq, row_number() OVER (PARTITION BY search ORDER BY
      CASE WHEN length(whole) >= 8 AND (contains(one, whole) OR contains(regexp_replace(path, '[^a-z0-9]', '', 'g'), whole)) THEN 1 ELSE 0 END DESC,
      len(list_filter(asked, lambda a: a IN ('red', 'blue', '16gb', '32gb') AND list_contains(found, a))) DESC,
      len(list_intersect(asked, found)) DESC, least(length(t), 200) DESC, seq) AS rank FROM k""",
)
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.rank_for_query(hits(spark, sf_dir), F.col("q"), ["search"]).select("search", "seq", "rank")


@query(
    "candidate_aligned",
    "WITH " + HITS_SQL + """ SELECT search, seq, row_number() OVER (PARTITION BY search ORDER BY CASE WHEN search = 9 THEN 0 ELSE
      CASE WHEN list_contains(tt, 'blue') THEN 1 ELSE 0 END + CASE WHEN contains(one, 'blue') THEN 1 ELSE 0 END
      + CASE WHEN list_contains(tt, '32gb') THEN 1 ELSE 0 END + CASE WHEN contains(one, '32gb') THEN 1 ELSE 0 END END DESC, CASE WHEN search = 9 THEN 0 ELSE least(length(t), 200) END DESC, seq) AS rank FROM k""",
)
def candidate_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.col("search") != 9
    ranked = candidates.prefer_aligned(hits(spark, sf_dir), F.when(named, "Azul"), F.when(named, "32 GB"), ["search"])
    return ranked.select("search", "seq", "rank")


def place_of_line():
    """A number that orders the lines of an order; line numbers repeat."""
    return F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")


@query(
    "candidate_select",
    """WITH h AS (SELECT l_orderkey AS search, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS rank, l_suppkey % 2 = 0 AS amazon, l_partkey % 6 AS p, l_partkey % 4 AS u, l_orderkey % 4 AS own, l_partkey % 13 = 0 AS blank FROM lineitem),
    k AS (SELECT *, CASE WHEN amazon AND p > 0 THEN 'a' || CAST(p AS VARCHAR) WHEN NOT blank THEN 'u' || CASE WHEN amazon THEN 'z' ELSE 'k' END || CAST(u AS VARCHAR) END AS key FROM h
      WHERE blank OR amazon OR u <> own),
    f AS (SELECT search, key, min(rank) AS rank FROM k WHERE key IS NOT NULL GROUP BY ALL)
    SELECT * FROM (SELECT search, rank, row_number() OVER (PARTITION BY search ORDER BY rank) AS place FROM f) WHERE place <= 3""",
)
def candidate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    amazon = F.col("l_suppkey") % 2 == 0
    path = F.concat(F.lit("/item/"), (part % 4).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("search"), place_of_line().alias("rank"), F.when(amazon, "amazon_us").otherwise("kabum").alias("store"),
        F.when(part % 13 == 0, F.when(amazon & (part % 6 > 0), F.lit("https://www.amazon.com/x")).otherwise(" ")).otherwise(F.concat(F.when(amazon, "https://www.amazon.com").otherwise("https://kabum.com.br"), path)).alias("url"),
        F.when(part % 6 > 0, F.concat(F.lit("b"), (part % 6).cast("string"))).otherwise("").alias("product_id"),
    )
    own = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("search"), F.concat(F.lit("HTTPS://kabum.com.br/item/"), (F.col("o_orderkey") % 4).cast("string"), F.lit("/?utm_source=x")).alias("reference_url")
    )
    # keys are read before the rows are shuffled, which then leaves stores and product ids behind
    keyed = rows.withColumn("key", candidates.candidate_key(F.col("store"), F.col("product_id"), F.col("url")))
    others = candidates.without_reference(keyed, own, ["search"])
    chosen = candidates.first_of_each(others, ["search"], F.col("key"), limit=3, within=rows)
    return chosen.select("search", "rank", "place")


@query(
    "chosen_listings",
    """WITH l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS id FROM lineitem),
    r AS (SELECT o_orderkey AS request_id, o_orderkey % 3 AS k, o_custkey % 200 AS p, o_custkey % 5 AS s FROM orders)
    SELECT request_id, l.id FROM r JOIN l ON r.k = 0 AND l.id = CAST(r.p AS VARCHAR) || '-' || CAST(r.s AS VARCHAR)
    UNION ALL SELECT request_id, l.id FROM r JOIN l ON r.k = 1 AND l.p = r.p
    UNION ALL SELECT request_id, min(l.id) FROM r JOIN l ON r.k = 2 AND l.p = r.p AND l.s % 5 = r.s GROUP BY request_id""",
)
def chosen_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    listings = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"), text(F.col("l_partkey")).alias("canonical_product_id"),
        F.concat(F.lit("https://s"), text(F.col("l_suppkey") % 5), F.lit(".example/p/"), text(F.col("l_partkey"))).alias("canonical_url"),
    )
    kind, p, s = F.col("o_orderkey") % 3, text(F.col("o_custkey") % 200), text(F.col("o_custkey") % 5)
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.when(kind == 0, F.concat_ws("-", p, s)).alias("listing_id"), F.when(kind < 2, p).alias("product_id"),
        F.concat(F.lit("HTTPS://S"), s, F.lit(".example/p/"), p, F.lit("/?utm_campaign=a#x")).alias("url"),
    )
    return candidates.choose_listings(listings, requests).select("request_id", "id")


@query(
    "gtin_running",
    """WITH RECURSIVE h AS (SELECT l_orderkey AS ref_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq, 'store-' || CAST(l_suppkey % 9 AS VARCHAR) AS store, l_orderkey % 5 = 0 AS own,
        CASE WHEN l_returnflag = 'A' AND l_orderkey % 5 <> 0 THEN CASE WHEN l_partkey % 3 = 0 THEN '0036000291452' WHEN l_partkey % 11 = 0 THEN NULL ELSE '7891991010863' END END AS g,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS n FROM lineitem),
    w AS (SELECT ref_id, seq, n, own, g AS learned, CASE WHEN g IS NOT NULL THEN 'auto_match:' || store END AS learned_from FROM h WHERE n = 1
      UNION ALL SELECT h.ref_id, h.seq, h.n, h.own, CASE WHEN h.g IS NULL OR w.learned = h.g THEN w.learned WHEN w.learned IS NULL THEN h.g END,
        CASE WHEN h.g IS NULL OR w.learned = h.g THEN w.learned_from WHEN w.learned IS NULL THEN 'auto_match:' || h.store END FROM w JOIN h ON h.ref_id = w.ref_id AND h.n = w.n + 1)
    SELECT ref_id, seq, CASE WHEN own THEN '7891991010863' ELSE learned END AS learned, CASE WHEN own THEN 'reference' ELSE learned_from END AS learned_from FROM w""",
)
def gtin_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ref_id"), place_of_line().alias("seq"), F.concat(F.lit("store-"), (F.col("l_suppkey") % 9).cast("string")).alias("store"),
        F.when(F.col("l_returnflag") == "A", "auto_match").otherwise("review").alias("decision"),
        F.when(F.col("l_partkey") % 3 == 0, "036000291452").when(F.col("l_partkey") % 11 == 0, "123").otherwise("789-1991010863").alias("gtin"), F.lit("Acme Corp").alias("brand"),
    )
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.when(F.col("o_orderkey") % 5 == 0, "7891991010863").alias("gtin"), F.lit("acme").alias("brand"))
    return candidates.running_gtin(refs, seen).select("ref_id", "seq", "learned", "learned_from")


@query(
    "fx_of_pair",
    "WITH " + rates.QUOTES_SQL + """ SELECT 'base' AS asked, base_currency, quote_currency, rate_type, rate FROM latest WHERE base_currency = 'USD'
    UNION ALL SELECT 'pair', base_currency, quote_currency, rate_type, rate FROM latest WHERE base_currency = 'USD' AND quote_currency = 'PYG' UNION ALL SELECT 'all', base_currency, quote_currency, rate_type, rate FROM latest""",
)
def fx_of_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = fx.latest_rates(rates.quotes(spark, sf_dir), rates.ORDER)
    asked = {"base": ("USD", None), "pair": ("USD", "PYG"), "all": (None, None)}
    made = [fx.rates_of(latest, *pair).select(F.lit(name).alias("asked"), *fx.RATE_KEY, "rate") for name, pair in asked.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


HOSTS = ["www.nissei.com", "loja.nissei.com", "www.magazineluiza.com.br", "pt.aliexpress.com", "www.amazon.com.br", "amazon.com", "m.bestbuy.com", "produto.mercadolivre.com.br", "shoppingchina.com.py", "notamazon.com", "example.org"]


@query(
    "host_locale",
    """SELECT s_suppkey, (['es-PY', 'es-PY', 'pt-BR', 'pt-BR', 'pt-BR', 'en-US', 'en-US', 'pt-BR', 'pt-BR', NULL, NULL])[CAST(s_suppkey % 11 AS INTEGER) + 1] AS locale FROM supplier""",
)
def host_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    link = F.concat(F.lit("https://"), F.get(literal_list(HOSTS), (key % 11).cast("int")), F.lit("/p/"), key.cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", urls.locale(link).alias("locale"))
