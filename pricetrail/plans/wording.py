"""Registered queries over text: links, identifiers, titles, units, dates and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, grammars, identifiers, models, redact, title_attributes, titles, units, urls
from ..functions.patterns import literal_list
from ..functions.text import fold_key, ordered_terms
from ..operators import changes, pages
from ..schema import S, struct
from ..session import spread, staged
from . import views
from .views import OBSERVATIONS_SQL, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# --- links ------------------------------------------------------------------------------------

CANONICAL_SQL = """
can AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS root,
    regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p LIKE '%=_%'
      AND NOT regexp_matches(lower(p), '^(ref|ref_|source|from|fbclid|gclid|spm|af|dp)=') AND NOT regexp_matches(lower(p), '^(utm_|gad_|cq_|matt_)')), '&') AS q
  FROM pages
),
canonical AS (SELECT page_id, url, root || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM can)"""


@query("canonical_url", "WITH " + CANONICAL_SQL + " SELECT page_id, canonical_url FROM canonical")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query(
    "url_dedup",
    "WITH " + CANONICAL_SQL + """ SELECT canonical_url, min(page_id) AS page_id, count(*) AS seen FROM canonical GROUP BY canonical_url""",
)
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.distinct_links(log, "page_id").select("canonical_url", "page_id", "seen")


@query(
    "host_store",
    """SELECT page_id, CASE WHEN h = 'spam-farm.example.org' THEN 'spam' WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 'org'
      WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'com' END AS store_key
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages)""",
)
def host_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame(
        [("example.com", "com"), ("example.org", "org"), ("spam-farm.example.org", "spam")], struct(("domain", S), ("store_key", S))
    )
    links = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.with_store(links, domains).select("page_id", "store_key")


@query(
    "url_titles",
    """SELECT page_id, trim(regexp_replace(replace(replace(seg, '-', ' '), '_', ' '), '\\s+', ' ', 'g')) AS title FROM (
      SELECT page_id, 'https://shop.example/' || regexp_extract(url, '://([^/?#]*)', 1) || '-best-price/p/' || CAST(page_id AS VARCHAR) AS u,
        regexp_extract(url, '://([^/?#]*)', 1) || '-best-price' AS seg FROM pages)""",
)
def url_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.concat(urls.host(F.col("url")), F.lit("-best-price"))
    link = F.concat(F.lit("https://shop.example/"), slug, F.lit("/p/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", titles.title_from_url(link).alias("title"))


@query(
    "fingerprint",
    "WITH " + OBSERVATIONS_SQL + """ SELECT observation_id, sha256('{"availability":"' || availability || '","currency":"' || currency || '","pix_price":'
      || coalesce('"' || CAST(pix_price AS VARCHAR) || '"', 'null') || ',"price":"' || CAST(price AS VARCHAR) || '","seller":"' || lower(trim(seller)) || '"}') AS fingerprint
    FROM obs""",
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    offer = F.struct("availability", "currency", "pix_price", "price", "seller")
    return views.observations(spark, sf_dir).select("observation_id", changes.fingerprint(offer).alias("fingerprint"))


@query(
    "redact",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(text || ' Bearer tok-' || CAST(doc_id AS VARCHAR) || ' https://u' || CAST(doc_id AS VARCHAR) || ':pw@host/x',
      '(?i)(Bearer\\s+)(\\S+)', '\\1***', 'g'), '://([^:/@]+):([^@/]+)@', '://\\1:***@', 'g')) AS digest FROM documents""",
)
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    text = F.concat("text", F.lit(" Bearer tok-"), key, F.lit(" https://u"), key, F.lit(":pw@host/x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact.text(text)).alias("digest"))


@query(
    "redact_map",
    """SELECT conv_id, turn, '***' AS api_key, CASE WHEN role = 'user' THEN 'Bearer ***' ELSE 'plain' END AS note,
      CASE WHEN role = 'user' THEN 'Erro sanitizado (detalhe omitido por segurança).' ELSE 'http 500 on page' END AS message FROM conversations""",
)
def redact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("role") == "user", F.lit("Bearer abc123")).otherwise("plain")
    raw = F.create_map(F.lit("api_key"), F.col("text"), F.lit("note"), note)
    message = F.when(F.col("role") == "user", F.lit("bad api-key given")).otherwise(F.lit("http  500\n on page"))
    rows = table(spark, sf_dir, "conversations").withColumn("m", redact.mapping(raw))
    return rows.select(
        "conv_id", "turn", F.col("m")["api_key"].alias("api_key"), F.col("m")["note"].alias("note"), redact.error_message(message).alias("message")
    )


# --- identifiers ------------------------------------------------------------------------------

CHECK_SQL = """list_sum(list_transform(range(1, 15), lambda i: CAST(substr({0}, i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0"""


@query(
    "gtin_check",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN {CHECK_SQL.format("lpad(d, 14, '0')")}
        THEN CASE WHEN length(d) = 12 THEN '0' || d ELSE d END END AS gtin
    FROM (SELECT *, CAST((CASE WHEN l_linenumber % 2 = 0 THEN 7890000000000 ELSE 100000000000 END) + l_orderkey * 997 + l_partkey * 31 + l_suppkey AS VARCHAR) AS d FROM lineitem)""",
)
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("l_linenumber") % 2 == 0, F.lit(7890000000000)).otherwise(F.lit(100000000000))
    raw = (base + F.col("l_orderkey") * 997 + F.col("l_partkey") * 31 + F.col("l_suppkey")).cast("string")
    dashed = F.concat(F.left(raw, F.lit(3)), F.lit("-"), F.substr(raw, F.lit(4)), F.lit(" "))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", identifiers.gtin(dashed).alias("gtin")
    )


@query(
    "brand_model_keys",
    """SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL ELSE lower(replace(p_brand, '#', ' ')) END AS brand,
      replace(p_name, ' ', '') || 'x' || CAST(p_size AS VARCHAR) AS model,
      replace(p_name, ' ', '') || 'x' || CAST(p_size AS VARCHAR) AS soft_model FROM part""",
)
def brand_model_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_size") == 1, "Genérico").otherwise(F.concat(F.lit(" "), "p_brand"))
    text = F.concat_ws("-", F.initcap("p_name"), F.concat(F.lit("X"), F.col("p_size").cast("string")))
    noisy = F.concat(identifiers.model(text), F.lit("notebookwindows11"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", identifiers.brand(brand).alias("brand"), identifiers.model(text).alias("model"), identifiers.soft_model(noisy).alias("soft_model")
    )


@query(
    "part_numbers",
    """SELECT p_partkey, 'mzv' || CAST(p_size % 10 AS VARCHAR) || 's1t0b' || CASE WHEN p_partkey % 2 = 0 THEN 'am' ELSE 'eu' END AS part_key,
      'MZ-V' || CAST(p_size % 10 AS VARCHAR) || 'S1T0B/' || CASE WHEN p_partkey % 2 = 0 THEN 'AM' ELSE 'EU' END AS display FROM part""",
)
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("MZ-V"), (F.col("p_size") % 10).cast("string"), F.lit("S1T0B/"), F.when(F.col("p_partkey") % 2 == 0, "AM").otherwise("EU"))
    text = F.concat_ws(" ", F.lit("SSD"), "p_name", code)
    first = F.get(identifiers.part_number_forms(fold_key(text)), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", first["key"].alias("part_key"), first["display"].alias("display"))


@query(
    "identifier_queries",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS identifier_only FROM part""",
)
def identifier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    code = F.concat(F.lit("rx76psw"), key.cast("string"))
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("7891991"), key.cast("string"))).when(key % 4 == 1, F.concat_ws(" ", F.lit("iphone"), F.lit("16")))
        .when(key % 4 == 2, F.concat_ws(" ", F.lit("acme"), code)).otherwise(F.concat_ws(" ", "p_name", "p_type", F.lit("extra")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", identifiers.is_identifier_query(text).alias("identifier_only"))


# --- titles -----------------------------------------------------------------------------------


def catalog_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as product titles of eight categories, built from its key and size."""
    k, n = F.col("p_partkey") % 8, F.col("p_size")
    text = lambda c: c.cast("string")
    chip = F.concat(F.lit("50"), text((n % 3 + 6) * 10))
    watts = text((n % 3 + 6) * 100 + 50)
    made = (
        F.when(k == 0, F.concat(F.lit("Placa de Vídeo MSI GeForce RTX "), chip, F.when(n % 2 == 0, " Ti").otherwise(""), F.lit(" Ventus 2X "), F.when(n % 4 < 2, "8").otherwise("16"), F.lit("GB GDDR7")))
        .when(k == 1, F.concat(F.lit("Smartphone Apple iPhone 1"), text(n % 3 + 4), F.lit(" Pro "), F.when(n % 2 == 0, "128").otherwise("256"), F.lit("GB Preto")))
        .when(k == 2, F.lit("Notebook Dell Inspiron Intel Core i5-1235U 8GB RAM 256GB SSD"))
        .when(k == 3, F.concat(F.lit("Processador AMD Ryzen 7 "), F.when(n % 2 == 0, "5700").otherwise("7700"), F.lit("X AM5")))
        .when(k == 4, F.concat(F.lit("SSD Samsung 990 EVO Plus "), F.when(n % 2 == 0, "1").otherwise("2"), F.lit("TB NVMe")))
        .when(k == 5, F.concat(F.lit("Fonte Corsair RM"), watts, F.lit(" "), watts, F.lit("W 80 Plus Gold Full Modular")))
        .when(k == 6, F.concat(F.lit("Monitor LG UltraGear 27GS95QE 27\" "), F.when(n % 2 == 0, "240").otherwise("144"), F.lit("Hz")))
        .otherwise(F.lit("Teclado Redragon Kumara Red Switch ABNT2"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n"), made.alias("title"))


TITLES_SQL = """
t AS (SELECT p_partkey, p_size AS n, p_partkey % 8 AS k, CAST((p_size % 3 + 6) * 10 AS VARCHAR) AS chip, CAST((p_size % 3 + 6) * 100 + 50 AS VARCHAR) AS watts FROM part),
tc AS (SELECT *, (['gpu', 'smartphone', 'notebook', 'cpu', 'ssd', 'psu', 'monitor', 'keyboard'])[CAST(k AS INTEGER) + 1] AS category FROM t)"""


@query("category_detect", "WITH " + TITLES_SQL + " SELECT category, count(*) AS products FROM tc GROUP BY category")
def category_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog_titles(spark, sf_dir).withColumn("category", title_attributes.category_of(F.col("title")))
    return rows.groupBy("category").agg(F.count("*").alias("products"))


@query(
    "model_keys",
    "WITH " + TITLES_SQL + """ SELECT p_partkey, CASE k WHEN 0 THEN 'rtx50' || chip || CASE WHEN n % 2 = 0 THEN 'ti' ELSE '' END
      WHEN 1 THEN 'iphone1' || CAST(n % 3 + 4 AS VARCHAR) || 'pro' WHEN 2 THEN 'corei51235u' WHEN 3 THEN 'ryzen7' || CASE WHEN n % 2 = 0 THEN '5700x' ELSE '7700x' END
      WHEN 4 THEN '990evoplus' END AS model_key FROM tc""",
)
def model_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog_titles(spark, sf_dir)
    return rows.select("p_partkey", models.model_key(F.lit(None).cast("string"), fold_key(F.col("title"))).alias("model_key"))


@query(
    "title_grammar",
    "WITH " + TITLES_SQL + """ SELECT category, brand, model, variant, count(*) AS products FROM (
      SELECT category, (['MSI', 'Apple', 'Notebook', 'AMD', 'Samsung', 'Fonte', 'LG', 'Redragon'])[CAST(k AS INTEGER) + 1] AS brand,
        CASE k WHEN 0 THEN 'GeForce RTX 50' || chip || CASE WHEN n % 2 = 0 THEN ' Ti' ELSE '' END WHEN 1 THEN 'iPhone 1' || CAST(n % 3 + 4 AS VARCHAR) || ' Pro'
          WHEN 2 THEN 'Dell Inspiron Intel' WHEN 3 THEN 'Ryzen 7 ' || CASE WHEN n % 2 = 0 THEN '5700X' ELSE '7700X' END WHEN 4 THEN '990 EVO Plus'
          WHEN 5 THEN 'Corsair RM' || watts WHEN 6 THEN '27GS95QE' ELSE 'Kumara' END AS model,
        CASE WHEN k = 0 THEN 'Ventus 2X' END AS variant FROM tc) GROUP BY ALL""",
)
def title_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog_titles(spark, sf_dir).withColumn("category", title_attributes.category_of(F.col("title")))
    parsed = rows.select("category", grammars.parse(F.col("title"), F.col("category")).alias("p")).select("category", "p.*")
    return parsed.groupBy("category", "brand", "model", "variant").agg(F.count("*").alias("products"))


@query(
    "title_attributes",
    "WITH " + TITLES_SQL + """, a AS (
      SELECT p_partkey, unnest(list_filter([
        {'a': 'vram', 'v': CASE WHEN k = 0 THEN CASE WHEN n % 4 < 2 THEN '8 GB' ELSE '16 GB' END END},
        {'a': 'memory_type', 'v': CASE WHEN k = 0 THEN 'GDDR7' END},
        {'a': 'storage', 'v': CASE k WHEN 1 THEN CASE WHEN n % 2 = 0 THEN '128 GB' ELSE '256 GB' END WHEN 2 THEN '256 GB' WHEN 4 THEN CASE WHEN n % 2 = 0 THEN '1 TB' ELSE '2 TB' END END},
        {'a': 'ram', 'v': CASE WHEN k = 2 THEN '8 GB' END},
        {'a': 'socket', 'v': CASE WHEN k = 3 THEN 'AM5' END},
        {'a': 'wattage', 'v': CASE WHEN k = 5 THEN watts || ' W' END},
        {'a': 'efficiency', 'v': CASE WHEN k = 5 THEN '80 Plus Gold' END},
        {'a': 'refresh_rate', 'v': CASE WHEN k = 6 THEN CASE WHEN n % 2 = 0 THEN '240 Hz' ELSE '144 Hz' END END},
        {'a': 'screen_size', 'v': CASE WHEN k = 6 THEN '27"' END},
        {'a': 'switch_type', 'v': CASE WHEN k = 7 THEN 'Red Switch' END},
        {'a': 'layout', 'v': CASE WHEN k = 7 THEN 'ABNT2' END},
        {'a': 'brand', 'v': (['Msi', 'Apple', 'Dell', 'Amd', 'Samsung', 'Corsair', 'Lg', 'Redragon'])[CAST(k AS INTEGER) + 1]},
        {'a': 'model', 'v': CASE k WHEN 0 THEN 'GeForce Rtx 50' || chip || CASE WHEN n % 2 = 0 THEN ' Ti Ventus' ELSE ' Ventus 2X' END
          WHEN 1 THEN 'iPhone 1' || CAST(n % 3 + 4 AS VARCHAR) || ' Pro' WHEN 2 THEN 'Inspiron Intel Core i5-1235U' WHEN 3 THEN 'Ryzen 7 ' || CASE WHEN n % 2 = 0 THEN '5700X AM5' ELSE '7700X AM5' END
          WHEN 4 THEN '990 Evo Plus' WHEN 5 THEN 'RM' || watts WHEN 6 THEN 'UltraGear 27GS95QE' ELSE 'Kumara' END},
        {'a': 'gpu_model', 'v': CASE WHEN k = 0 THEN 'GeForce RTX 50' || chip || CASE WHEN n % 2 = 0 THEN ' Ti' ELSE '' END END},
        {'a': 'processor', 'v': CASE k WHEN 2 THEN 'Intel Core i5-1235U' WHEN 3 THEN 'AMD Ryzen 7 ' || CASE WHEN n % 2 = 0 THEN '5700X' ELSE '7700X' END END},
        {'a': 'color', 'v': CASE k WHEN 1 THEN 'Preto' WHEN 7 THEN 'Red' END},
        {'a': 'modularity', 'v': CASE WHEN k = 5 THEN 'Full Modular' END},
        {'a': 'interface', 'v': CASE WHEN k = 4 THEN 'NVMe' END},
        {'a': 'capacity', 'v': CASE WHEN k = 4 THEN CASE WHEN n % 2 = 0 THEN '1 TB' ELSE '2 TB' END END}], lambda x: x.v IS NOT NULL)) AS x FROM tc)
    SELECT x.a AS attribute, x.v AS value, count(*) AS products FROM a GROUP BY ALL""",
)
def title_attribute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(catalog_titles(spark, sf_dir)).withColumn("category", title_attributes.category_of(F.col("title")))
    found = rows.select(F.explode(title_attributes.title_attributes(F.col("title"), F.col("category"))).alias("attribute", "value"))
    return found.groupBy("attribute", "value").agg(F.count("*").alias("products"))


@query(
    "title_similarity",
    """WITH p AS (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || ' size' || CAST(p_size AS VARCHAR)), ' '), lambda x: x NOT IN ('', 'promo'))) AS t FROM part),
    w AS (SELECT *, lag(t) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev FROM p)
    SELECT p_partkey, round(len(list_intersect(t, prev)) / CAST(greatest(len(t), len(prev)) AS DOUBLE), 6) AS similarity FROM w WHERE prev IS NOT NULL""",
)
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("size"), F.col("p_size").cast("string")))
    # staged, as a sequence with cut keys reads its rows several times
    rows = staged(spread(table(spark, sf_dir, "part")).select("p_partkey", "p_brand", titles.title_tokens(titles.normalize_title(title)).alias("t")))
    from ..sequences import KeyedSequence

    paired = KeyedSequence(rows, ["p_brand"], ["p_partkey"]).carry({"prev": F.col("t")}).result()
    return paired.where(F.col("prev").isNotNull()).select("p_partkey", F.round(titles.similarity(F.col("t"), F.col("prev")), 6).alias("similarity"))


@query(
    "title_tokens",
    """SELECT p_partkey, 'red black widget ' || CAST(p_size * 64 AS VARCHAR) || 'gb mzv9s1t0bam wireless' AS normalized, 6 AS tokens FROM part""",
)
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.col("p_size") * 64).cast("string")
    title = F.concat(F.lit("Oferta: Vermelho PRETO de widget "), size, F.lit(" GB (MZ-V9S1T0B/AM) sem fio"))
    normal = titles.normalize_title(title)
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", normal.alias("normalized"))
    return rows.withColumn("tokens", F.size(titles.title_tokens(F.col("normalized"))))


@query(
    "ordered_terms",
    """SELECT lang, count(*) AS documents, CAST(sum(len(list_distinct(list_filter(regexp_split_to_array(trim(lower(translate(text,
      'áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝŸ', 'aaaaaaeeeeiiiiooooouuuucnyyaaaaaaeeeeiiiiooooouuuucnyy'))), '\\s+'), lambda x: x <> '')))) AS BIGINT) AS terms
    FROM documents GROUP BY lang""",
)
def ordered_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.size(ordered_terms(F.col("text"))).alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("terms"))


@query(
    "offer_condition",
    """SELECT code, grade, count(*) AS offers FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'used' WHEN 2 THEN 'renewed' WHEN 3 THEN 'open_box'
        WHEN 4 THEN 'new' ELSE 'refurbished' END AS code, CASE WHEN p_partkey % 6 = 2 THEN 'premium' END AS grade FROM part) GROUP BY ALL""",
)
def offer_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = literal_list(["", " Usado", " (Renewed Premium)", " Caixa Aberta", " Novo", " Recondicionado"])
    title = F.concat(F.lit("Console X "), F.get(endings, (F.col("p_partkey") % 6).cast("int")))
    rows = table(spark, sf_dir, "part").select(titles.condition(title).alias("c")).select("c.*")
    return rows.groupBy("code", "grade").agg(F.count("*").alias("offers"))


@query(
    "title_roles",
    """SELECT role, count(*) AS products FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'card' WHEN 1 THEN 'system' WHEN 2 THEN 'accessory' WHEN 3 THEN 'bundle' ELSE 'plain' END AS role FROM part) GROUP BY role""",
)
def title_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = literal_list(["Placa de Vídeo RTX 5060", "Notebook Dell RTX 5060", "Capa para iPhone", "Console com 2 jogos", "Cadeira simples"])
    title = F.concat(F.get(samples, (F.col("p_partkey") % 5).cast("int")), F.lit(" "), F.col("p_brand"))
    folded = fold_key(title)
    tokens = titles.title_tokens(titles.normalize_title(title))
    role = (
        F.when(titles.is_graphics_card(folded), "card").when(titles.is_system(folded), "system")
        .when(titles.has_accessory_word(tokens), "accessory").when(titles.has_bundle_marker(folded), "bundle").otherwise("plain")
    )
    return table(spark, sf_dir, "part").groupBy(role.alias("role")).agg(F.count("*").alias("products"))


@query(
    "colors",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'black' WHEN 1 THEN 'cosmic orange' WHEN 2 THEN 'gray' WHEN 3 THEN 'teal' ELSE 'blue' END AS color,
      CASE p_partkey % 5 WHEN 0 THEN 'conflict' WHEN 4 THEN 'same' ELSE 'conflict' END AS against_blue FROM part""",
)
def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.matching import color_relation

    words = literal_list(["Titânio Preto", "Laranja Cósmico", "Space-Gray", "Verde Acinzentado", "Azul"])
    value = titles.variant_value("color", F.get(words, (F.col("p_partkey") % 5).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_partkey", value.alias("color"))
    return rows.withColumn("against_blue", color_relation(F.col("color"), F.lit("blue")))


@query(
    "variant_keys",
    """SELECT p_partkey, 'color=' || lower(p_name) || '|storage=' || CAST(p_size * 64 AS VARCHAR) || 'gb' AS variant_key FROM part""",
)
def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Cor: "), "p_name", F.lit("; Armazenamento: "), (F.col("p_size") * 64).cast("string"), F.lit(" GB; Garantia: 1 ano"))
    entries = titles.variant_entries(titles.variant_pairs(text))
    return table(spark, sf_dir, "part").select("p_partkey", titles.map_key(titles.first_writer(entries)).alias("variant_key"))


# --- units and dates --------------------------------------------------------------------------


@query(
    "units_normalise",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) || ' GB' AS storage, CAST(p_size * 100 AS VARCHAR) || ' MHz' AS frequency, CAST(p_size * 10 AS VARCHAR) || ' W' AS wattage,
      '2x' || CAST(p_size AS VARCHAR) || ' GB' AS kit, 'DDR5' AS memory, '80 Plus Gold' AS efficiency, CAST(p_size * 10 AS VARCHAR) || ' mm' AS radiator FROM part""",
)
def units_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m=1: (F.col("p_size") * m).cast("string")
    made = lambda key, value: units.normalise(F.lit(key), value)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        made("storage", F.concat(n(), F.lit("gb"))).alias("storage"),
        made("frequency", F.concat(n(100), F.lit(" mhz"))).alias("frequency"),
        made("power", F.concat(n(10), F.lit("w"))).alias("wattage"),
        made("kit_configuration", F.concat(F.lit("2 X "), n(), F.lit("gb"))).alias("kit"),
        made("memory_type", F.lit("ddr 5")).alias("memory"),
        made("efficiency", F.lit("certificado 80 plus gold")).alias("efficiency"),
        made("radiator_size", F.concat(n(10), F.lit("MM"))).alias("radiator"),
    )


@query(
    "date_parse",
    """SELECT event_id, epoch_us(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts)::TIMESTAMP WHEN 1 THEN date_trunc('millisecond', ts)::TIMESTAMP
      WHEN 2 THEN date_trunc('second', ts)::TIMESTAMP + INTERVAL 3 HOUR ELSE ts END) AS parsed_us FROM events""",
)
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as epoch seconds, epoch milliseconds, Brazilian shop time and ISO, then parsed back."""
    at, key = F.col("at"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", views.utc("ts").alias("at"))
    text = (
        F.when(key % 4 == 0, F.unix_seconds(at).cast("string")).when(key % 4 == 1, F.unix_millis(at).cast("string"))
        .when(key % 4 == 2, F.date_format(at, "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
    return rows.select("event_id", F.unix_micros(dates.parse_time(text)).alias("parsed_us"))


@query(
    "duration_text",
    """SELECT o_orderkey, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS took FROM (
      SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) // 1000 AS s FROM orders)""",
)
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.col("o_totalprice") * 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.hms(ms).alias("took"))


def store_order_sql() -> str:
    from ..rules import stores as rules

    ranks = [(i, s[0], rules.LOCALE_RANK.get(s[0], rules.DEFAULT_LOCALE_RANK), rules.BARCODE_RANK.get(s[0], rules.DEFAULT_BARCODE_RANK)) for i, s in enumerate(rules.STORES)]
    values = ", ".join(f"({i}, '{key}', {locale}, {barcode})" for i, key, locale, barcode in ranks)
    return f"""WITH s(i, store_key, locale_rank, barcode_rank) AS (VALUES {values}),
    u AS (SELECT DISTINCT s.* FROM s JOIN supplier ON s_suppkey % {len(ranks)} = i),
    m AS (SELECT CASE WHEN bool_or(locale_rank = {rules.HOME_LOCALE_RANK}) THEN {rules.HOME_LOCALE_RANK} ELSE mode(locale_rank) END AS home FROM u)
    SELECT store_key, CASE WHEN locale_rank <> home THEN 3 WHEN barcode_rank <= {rules.FIRST_WAVE_MAX_RANK} THEN 1 ELSE 2 END AS wave,
      CASE WHEN store_key = 'kabum' THEN 1 ELSE 0 END AS reference_last, locale_rank, barcode_rank,
      row_number() OVER (ORDER BY CASE WHEN store_key = 'kabum' THEN 1 ELSE 0 END, locale_rank, barcode_rank, store_key) AS place FROM u, m"""


@query("store_order", store_order_sql())
def store_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search order of the stores that the suppliers stand for."""
    from pyspark.sql import Window

    from ..operators import runs
    from ..rules.stores import STORES

    keys = literal_list([s[0] for s in STORES])
    stores = table(spark, sf_dir, "supplier").select(F.get(keys, (F.col("s_suppkey") % len(STORES)).cast("int")).alias("store_key"))
    ordered = runs.order_stores(stores, "kabum").select("store_key", "wave", "reference_last", "locale_rank", "barcode_rank")
    place = F.row_number().over(Window.orderBy("reference_last", "locale_rank", "barcode_rank", "store_key"))  # a few dozen stores
    return ordered.withColumn("place", place)
