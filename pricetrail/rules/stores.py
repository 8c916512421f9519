"""Store dimension. Keys, markets, domains, labels and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import B, I, S, struct

# key, store, country, currency, domains, implemented, match enabled, label, search locale
STORES = [
    ("kabum", "kabum", "BR", "BRL", ["kabum.com.br"], True, True, "KaBuM!", "pt-BR"),
    ("magazineluiza", "magazineluiza", "BR", "BRL", ["magazineluiza.com.br"], True, True, "Magazine Luiza", "pt-BR"),
    ("mercadolivre", "mercadolivre", "BR", "BRL", ["mercadolivre.com.br", "produto.mercadolivre.com.br"], True, False, "Mercado Livre", "pt-BR"),
    ("pichau", "pichau", "BR", "BRL", ["pichau.com.br"], True, True, "Pichau", "pt-BR"),
    ("terabyteshop", "terabyteshop", "BR", "BRL", ["terabyteshop.com.br"], True, True, "TerabyteShop", "pt-BR"),
    ("shopee", "shopee", "BR", "BRL", ["shopee.com.br"], True, False, "Shopee", "pt-BR"),
    ("aliexpress", "aliexpress", "BR", "BRL", ["aliexpress.com"], True, True, "AliExpress", "pt-BR"),
    ("amazon_br", "amazon", "BR", "BRL", ["amazon.com.br"], True, True, "Amazon Brasil", "pt-BR"),
    ("amazon_us", "amazon", "US", "USD", ["amazon.com"], True, True, "Amazon US", "en-US"),
    ("bestbuy", "bestbuy", "US", "USD", ["bestbuy.com"], True, True, "Best Buy", "en-US"),
    ("ebay", "ebay", "US", "USD", ["ebay.com"], False, True, "eBay", "en-US"),
    ("gamestop", "gamestop", "US", "USD", ["gamestop.com"], False, True, "GameStop", "en-US"),
    ("newegg", "newegg", "US", "USD", ["newegg.com"], False, True, "Newegg", "en-US"),
    ("microcenter", "microcenter", "US", "USD", ["microcenter.com"], False, True, "Micro Center", "en-US"),
    ("nissei", "nissei", "PY", "PYG", ["nissei.com"], True, True, "Nissei", "en-US"),
    ("cellshop", "cellshop", "PY", "PYG", ["cellshop.com"], False, True, "Cellshop", "es-PY"),
    ("stargames", "stargames", "PY", "PYG", ["stargames.com.py"], False, True, "Star Games", "es-PY"),
    ("shoppingchina", "shoppingchina", "PY", "PYG", ["shoppingchina.com.py", "shoppingchina.com.br"], True, True, "Shopping China", "en-US"),
    ("visaovip", "visaovip", "PY", "USD", ["visaovip.com"], True, True, "Visão VIP", "en-US"),
]
DEFAULT_LABEL = "Loja"
# How early a store is searched, by how often its pages state a barcode.
BARCODE_RANK = {
    "kabum": 10, "bestbuy": 20, "nissei": 30, "shoppingchina": 40, "amazon_br": 50, "amazon_us": 55,
    "magazineluiza": 70, "mercadolivre": 75, "shopee": 90, "aliexpress": 92, "visaovip": 95,
}
LOCALE_RANK = {
    "kabum": 10, "amazon_br": 10, "magazineluiza": 10, "mercadolivre": 10, "pichau": 10,
    "terabyteshop": 10, "shopee": 10, "aliexpress": 10, "visaovip": 10, "shoppingchina": 10,
    "nissei": 20, "amazon_us": 40, "bestbuy": 40,
}
DEFAULT_BARCODE_RANK = 100
DEFAULT_LOCALE_RANK = 50
HOME_LOCALE_RANK = 10
FIRST_WAVE_MAX_RANK = 55

SCHEMA = struct(
    ("store_key", S), ("store", S), ("country", S), ("currency", S),
    ("implemented", B), ("match_enabled", B), ("label", S), ("search_locale", S),
    ("barcode_rank", I), ("locale_rank", I),
)


def store_table(spark: SparkSession) -> DataFrame:
    rows = [
        (key, store, country, currency, implemented, enabled, label, locale,
         BARCODE_RANK.get(key, DEFAULT_BARCODE_RANK), LOCALE_RANK.get(key, DEFAULT_LOCALE_RANK))
        for key, store, country, currency, _, implemented, enabled, label, locale in STORES
    ]
    return spark.createDataFrame(rows, SCHEMA)


def domain_table(spark: SparkSession) -> DataFrame:
    rows = [(domain, row[0], row[2], row[8]) for row in STORES for domain in row[4]]
    return spark.createDataFrame(
        rows, struct(("domain", S), ("store_key", S), ("country", S), ("search_locale", S))
    )
