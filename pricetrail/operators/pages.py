"""Archived pages: labels, structured offers, timed promotions, payment conditions, galleries.

All rules are column expressions over the whole page text; nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.money import parse_money
from ..functions.patterns import has_any, let, rx, rx_all, squash
from ..functions.text import blank_to_null
from ..rules import pages as rules

TAG = r"(?s)<[^>]*>"
LD_JSON = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
PRICE_IN_LD = r'"price"\s*:\s*"?\d'


def plain_text(html: Column) -> Column:
    """Visible words: no scripts, styles, comments or tags; the basic entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, TAG, " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return squash(text)


def page_title(html: Column) -> Column:
    return squash(rx(html, TITLE, 1))


# --- labels -----------------------------------------------------------------------------------


def _facts(pages: DataFrame) -> DataFrame:
    """Lower-case text, title and link, computed once per page."""
    return pages.withColumns(
        {
            "__low": F.lower("html"),
            "__title": F.lower(F.coalesce(page_title(F.col("html")), F.lit(""))),
            "__url": F.lower("url"),
            "__path": F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)),
        }
    )


def _challenge_parts() -> dict[str, Column]:
    low, title, url = F.col("__low"), F.col("__title"), F.col("__url")
    product = low.contains('id="producttitle"') | low.contains('name="asin"')
    # a page that shows products or results is no check or error page, whatever markers its scripts hold
    genuine = product | low.rlike("s-search-result|itemprop=[\"']price[\"']|ui-pdp-price|ui-search-layout")
    hay = F.concat(title, F.lit("\n"), low)
    sensor = has_any(low, rules.SENSOR_STRUCTURE) | (has_any(low, rules.SENSOR_LOOSE) & ~genuine)
    robot = has_any(hay, rules.ROBOT_CHECK) | (
        hay.contains("amazon") & hay.contains("captcha") & ~genuine
    )
    work = (
        (low.contains("verifychallenge") & low.contains("continue-button"))
        | (low.rlike("snoopy-generation|snoopy-script") & low.rlike("continue-button|_bmc|micro-landing"))
        | (low.contains("micro-landing-button") & low.rlike("verifychallenge|_bmstate"))
    )
    shop = has_any(hay, rules.SHOP_BLOCK) & ~low.contains("product_title") & ~low.contains("targetskupriceinfo")
    denied = low.contains("akamai-bot") & low.rlike("não é possível acessar|nao e possivel acessar")
    js = (
        has_any(title, rules.JS_CHECK_TITLES)
        | (low.contains("performing security verification") & ~genuine)
        | (low.rlike("cf-challenge|challenge-platform") & ~genuine)
    )
    soft = has_any(hay, rules.SOFT_ERROR) & ~genuine
    amazon = url.contains("amazon.") | low.contains("amazon.")
    signin = url.contains("ap/signin") | low.contains("/ap/signin") | (
        amazon & title.rlike("sign in|sign-in|fazer login|iniciar sessão|iniciar sesion") & ~product
    )
    shopee = (url.contains("shopee.") | low.contains("shopee.")) & (
        url.contains("/verify/traffic") | low.contains("verify/traff") | url.contains("/buyer/login")
        | (url.contains("login") & url.contains("next="))
        | (low.contains("buyer/login") & F.concat(url, low).contains("next=") & ~low.rlike('"item_id"|"itemid"'))
    )
    meli = url.rlike("mercadoli[vb]re\\.") & (
        url.contains("account-verification") | (low.contains("account-verification") & ~low.rlike("/p/mlb|ui-search-layout"))
    )
    return {
        "hard_block": title.contains("attention required") | has_any(low, rules.HARD_BLOCK),
        "work": work,
        "auth_wall": signin | shopee | meli,
        "robot": robot,
        "sensor": sensor,
        "js": js,
        "other": title.startswith("loading ") | denied | shop,
        "soft_error": soft,
    }


def label_pages(pages: DataFrame) -> DataFrame:
    """Add ``label`` and ``challenge`` to pages (url, html).

    hard_block, challenge, auth_wall, soft_error, genuine_empty (a results page
    that really has none), incomplete (a results page without results), valid.
    """
    rows = _facts(pages)
    parts = _challenge_parts()
    rows = rows.withColumns({f"__{k}": F.coalesce(v, F.lit(False)) for k, v in parts.items()})
    challenge = (
        F.when(F.col("__hard_block"), "hard_block")
        .when(F.col("__work"), "mercadolivre_snoopy")
        .when(F.col("__auth_wall"), "auth_wall")
        .when(F.col("__robot"), "amazon_image_captcha")
        .when(F.col("__sensor"), "akamai_sec_cpt")
        .when(F.col("__js"), "cloudflare_js")
        .when(F.col("__other"), "generic")
    )
    results = F.col("__low").rlike("s-search-result|data-asin=[\"'][a-z0-9]{10}[\"']|/(?:dp|gp/product)/[a-z0-9]{10}")
    is_results = F.col("__url").contains("amazon.") & F.col("__path").rlike(r"^/s(/|$)")
    empty = has_any(F.col("__low"), rules.GENUINE_EMPTY) & ~results
    label = (
        F.when(F.col("challenge") == "hard_block", "hard_block")
        .when(F.col("challenge") == "auth_wall", "auth_wall")
        .when(F.col("challenge").isNotNull(), "challenge")
        .when(F.col("__soft_error"), "soft_error")
        .when(is_results & empty, "genuine_empty")
        .when(is_results & ~results, "incomplete")
        .otherwise("valid")
    )
    labelled = rows.withColumn("challenge", challenge).withColumn("label", label)
    return labelled.select(*pages.columns, "label", "challenge")


def label_report(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(urls.host(F.col("url")).alias("host"), "label").agg(F.count("*").alias("pages"))


def page_kinds(labelled: DataFrame) -> DataFrame:
    """Flags of usable pages per store: product page, results page, price signal, sold out.

    Pages with a block, challenge or login label get none.
    """
    rows = _facts(labelled)
    low, path, url = F.col("__low"), F.col("__path"), F.col("__url")
    html = F.col("html")
    # only block labels switch the flags off; an empty results page stays one
    usable = ~F.col("label").isin("hard_block", "challenge", "auth_wall")
    ld_offer = low.contains('"@type"') & low.contains("product") & low.contains('"price"')
    next_data = low.rlike("""<script[^>]*id=["']__next_data__["']""")
    product_link = low.rlike("""<a[^>]*href=["'][^"']*/produto/""")
    at = urls.host(F.col("url"))
    of = lambda *domains: F.coalesce(at.rlike("(^|\\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"), F.lit(False))
    asin_url = html.isNotNull() & F.col("url").rlike(r"(?i)(?:/dp/|/gp/product/|/gp/aw/d/|/exec/obidos/ASIN/)[A-Z0-9]{10}(?:[/?]|$)")
    product = (
        F.when(of("amazon.com", "amazon.com.br"), low.contains('id="producttitle"') | low.rlike("""<input[^>]*(?:id|name)=["']asin["']""") | asin_url)
        .when(of("kabum.com.br"), next_data | ld_offer | (path.contains("/produto/") & low.rlike("<h1|itemprop=[\"']name[\"']")))
        .when(of("magazineluiza.com.br"), next_data & path.contains("/p/") & low.contains('"offers"') & low.contains('"title"'))
        .when(of("mercadolivre.com.br"), low.rlike("ui-pdp-title|ui-pdp-price|itemprop=[\"']price[\"']") | ld_offer | path.rlike(r"/p/mlb\d+(/|$)|/mlb-"))
        .when(
            of("pichau.com.br"),
            (low.contains("pichau_prices") & low.rlike("avista|final_price")) | ld_offer
            | (low.contains("self.__next_f.push") & low.contains("product") & low.rlike("sku|special_price")),
        )
        .when(
            of("terabyteshop.com.br"),
            path.contains("/produto/") & (ld_offer | low.rlike("id=[\"']valvista[\"']") | (low.contains("especificacoes") & low.rlike("<h1|panel-body"))),
        )
        .otherwise(ld_offer)
    )
    results = (
        F.when(
            of("amazon.com", "amazon.com.br"),
            ~path.rlike("/dp/|/gp/product/")
            & (low.rlike("s-search-result|s-result-item") & low.contains("data-asin=") | (path.contains("/s") & low.rlike("/dp/[a-z0-9]{10}") & low.rlike("data-asin=[\"'][a-z0-9]{10}[\"']"))),
        )
        .when(of("kabum.com.br"), (path.contains("/busca/") | url.contains("/busca?")) & (next_data | product_link))
        .when(of("magazineluiza.com.br"), path.contains("/busca/") & low.rlike("""product-card-link|<a[^>]*href=["'][^"']*/p/"""))
        .when(
            of("mercadolivre.com.br"),
            (url.contains("lista.mercadolivre") | low.rlike("ui-search-layout|poly-component__title"))
            & low.rlike("ui-search|poly-component__title|/p/mlb|produto\\.mercadolivre"),
        )
        .when(of("pichau.com.br"), path.contains("/search") & low.rlike("<a[^>]*href="))
        .when(of("terabyteshop.com.br"), (path.contains("/busca") | url.contains("str=")) & product_link)
        .when(of("aliexpress.com"), path.contains("wholesale") & html.contains('"itemList"') & html.contains('"productId"') & html.contains('"displayTitle"'))
        .otherwise(F.lit(False))
    )
    price = low.rlike(PRICE_IN_LD) & low.contains("product") | low.rlike("""itemprop=["']price["'][^>]*content=["'][^"']*\\d""") | low.rlike(
        r"""(?s)id=["'](?:coreprice|buybox|desktop_buybox|apex_desktop)[^>]*>.*?a-offscreen["']>[^<]*\d"""
    )
    stock = rx(html, r"""(?is)id=["'](?:availability|outOfStock|availability_feature_div)["'][^>]*>(.*?)</div>""", 1)
    sold_out = has_any(F.lower(plain_text(F.coalesce(stock, F.lit("")))), rules.SOLD_OUT)
    flag = lambda c: F.coalesce(usable & c, F.lit(False))
    return rows.withColumns(
        {"is_product": flag(product), "is_results": flag(results), "has_price": flag(price), "is_sold_out": flag(sold_out)}
    ).select(*labelled.columns, "is_product", "is_results", "has_price", "is_sold_out")


# --- structured offers ------------------------------------------------------------------------


def product_json(html: Column) -> Column:
    """The first JSON-LD Product of a page as VARIANT; NULL without one."""
    blocks = F.transform(rx_all(html, LD_JSON, 1), lambda j: F.try_parse_json(F.trim(j)))
    parts = F.flatten(
        F.transform(
            blocks,
            lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
        )
    )

    def is_product(v):
        one = F.try_variant_get(v, "$['@type']", "string")
        many = F.try_variant_get(v, "$['@type']", "array<string>")
        return F.coalesce((one == "Product") | F.array_contains(many, "Product"), F.lit(False))

    return F.get(F.filter(parts, is_product), F.lit(0))


def structured_offers(pages: DataFrame, currency: Column | str = "BRL") -> DataFrame:
    """One offer row per page: JSON-LD Product, else item properties, else class names and the title.

    ``error`` tells why a page gave none (no title or no price).
    """
    money = F.lit(currency) if isinstance(currency, str) else currency
    rows = pages.withColumn("__v", product_json(F.col("html")))
    v, html = F.col("__v"), F.col("html")
    get = lambda path: F.try_variant_get(v, path, "string")
    attr = lambda prop: blank_to_null(rx(html, rf"""(?is)<[^>]*itemprop=["']{prop}["'][^>]*content=["']([^"']*)["']""", 1))
    text = lambda name: blank_to_null(plain_text(rx(html, rf"""(?is)<[^>]*class=["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>([^<]*)""", 1)))
    element = lambda tag: blank_to_null(plain_text(rx(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)))
    raw = F.coalesce(get("$.offers.price"), attr("price"), text("price"), text("product-price"))
    sku = F.coalesce(
        blank_to_null(get("$.sku")), attr("sku"), blank_to_null(rx(html, r"""(?is)data-product-id=["']([^"']+)["']""", 1)), urls.canonical(F.col("url"))
    )
    stock = F.lower(F.coalesce(get("$.offers.availability"), F.lit("")))
    available = ~F.coalesce(stock.isin("outofstock", "false"), F.lit(False))
    made = rows.withColumns(
        {
            "title": F.coalesce(blank_to_null(get("$.name")), element("h1"), element("title")),
            "product_id": sku,
            "price_text": raw,
            "price": parse_money(raw, money),
            "currency": money,
            "available": available,
            "availability": F.when(available, "available").otherwise("out_of_stock"),
            "brand": F.coalesce(get("$.brand.name"), get("$.brand")),
            "gtin": F.coalesce(get("$.gtin13"), get("$.gtin"), get("$.gtin12"), get("$.gtin8")),
            "images": F.coalesce(F.try_variant_get(v, "$.image", "array<string>"), F.array_compact(F.array(get("$.image")))),
            "canonical_url": urls.canonical(F.col("url")),
        }
    )
    error = F.when(F.col("title").isNull(), "no_title").when(F.col("price").isNull(), "no_price")
    return made.withColumn("error", error).drop("__v", "html")


# --- promotions and payment -------------------------------------------------------------------


def timed_promotions(pages: DataFrame) -> DataFrame:
    """Promotion observations of pages (store, product_id, sku, html): type, end, zone, source.

    A page without a certain end gives none; a countdown of the page's own
    product comes before others on it.
    """
    store, html = F.col("store"), F.col("html")
    found = []
    for name, pattern, kind, zone, source in rules.PROMOTIONS:
        if name == "terabyteshop":
            ids, ends = rx_all(html, pattern, 1), rx_all(html, pattern, 2)
            own = F.array_position(ids, F.col("product_id").cast("string"))
            raw = F.get(ends, F.when(own > 0, own - 1).otherwise(0).cast("int"))
        else:
            raw = rx(html, pattern, 1)
        found.append(F.when((store == name) & raw.isNotNull(), F.struct(F.lit(kind).alias("type"), raw.alias("raw"), F.lit(zone).alias("zone"), F.lit(source).alias("source"))))
    day = rx(html, rules.VALID_UNTIL, 1)
    for name, kind, zone, source in (
        ("mercadolivre", "lightning_deal", "UTC", "mercadolivre.jsonld.priceValidUntil"),
        ("terabyteshop", "campaign_countdown", "America/Sao_Paulo", "terabyte.jsonld.priceValidUntil"),
    ):
        found.append(
            F.when(
                (store == name) & day.isNotNull(),
                F.struct(F.lit(kind).alias("type"), F.concat(day, F.lit(" 23:59:59")).alias("raw"), F.lit(zone).alias("zone"), F.lit(source).alias("source")),
            )
        )
    end = F.coalesce(*found)
    rows = pages.withColumn("__p", end).where(F.col("__p").isNotNull())
    rows = rows.withColumn("expires_at", dates.parse_time(F.col("__p.raw"), F.col("__p.zone"))).where(F.col("expires_at").isNotNull())
    return rows.select(
        *[c for c in pages.columns if c != "html"], F.col("__p.type").alias("promotion_type"), "expires_at",
        F.col("__p.zone").alias("timezone"), F.col("__p.source").alias("source"), F.col("__p.raw").alias("raw"),
    )


def payment_conditions(pages: DataFrame, country: str = "BR") -> DataFrame:
    """Cash discount and its method, instalment total, interest-free, and the badges of the page."""
    text = plain_text(F.col("html"))
    rows = pages.withColumns({"__text": text, "__low": F.lower("html")})
    words, low = F.col("__text"), F.col("__low")
    brazil = F.lit(country == "BR")
    percent = F.translate(rx(words, rules.CASH_DISCOUNT, 1), ",", ".").try_cast("decimal(6,2)")
    percent = F.when(brazil & (percent > 0) & (percent < 100), percent)
    tail = F.lower(F.regexp_extract(words, rules.CASH_DISCOUNT, 2))
    method = (
        F.when(tail.contains("pix"), "pix").when(tail.contains("boleto"), "boleto")
        .when(tail.contains("cart"), F.when(tail.contains("cr"), "credit_card").otherwise("card")).otherwise("other")
    )
    return rows.withColumns(
        {
            "cash_discount_percent": percent,
            "cash_discount_method": F.when(percent.isNotNull(), method),
            "installment_total": F.when(brazil, parse_money(rx(words, rules.INSTALMENT_TOTAL, 1), F.lit("BRL"))),
            "interest_free": brazil & words.rlike(rules.INTEREST_FREE),
            "coupon_required": has_any(low, rules.COUPON[country]),
            "coupon_label": F.when(has_any(low, rules.COUPON[country]), F.trim(rx(low, rules.COUPON_VALUE))),
            "prime_badge": has_any(low, rules.PRIME),
            "subscribe_and_save": has_any(low, rules.SUBSCRIBE[country]),
            "pix_available": brazil & has_any(low, rules.PIX),
        }
    ).drop("__text", "__low", "html")


# --- links and galleries ----------------------------------------------------------------------


def distinct_links(crawled: DataFrame, order: str) -> DataFrame:
    """Crawl log without repeats of a canonical link: the first row of each, and how many there were."""
    rest = list(crawled.columns)
    return (
        crawled.withColumn("canonical_url", urls.canonical(F.col("url")))
        .groupBy("canonical_url")
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"), F.count("*").alias("seen"))
        .select("canonical_url", "seen", "r.*")
    )


def absolute_link(link: Column, base: Column) -> Column:
    """A link made absolute against its page."""
    text = F.trim(link)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(rx(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("/")))
    return (
        F.when(text.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), text)
        .when(text.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), text))
        .when(text.startswith("/"), F.concat(root, text))
        .otherwise(F.concat(folder, text))
    )


def gallery(images: Column, base: Column) -> Column:
    """Absolute image links in order, without repeats or other sizes of one picture."""
    full = F.transform(F.filter(images, lambda i: F.trim(i) != ""), lambda i: absolute_link(i, base))
    size_free = lambda links: F.transform(links, lambda i: F.regexp_replace(i, "(?i)/(?:small|medium|large|xlarge)/", "/<size>/"))
    first = lambda links, free: F.filter(links, lambda i, n: F.array_position(free, F.get(free, n)) == n + 1)
    return let(full, lambda links: let(size_free(links), lambda free: first(links, free)))


def gallery_rows(galleries: DataFrame) -> DataFrame:
    """One row per distinct asset of a product with its position; the first one is the main image."""
    return galleries.select("product_id", F.posexplode("images").alias("position", "source_url")).withColumn(
        "is_main", F.col("position") == 0
    )
