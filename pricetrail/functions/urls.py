"""Links: canonical form, hosts and their stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import among, let

# Query keys that only track a visit.
TRACKING_KEYS = (
    "fbclid gclid gbraid wbraid gad_source gad_campaignid ref ref_ source from sp_atk utm_campaign utm_medium utm_source "
    "utm_term utm_content utm_id gclsrc dclid msclkid mc_cid mc_eid igshid xptdk spm algo_pvid algo_exp_id pdp_ext_f pdp_npi "
    "curpageloguid utparam-url tblci aff_fcid aff_fsk aff_platform aff_trace_key terminal_id af dp"
).split()
TRACKING_PREFIXES = ("matt_", "cq_", "gad_", "utm_")
PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment or tracking keys.

    The other parameters keep their order; empty ones go.
    """
    def built(text):
        part = lambda g: F.regexp_extract(text, PARTS, g)
        path = F.regexp_replace(part(3), "/+$", "")
        plain = lambda p: F.coalesce(F.try_url_decode(p), p)
        coded = lambda p: F.replace(F.replace(F.url_encode(plain(p)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
        key = lambda p: F.substring_index(p, "=", 1)
        value = lambda p: F.substr(p, F.instr(p, "=") + 1)

        def kept(p):
            name = F.lower(plain(key(p)))
            return p.contains("=") & (value(p) != "") & ~among(name, TRACKING_KEYS) & ~name.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")

        pairs = F.transform(F.filter(F.split(part(4), "&"), kept), lambda p: F.concat(coded(key(p)), F.lit("="), coded(value(p))))
        # most links have no parameters: then their part is not looked for
        query = F.when(text.contains("?"), let(F.array_join(pairs, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))).otherwise("")
        return F.when(
            text.rlike(PARTS),
            F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), let(path, lambda p: F.when(p == "", "/").otherwise(p)), query),
        ).otherwise(text)

    return let(F.trim(url), built)


def absolute_http(text: Column) -> Column:
    """An http(s) link; a bare ``//host`` gains https, anything else is NULL."""
    raw = F.trim(text)
    return F.when(raw.rlike(r"(?i)^https?://[^/\s]+"), raw).when(raw.rlike(r"^//[^/\s]+"), F.concat(F.lit("https:"), raw))


def host(url: Column) -> Column:
    """Lower-case host without port and user."""
    place = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), r":\d+$", "")), F.lit(""))


def suffixes(name: Column) -> Column:
    """``a.b.com`` -> [a.b.com, b.com, com]."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def with_store(links: DataFrame, domains: DataFrame, url_column: str = "url") -> DataFrame:
    """Add the store of each link: its host equals a domain or ends with ``.domain``; the longest wins.

    The host's suffixes are looked up in the domain dimension held as one small
    map, so rows are neither exploded nor shuffled.
    """
    rows = domains.select("domain", F.struct(*[c for c in domains.columns if c != "domain"]).alias("entry"))
    # the store dimension (fixed, a few dozen domains) as one map value
    table = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "entry")))).alias("__domains"))
    joined = links.withColumn("__domains", table.scalar())
    found = F.filter(
        F.transform(suffixes(host(F.col(url_column))), lambda s: F.try_element_at(F.col("__domains"), s)), lambda e: e.isNotNull()
    )
    return joined.withColumn("__hit", F.get(found, F.lit(0))).select(*links.columns, "__hit.*")


def request_key(store: Column, url: Column, product_id: Column, variant: Column) -> Column:
    """SHA-256 of a request: store, canonical link, product and variant."""
    return F.sha2(F.concat_ws("|", store, canonical(url), product_id, F.coalesce(variant, F.lit(""))), 256)


# The language a host's pages are asked in; later rows count only where no earlier one does.
HOST_LOCALES = (
    ("nissei.com", "es-PY"), ("aliexpress.com", "pt-BR"), ("amazon.com", "en-US"), ("bestbuy.com", "en-US"), ("com.br", "pt-BR"),
)
LOCALE_OF_NAMES = (("shoppingchina", "pt-BR"),)


def locale(url: Column) -> Column:
    """The language that a store's pages are asked in, by the end of the host's name; NULL where none is known."""
    name = F.concat(F.lit("."), F.regexp_replace(host(url), r"^www\.", ""))
    rules = [F.when(name.endswith(F.lit(f".{end}")), F.lit(code)) for end, code in HOST_LOCALES]
    return F.coalesce(*rules, *[F.when(name.contains(part), F.lit(code)) for part, code in LOCALE_OF_NAMES])
