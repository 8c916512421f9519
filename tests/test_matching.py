"""Pairs of product descriptions and the decision each must get."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricetrail.operators.identity import build_identities, identity_struct
from pricetrail.operators.matching import score_pairs

ITEM = "side string, n int, title string, brand string, model string, variant string, gtin string, price decimal(18,4), currency string, store string, product_id string"


def item(title, brand=None, model=None, variant=None, gtin=None, price=None, currency=None, store=None, product_id=None):
    from decimal import Decimal

    return (title, brand, model, variant, gtin, None if price is None else Decimal(price), currency, store, product_id)


CASES = [
    # reference, candidate, decision, reason code that must be present
    (item("Chocolate Nestle 90g", "Nestle", gtin="7891991010863"), item("Nestle Chocolate barra", "nestle", gtin="7891991010863"), "auto_match", "gtin_exact"),
    (item("Placa de Video MSI GeForce RTX 5070", "MSI"), item("Placa de Video MSI GeForce RTX 5070 Ti", "MSI"), "reject", "critical_conflict"),
    (item("Memoria Kingston Fury 16GB DDR4", "Kingston"), item("Memoria Kingston Fury 16GB DDR5", "Kingston"), "reject", "critical_conflict"),
    (item("Apple iPhone 16 128GB Preto", "Apple", "iPhone 16"), item("Apple iPhone 16 Pro 128GB Preto", "Apple", "iPhone 16 Pro"), "reject", "critical_conflict"),
    (item("SSD Samsung 870 EVO 1TB", "Samsung"), item("SSD Samsung 990 EVO 1TB", "Samsung"), "reject", "critical_conflict"),
    (item("Apple iPhone 16 256GB Preto", "Apple", "iPhone 16"), item("Apple iPhone 16 256 GB Black", "Apple", "iPhone 16"), "auto_match", "brand_model_exact"),
    (item("Apple iPhone 16 256GB Cinza Espacial", "Apple", "iPhone 16"), item("Apple iPhone 16 256GB Space Gray", "Apple", "iPhone 16"), "auto_match", "brand_model_exact"),
    (item("Apple iPhone 16 256GB Preto", "Apple", "iPhone 16"), item("Apple iPhone 16 256GB Azul", "Apple", "iPhone 16"), "reject", "variant_mismatch"),
    (item("Apple iPhone 16 128GB Preto", "Apple", "iPhone 16"), item("Apple iPhone 16 256GB Preto", "Apple", "iPhone 16"), "reject", "variant_mismatch"),
    (item("Apple iPhone 15 128GB", "Apple", "iPhone 15"), item("Apple iPhone 15 128GB Usado", "Apple", "iPhone 15"), "reject", "condition_reject"),
    (item("Apple iPhone 15 128GB", "Apple", "iPhone 15"), item("Apple iPhone 15 128GB (Renewed)", "Apple", "iPhone 15"), "auto_match", "offer_condition"),
    (item("Mesa de jantar grande madeira", None), item("Mesa de jantar grande de madeira", None), "reject", "title_similarity"),
    (item("Apple iPhone 16 128GB", "Apple", "iPhone 16"), item("Capa para Apple iPhone 16", "Apple", "iPhone 16"), "reject", "accessory_reject"),
    (item("Console PlayStation 5 Slim Digital", "Sony"), item("Console PlayStation 5 Slim Disc Edition", "Sony"), "reject", "critical_conflict"),
    (item("SSD Samsung 990 EVO Plus 1TB MZ-V9S1T0B/AM", "Samsung"), item("Samsung 990 EVO Plus NVMe 1TB MZ-V9S1T0B/AM", "Samsung"), "auto_match", "mpn_exact"),
    (item("Apple iPhone 16 128GB", "Apple", "iPhone 16", price="5000", currency="BRL"), item("Apple iPhone 16 128GB", "Apple", "iPhone 16", price="900", currency="BRL"), "review", "price_deviation"),
    (item("Apple iPhone 16 128GB", "Apple", "iPhone 16"), item("Apple iPhone 16 128GB Verizon", "Apple", "iPhone 16"), "review", "carrier_variant_uncertain"),
    (item("Apple iPhone 16 128GB Unlocked", "Apple", "iPhone 16"), item("Apple iPhone 16 128GB AT&T", "Apple", "iPhone 16"), "reject", "variant_mismatch"),
    (item("Processador AMD Ryzen 7 7800X3D", "AMD"), item("AMD Ryzen 7 7800X3D Box 4.2GHz AM5", "AMD"), "auto_match", "processor_model_exact"),
    (item("Placa de Video MSI GeForce RTX 5060", "MSI"), item("Notebook MSI Intel Core i7 16GB DDR5 SSD GeForce RTX 5060", "MSI"), "reject", "form_factor_reject"),
    (item("Monitor LG UltraGear 27GS95QE 27\" 240Hz", "LG"), item("LG 27GS95QE Monitor Gamer OLED 27\"", "LG"), "auto_match", "monitor_model_code_exact"),
    (item("Monitor LG UltraGear 27GS95QE", "LG"), item("Monitor LG UltraGear 27GS60F", "LG"), "reject", "monitor_model_code_conflict"),
    (item("A", "Acme", store="kabum", product_id="77"), item("A", "Acme", store="kabum", product_id="77"), "auto_match", "same_store_product_id"),
    (item("Apple iPhone 16 128GB", "Apple", "iPhone 16", "color: Nevoa Lunar"), item("Apple iPhone 16 128GB", "Apple", "iPhone 16", "color: Preto"), "review", "variant_semantic_uncertain"),
]


@pytest.fixture(scope="module")
def decisions(spark):
    rows = []
    for n, (ref, cand, _, _) in enumerate(CASES):
        rows += [("ref", n, *ref), ("cand", n, *cand)]
    built = build_identities(spark.createDataFrame(rows, ITEM))
    side = lambda s: built.where(F.col("side") == s).select("n", identity_struct().alias(s))
    scored = score_pairs(side("ref").join(side("cand"), "n")).select("n", "score").collect()
    return {r["n"]: r["score"] for r in scored}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_decision(decisions, n):
    _, _, decision, code = CASES[n]
    score = decisions[n]
    codes = [r["code"] for r in score["reasons"]]
    assert (score["decision"], code in codes) == (decision, True), (CASES[n], score)


def test_title_alone_never_matches(decisions):
    assert all(s["decision"] != "auto_match" for n, s in decisions.items() if CASES[n][3] == "title_similarity")
