"""Marker texts that tell kinds of archived pages apart. All fixed values, in lower case."""

from __future__ import annotations

HARD_BLOCK = ("you have been blocked", "sorry, you have been blocked")
SENSOR_STRUCTURE = (
    'id="sec-if-cpt-container"', "id='sec-if-cpt-container'", 'class="behavioral-content"', "class='behavioral-content'",
    'id="sec-bc-tile-parent"', "id='sec-bc-tile-parent'",
)
SENSOR_LOOSE = ("sec-if-cpt-container", "behavioral-content", "scf-akamai-logo", "sec-bc-text-container")
ROBOT_CHECK = (
    "validatecaptcha", "opfcaptcha", "robot check", "type the characters you see", "enter the characters you see",
    "sorry, we just need to make sure you're not a robot", "clique na caixa para confirmar", "não sou um robô",
    "nao sou um robo", "to discuss automated access to amazon data",
)
SOFT_ERROR = (
    "algo deu errado", "something went wrong on our end", "dogs of amazon", "cachorros da amazon", "/error/500-title",
    "/images/g/32/error/", "/images/g/01/error/", "error/logo._ttd_.png",
)
SHOP_BLOCK = (
    "rgv587", "fail_sys_user_validate", "fail_sys_token_empty", "_____tmd_____", "x5secdata", "baxia-dialog", "nc_wrapper",
    "slide-to-validate",
)
JS_CHECK_TITLES = ("just a moment", "un momento")
JS_CHECK = ("cf-challenge", "challenge-platform", "performing security verification", "turnstile")
GENUINE_EMPTY = (
    "nenhum resultado", "não encontramos", "nao encontramos", "no results for", "did not match any products", "0 results for",
)
SOLD_OUT = (
    "currently unavailable", "out of stock", "temporarily out of stock", "we don't know when", "we do not know when",
    "não disponível", "nao disponivel", "indisponível", "indisponivel", "sem estoque", "esgotado", "não temos previsão",
    "nao temos previsao", "atualmente indisponível", "atualmente indisponivel",
)
COUPON = {"BR": ("cupom", "coupon"), "US": ("coupon", "apply $", "clip coupon")}
SUBSCRIBE = {"BR": ("assine e economize", "subscribe & save"), "US": ("subscribe & save", "subscribe and save")}
PRIME = ("prime",)
PIX = ("no pix", "via pix", "com pix")
# payment wording, Brazil
CASH_DISCOUNT = r"(?i)(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s*off\s*(?:à|a)\s*vista(?:\s+(?:no|na|com|via))?\s*([a-zçãáéíóúô ]*)"
INSTALMENT_TOTAL = r"(?i)total\s+parcelado\s*(?:de\s*)?R\$\s*([\d.]+,\d{2})"
INTEREST_FREE = r"(?i)\d+\s*x\s*de\s*R\$\s*[\d.]+,\d{2}\s*sem\s+juros"
COUPON_VALUE = r"(?i)(?:apply|aplicar)?\s*(?:R\$\s*)?([\d.,]+)\s*(?:coupon|cupom)"
# timed offers: store, pattern (group 1 the end), type, zone, source
PROMOTIONS = (
    ("terabyteshop", r"""(?i)\$\(\s*['"]#ctd(\d+)['"]\s*\)\.countdown\(\s*['"]([^'"]+)['"]""", "campaign_countdown", "America/Sao_Paulo", "terabyte.jquery.countdown"),
    ("mercadolivre", r"""(?i)lightning_deal_configuration"\s*:\s*\{\s*"finish_date"\s*:\s*"([^"]+)\"""", "lightning_deal", "UTC", "mercadolivre.lightning_deal_configuration"),
    ("mercadolivre", r"""(?i)["'](?:finish_date|expires_at|end_time|stop_time)["']\s*:\s*["']([^"']+)["']""", "lightning_deal", "UTC", "mercadolivre.html.finish_date"),
    ("shopee", r"""(?i)["'](?:end_time|end_timestamp|flash_sale_end_time)["']\s*:\s*(\d{10,13})""", "flash_sale", "UTC", "shopee.payload.end_time"),
)
VALID_UNTIL = r'(?i)"priceValidUntil"\s*:\s*"(\d{4}-\d{2}-\d{2})"'
