"""Money: parsing, rounding, price choice and price checks (decimals only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONEY



def positive(amount: Column) -> Column:
    return F.when(amount > 0, amount)


def plain_money(text: Column) -> Column:
    """Money from JSON text: plain digits with an optional point, above zero, else NULL."""
    return positive(
        F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast(MONEY))
    )


def any_amount(text: Column) -> Column:
    """Any decimal notation that is finite and above zero, else NULL."""
    return positive(F.trim(text).try_cast(MONEY))


def parse_money(text: Column, currency: Column | None = None) -> Column:
    """Locale money text to DECIMAL(18,4), NULL when it is no amount above zero.

    BRL and PYG write points between thousands and a comma before the decimals.
    In other currencies a single comma without any point is the decimal sign;
    text that then still holds a comma is no amount.
    """
    raw = F.regexp_replace(F.translate(text, "−", "-"), r"[^0-9,.\-]", "")
    latin = F.translate(raw, ",.", ".")
    lone_comma = raw.rlike(r"^[^,.]*,[^,.]*$")
    other = F.when(lone_comma, F.translate(raw, ",", ".")).otherwise(raw)
    is_latin = F.lit(False) if currency is None else F.upper(F.trim(currency)).isin("BRL", "PYG")
    return positive(F.when(F.coalesce(is_latin, F.lit(False)), latin).otherwise(other).try_cast(MONEY))


def parse_rate_text(text: Column, kind: str = "decimal(24,12)") -> Column:
    """Rate text with a comma or point decimal; several points separate thousands."""
    raw = F.regexp_replace(text, r"[\u00a0\u200b\s]", "")
    commas = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".")
    points = F.when(
        F.length(raw) - F.length(F.regexp_replace(raw, r"\.", "")) > 1,
        F.regexp_replace(raw, r"\.", ""),
    ).otherwise(raw)
    return F.when(raw.contains(","), commas).otherwise(points).try_cast(kind)


def round_cents(amount: Column) -> Column:
    """Half-up to 0.01."""
    return F.round(amount, 2)


def currency_code(text: Column) -> Column:
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def price_choice(payload: Column, promotional: bool | Column = False) -> tuple[Column, Column]:
    """The price to show and its kind: promotion (if asked for), pix, regular, original."""
    chain = [
        (any_amount(payload["pix_price"]), "pix"),
        (any_amount(payload["price"]), "regular"),
        (any_amount(payload["original_price"]), "regular"),
    ]
    wanted = promotional if isinstance(promotional, Column) else F.lit(bool(promotional))
    promo = payload["promotion_payload"]
    special = F.when(
        wanted,
        F.coalesce(
            any_amount(payload["promotion_price"]),
            any_amount(promo["promotion_price"]),
            any_amount(promo["price"]),
        ),
    )
    amount = F.coalesce(special, *[a for a, _ in chain])
    kind = F.when(special.isNotNull(), F.lit("promotion"))
    for value, name in chain:
        kind = kind.when(value.isNotNull(), F.lit(name))
    return amount, kind


def commercial(payload: Column) -> Column:
    return F.coalesce(
        plain_money(payload["pix_price"]),
        plain_money(payload["price"]),
        plain_money(payload["original_price"]),
    )


def direction(old: Column, new: Column, old_currency: Column, currency: Column) -> Column:
    """decreased, increased or unchanged; NULL unless both are in one known currency."""
    same = old.isNotNull() & new.isNotNull() & (old_currency == currency)
    return F.when(
        same,
        F.when(new < old, F.lit("decreased"))
        .when(new > old, F.lit("increased"))
        .otherwise(F.lit("unchanged")),
    )


def discount_percent(price: Column, original: Column, pix: Column) -> Column:
    """Percent off from original to the cash price (or the card price), two decimals."""
    paid = F.coalesce(pix, price)
    ok = original.isNotNull() & paid.isNotNull() & (original > 0) & (original > paid)
    off = (original - paid) * F.lit(100) / original
    return F.when(ok, F.round(off.cast("decimal(18,8)"), 2))


def consistency_warnings(original: Column, pix: Column, card: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(original < pix, F.lit("original_lt_pix")),
            F.when(original < card, F.lit("original_lt_card")),
            F.when(pix > card, F.lit("pix_gt_card")),
        )
    )


def original_from_instalments(total: Column, cash_percent: Column, price: Column) -> Column:
    """The instalment total, if taking the cash discount off it gives the price back within a few cents."""
    wide = "decimal(24,8)"
    expected = (total.cast(MONEY) * (F.lit(100) - cash_percent.cast("decimal(6,2)"))).cast("decimal(30,8)") / F.lit(100).cast("decimal(3,0)")
    room = F.greatest(F.lit("0.05").cast(wide), (total.cast(MONEY) * F.lit("0.0005").cast("decimal(8,6)")).cast(wide))
    ok = (total > price) & (F.abs(expected.cast(wide) - price.cast(wide)) <= room)
    return F.when(ok, total)


def price_extreme(left: Column, right: Column, left_currency: Column, right_currency: Column) -> Column:
    """One price at least four times the other. Two different currencies never compare."""
    comparable = (left > 0) & (right > 0) & F.coalesce(left_currency == right_currency, F.lit(True))
    return F.coalesce(comparable & (F.greatest(left, right) >= F.least(left, right) * F.lit(4)), F.lit(False))
