"""Exchange rates from archived responses (source, fetched_at, body). One batch job for all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import parse_rate_text
from ..functions.patterns import let, rx, rx_all
from ..functions.text import fold_key
from ..schema import RATE

ROW = T.ArrayType(
    T.StructType(
        [
            T.StructField("base_currency", T.StringType()), T.StructField("quote_currency", T.StringType()),
            T.StructField("rate_type", T.StringType()), T.StructField("rate", RATE), T.StructField("source_timestamp", T.TimestampType()),
        ]
    )
)
# The JSON answer of the central bank, and table rows of the pages.
PTAX_JSON = "struct<value:array<struct<cotacaoCompra:decimal(24,12),cotacaoVenda:decimal(24,12),dataHoraCotacao:string>>>"
TABLE_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
INTERBANK_TABLE = r"""(?is)<table[^>]+id=["']?cotizacion-interbancaria["']?(.*?)</table>"""
TICKER = r"""(?is)data-symbol=["']USDBRLT_VALR["'][^>]*>.*?ticker__item__value[^>]*>\s*R\$\s*([0-9.,]+)\s*<"""
CONVERTER_PTAX = r"""(?is)Converter\(\{quotes:.*?"USDBRL_BCBR"\s*:\s*\{.*?"lastQuote"\s*:\s*"?([0-9.,]+)"""
DAY = r"(\d{2})/(\d{2})/(\d{4})"


def _row(base: str, quote: str, kind: str, rate: Column, at: Column | None = None) -> Column:
    return F.struct(
        F.lit(base).alias("base_currency"), F.lit(quote).alias("quote_currency"), F.lit(kind).alias("rate_type"),
        rate.cast(RATE).alias("rate"), (F.lit(None) if at is None else at).cast("timestamp").alias("source_timestamp"),
    )


def _rows(*rows: Column) -> Column:
    return F.filter(F.array(*rows), lambda r: r["rate"] > 0).cast(ROW)


def ptax_json(body: Column) -> Column:
    """Buy and sell of the newest quote."""
    def made(q):
        at = F.try_to_timestamp(F.left(q["dataHoraCotacao"], F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss"))
        return _rows(
            _row("USD", "BRL", "ptax_buy", q["cotacaoCompra"], at), _row("USD", "BRL", "ptax_sell", q["cotacaoVenda"], at)
        )

    newest = F.get(F.from_json(body, PTAX_JSON)["value"], F.lit(0))
    return F.when(newest["cotacaoCompra"].isNotNull() & newest["cotacaoVenda"].isNotNull(), let(newest, made))


def _cells(html: Column) -> Column:
    """Table rows as arrays of cell texts."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "&nbsp;| ", " "))
    return F.transform(rx_all(html, TABLE_ROW, 1), lambda r: F.transform(rx_all(r, CELL, 1), clean))


def _day(text: Column, clock: Column | None = None) -> Column:
    date = F.concat_ws("-", rx(text, DAY, 3), rx(text, DAY, 2), rx(text, DAY, 1))
    return F.try_to_timestamp(date if clock is None else F.concat_ws(" ", date, clock), F.lit("yyyy-MM-dd" if clock is None else "yyyy-MM-dd HH:mm"))


def local_currency_page(html: Column) -> Column:
    """Newest dated row; the fifth cell is BRL per guarani."""
    dated = F.filter(_cells(html), lambda r: F.get(r, F.lit(0)).rlike(DAY) & (F.size(r) >= 5))
    return let(
        F.get(dated, F.lit(0)),
        lambda r: _rows(_row("PYG", "BRL", "official", parse_rate_text(F.get(r, F.lit(4))), _day(F.get(r, F.lit(0))))),
    )


def reference_page(html: Column) -> Column:
    """Guaranis per dollar and per real (symbol in the second cell, rate in the fourth)."""
    def made(rows):
        per = lambda s: parse_rate_text(F.get(F.get(F.filter(rows, lambda r: F.upper(F.get(r, F.lit(1))) == s), F.lit(0)), F.lit(3)))
        inverse = F.when(per("BRL") > 0, F.lit(1).cast("decimal(24,12)") / per("BRL"))
        return F.when(per("USD").isNotNull() & inverse.isNotNull(), _rows(_row("USD", "PYG", "official", per("USD")), _row("PYG", "BRL", "official", inverse)))

    return let(_cells(rx(html, INTERBANK_TABLE, 1)), made)


def newspaper_page(html: Column) -> Column:
    """Tourism and PTAX rows of the table, else the tourism ticker and the converter's PTAX."""
    def made(rows):
        def named(test):
            return F.get(F.filter(rows, lambda r: test(fold_key(F.get(r, F.lit(0)))) & (F.size(r) >= 3)), F.lit(0))

        def pair(row, buy, sell):
            last = F.get(row, F.size(row) - 1)
            at = _day(last, rx(last, r"(\d{2}:\d{2})", 1))
            return [_row("USD", "BRL", buy, parse_rate_text(F.get(row, F.lit(1))), at), _row("USD", "BRL", sell, parse_rate_text(F.get(row, F.lit(2))), at)]

        tourism = named(lambda n: n.contains("dolar turismo"))
        ptax = named(lambda n: n.contains("ptax") & n.contains("dolar"))
        ticker = _rows(
            _row("USD", "BRL", "tourism_sell", parse_rate_text(rx(html, TICKER, 1))),
            _row("USD", "BRL", "ptax_buy", parse_rate_text(rx(html, CONVERTER_PTAX, 1))),
            _row("USD", "BRL", "ptax_sell", parse_rate_text(rx(html, CONVERTER_PTAX, 1))),
        )
        table = _rows(*pair(tourism, "tourism_buy", "tourism_sell"), *pair(ptax, "ptax_buy", "ptax_sell"))
        return F.when(tourism.isNotNull(), table).otherwise(ticker)

    return let(_cells(html), made)


# Source names.
PARSERS = {
    "bcb_ptax": ptax_json, "bcb_sml": local_currency_page, "bcp_referential": reference_page, "valor_data": newspaper_page,
}


def rates(archive: DataFrame) -> DataFrame:
    """Rate rows of an archive of responses, one row per rate."""
    chain = None
    for name, parser in PARSERS.items():
        hit = F.col("source") == name
        made = parser(F.col("body")).cast(ROW)
        chain = F.when(hit, made) if chain is None else chain.when(hit, made)
    rest = [c for c in archive.columns if c != "body"]
    return archive.withColumn("__r", F.explode(chain)).select(*rest, "__r.*")


def unreadable(archive: DataFrame) -> DataFrame:
    """Responses that gave no rate."""
    chain = None
    for name, parser in PARSERS.items():
        hit = F.col("source") == name
        made = parser(F.col("body")).cast(ROW)
        chain = F.when(hit, made) if chain is None else chain.when(hit, made)
    return archive.where(F.coalesce(F.size(chain), F.lit(0)) <= 0).drop("body")
