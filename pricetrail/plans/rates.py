"""Registered queries over exchange rates and money."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import fx
from ..schema import RATE
from .views import table, utc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as fetched rates: pair by customer, type by priority, rate from the total."""
    cust, total = F.col("o_custkey"), F.col("o_totalprice").cast("decimal(18,2)")
    scale = lambda text, kind: (total * F.lit(text).cast(kind)).cast(RATE)
    # every eighth quote moves freely; the others stay close to a level, as real quotes do
    free = F.col("o_orderkey") % 8 == 0
    near = lambda text: (F.lit(text).cast(RATE) + (total * F.lit("0.0000001").cast("decimal(8,7)")).cast(RATE)).cast(RATE)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(cust % 3 == 2, "PYG").otherwise("USD").alias("base_currency"),
        F.when(cust % 3 == 1, "PYG").otherwise("BRL").alias("quote_currency"),
        F.element_at(
            F.array(*[F.lit(t) for t in ("tourism_sell", "official", "ptax_sell", "market", "ptax_buy")]),
            F.substring("o_orderpriority", 1, 1).cast("int"),
        ).alias("rate_type"),
        F.when((cust % 3 == 0) & free, scale("0.00002", "decimal(8,5)"))
        .when(cust % 3 == 0, near("5.1"))
        .when((cust % 3 == 1) & free, scale("0.02", "decimal(8,2)"))
        .when(cust % 3 == 1, near("7300"))
        .when(free, scale("0.00000001", "decimal(9,8)"))
        .otherwise((F.lit("0.0007").cast(RATE) + (total * F.lit("0.0000000001").cast("decimal(11,10)")).cast(RATE)).cast(RATE))
        .alias("rate"),
        F.when(F.col("o_orderkey") % 4 == 0, "bcb_ptax").when(F.col("o_orderkey") % 4 == 1, "valor_data").otherwise("bcp_referential").alias("source"),
        utc("o_orderdate").alias("fetched_at"),
        F.date_format(utc("o_orderdate"), "yyyy-MM-dd").alias("batch_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "fresh").otherwise("stale").alias("status"),
    )


QUOTES_SQL = """
q AS (
  SELECT o_orderkey AS seq, CASE WHEN o_custkey % 3 = 2 THEN 'PYG' ELSE 'USD' END AS base_currency,
    CASE WHEN o_custkey % 3 = 1 THEN 'PYG' ELSE 'BRL' END AS quote_currency,
    (['tourism_sell', 'official', 'ptax_sell', 'market', 'ptax_buy'])[CAST(left(o_orderpriority, 1) AS INTEGER)] AS rate_type,
    CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 8 = 0 THEN CAST(t * CAST(0.00002 AS DECIMAL(8,5)) AS DECIMAL(24,12))
      WHEN o_custkey % 3 = 0 THEN CAST(5.1 + CAST(t * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(24,12)) AS DECIMAL(24,12))
      WHEN o_custkey % 3 = 1 AND o_orderkey % 8 = 0 THEN CAST(t * CAST(0.02 AS DECIMAL(8,2)) AS DECIMAL(24,12))
      WHEN o_custkey % 3 = 1 THEN CAST(7300 + CAST(t * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(24,12)) AS DECIMAL(24,12))
      WHEN o_orderkey % 8 = 0 THEN CAST(t * CAST(0.00000001 AS DECIMAL(9,8)) AS DECIMAL(24,12))
      ELSE CAST(CAST(0.0007 AS DECIMAL(24,12)) + CAST(t * CAST(0.0000000001 AS DECIMAL(11,10)) AS DECIMAL(24,12)) AS DECIMAL(24,12)) END AS rate,
    CASE o_orderkey % 4 WHEN 0 THEN 'bcb_ptax' WHEN 1 THEN 'valor_data' ELSE 'bcp_referential' END AS source,
    o_orderdate AS fetched_at, strftime(o_orderdate, '%Y-%m-%d') AS batch_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'fresh' ELSE 'stale' END AS status
  FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders)
),
chk AS (SELECT *, NOT rate > 0 AS bad, CASE WHEN base_currency = 'USD' AND quote_currency = 'BRL' THEN rate NOT BETWEEN 2 AND 15
    WHEN base_currency = 'PYG' THEN rate NOT BETWEEN 0.00005 AND 0.01 ELSE rate NOT BETWEEN 500 AND 100000 END AS outside FROM q),
latest AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY base_currency, quote_currency, rate_type ORDER BY fetched_at DESC, seq DESC) = 1)"""

ORDER = ["fetched_at", "seq"]


@query(
    "fx_latest",
    "WITH " + QUOTES_SQL + " SELECT base_currency, quote_currency, rate_type, rate, source, epoch_us(fetched_at) AS fetched_us FROM latest",
)
def fx_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latest_rates(quotes(spark, sf_dir), ORDER).select(
        *fx.RATE_KEY, "rate", "source", F.unix_micros("fetched_at").alias("fetched_us")
    )


@query(
    "fx_convert",
    "WITH " + QUOTES_SQL + """,
    pick AS (SELECT base_currency AS currency, rate, rate_type, status FROM latest WHERE quote_currency = 'BRL'
      AND ((base_currency = 'USD' AND rate_type = 'tourism_sell') OR (base_currency = 'PYG' AND rate_type = 'official'))),
    p AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount,
      (['BRL', 'USD', 'PYG', 'EUR'])[CAST(l_suppkey % 4 AS INTEGER) + 1] AS currency FROM lineitem)
    SELECT p.currency, coalesce(pick.rate_type, CASE WHEN p.currency = 'BRL' THEN 'official' END) AS fx_rate_type,
      CASE WHEN p.currency = 'BRL' THEN 'fresh' WHEN pick.rate IS NULL THEN 'unavailable' ELSE pick.status END AS fx_status,
      count(*) AS prices, CAST(sum(CASE WHEN p.currency = 'BRL' THEN amount
        ELSE round(CAST(amount AS DECIMAL(26,6)) * CAST(pick.rate AS DECIMAL(12,12)), 2) END) AS DECIMAL(38,4)) AS total
    FROM p LEFT JOIN pick ON pick.currency = p.currency GROUP BY ALL""".replace(
        "round(CAST(amount AS DECIMAL(26,6)) * CAST(pick.rate AS DECIMAL(12,12)), 2)",
        "round(CAST(amount AS DECIMAL(14,2)) * CAST(pick.rate AS DECIMAL(24,12)), 2)",
    ),
)
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    currencies = F.array(*[F.lit(c) for c in ("BRL", "USD", "PYG", "EUR")])
    prices = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"),
        F.element_at(currencies, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("currency"),
    )
    latest = fx.latest_rates(quotes(spark, sf_dir), ORDER)
    return fx.convert(prices, latest).groupBy("currency", "fx_rate_type", "fx_status").agg(
        F.count("*").alias("prices"), F.sum("converted_amount").cast("decimal(38,4)").alias("total")
    )


@query(
    "fx_validate",
    "WITH " + QUOTES_SQL + """ SELECT c.seq, concat_ws(',', CASE WHEN c.bad THEN 'not_positive' END,
      CASE WHEN NOT c.bad AND c.outside THEN 'outside_band' END,
      CASE WHEN NOT c.bad AND l.rate > 0 AND abs(c.rate - l.rate) * 100 > l.rate * 15 THEN 'jump' END) AS errors
    FROM chk c LEFT JOIN latest l USING (base_currency, quote_currency, rate_type)""",
)
def fx_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = quotes(spark, sf_dir)
    tagged = fx.validate_batch(rates, fx.latest_rates(rates, ORDER))
    return tagged.select("seq", F.array_join("errors", ",").alias("errors"))


@query(
    "fx_jump",
    "WITH " + QUOTES_SQL + """ SELECT seq, previous > 0 AND abs(rate - previous) * 100 > previous * 15 AS jump FROM (
      SELECT seq, rate, lag(rate) OVER (PARTITION BY base_currency, quote_currency, rate_type ORDER BY fetched_at, seq) AS previous FROM q)
    """.replace("SELECT seq, previous > 0 AND", "SELECT seq, coalesce(previous > 0, false) AND").replace("previous * 15 AS jump", "previous * 15 AS jump"),
)
def fx_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.jumps_between_neighbours(quotes(spark, sf_dir), ORDER).select("seq", "jump")


@query(
    "fx_accept",
    "WITH RECURSIVE " + QUOTES_SQL + """,
    n AS (SELECT *, row_number() OVER (PARTITION BY base_currency, quote_currency, rate_type ORDER BY fetched_at, seq) AS rn FROM chk),
    walk AS (
      SELECT base_currency, quote_currency, rate_type, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::DECIMAL(24,12) AS last, NULL::DECIMAL(24,12) AS before, false AS valid
      FROM (SELECT DISTINCT base_currency, quote_currency, rate_type FROM n)
      UNION ALL
      SELECT base_currency, quote_currency, rate_type, rn, seq, CASE WHEN ok THEN rate ELSE last END, last, ok
      FROM (SELECT n.*, w.last, NOT n.bad AND NOT n.outside AND NOT coalesce(w.last > 0 AND abs(n.rate - w.last) * 100 > w.last * 15, false) AS ok
        FROM walk w JOIN n ON n.base_currency = w.base_currency AND n.quote_currency = w.quote_currency AND n.rate_type = w.rate_type AND n.rn = w.rn + 1)
    )
    SELECT seq, before AS last_accepted, valid FROM walk WHERE rn > 0""",
)
def fx_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.accept_in_order(quotes(spark, sf_dir), ORDER).select("seq", "last_accepted", "valid")


@query(
    "fx_refresh_summary",
    "WITH " + QUOTES_SQL + """,
    bank AS (SELECT DISTINCT batch_id FROM chk WHERE source = 'bcb_ptax' AND rate_type = 'ptax_sell' AND NOT bad AND NOT outside)
    SELECT batch_id, count(*) AS fetched, count(*) FILTER (NOT bad AND NOT outside) AS valid, count(*) FILTER (bad OR outside) AS rejected,
      count(*) FILTER (NOT bad AND NOT outside AND NOT (bank.batch_id IS NOT NULL AND source = 'valor_data' AND rate_type IN ('ptax_buy', 'ptax_sell'))) AS persisted,
      coalesce(bool_or(source = 'bcp_referential'), false) AS fallback_used
    FROM chk LEFT JOIN bank USING (batch_id) GROUP BY batch_id""",
)
def fx_refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = fx.prefer_central_bank(fx.validate_batch(quotes(spark, sf_dir)))
    return fx.refresh_summary(tagged.withColumn("fallback", F.col("source") == "bcp_referential"))


@query(
    "fx_cross_checks",
    "WITH " + QUOTES_SQL + """,
    f AS (SELECT batch_id, max(rate) FILTER (rate_type = 'tourism_sell') AS t, max(rate) FILTER (rate_type = 'ptax_sell' AND source <> 'bcb_ptax') AS n,
      max(rate) FILTER (rate_type = 'ptax_sell' AND source = 'bcb_ptax') AS b FROM chk
      WHERE base_currency = 'USD' AND quote_currency = 'BRL' AND NOT bad AND NOT outside GROUP BY batch_id)
    SELECT batch_id, coalesce(coalesce(b, n) > 0 AND (t < coalesce(b, n) OR t * 100 > coalesce(b, n) * 112), false) AS tourism_warning,
      coalesce(b > 0 AND abs(n - b) * 1000 > b * 5, false) AS ptax_warning FROM f""",
)
def fx_cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cross_checks(fx.validate_batch(quotes(spark, sf_dir))).select("batch_id", "tourism_warning", "ptax_warning")


@query(
    "fx_source_fallback",
    "WITH " + QUOTES_SQL + """ SELECT batch_id, base_currency, quote_currency, source, count(*) AS rates FROM (
      SELECT *, CASE source WHEN 'bcp_referential' THEN 1 ELSE 2 END AS r FROM q WHERE source <> 'valor_data'
      QUALIFY r = min(r) OVER (PARTITION BY batch_id, base_currency, quote_currency)) GROUP BY ALL""",
)
def fx_source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["batch_id", *fx.PAIR]
    return fx.first_source(quotes(spark, sf_dir), ["bcp_referential", "bcb_ptax"], key).groupBy(*key, "source").agg(
        F.count("*").alias("rates")
    )


@query(
    "fx_diagnostics",
    "WITH " + QUOTES_SQL + """ SELECT (SELECT CAST(count(*) FILTER (status = 'stale') AS BIGINT) FROM latest) AS stale_count,
      'USD/EUR' AS unavailable_pairs""",
)
def fx_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("USD", "BRL"), ("PYG", "BRL"), ("USD", "PYG"), ("USD", "EUR")]
    return fx.diagnostics(fx.latest_rates(quotes(spark, sf_dir), ORDER), pairs)


@query(
    "money_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 OR (o_orderkey % 2 = 1 AND o_orderkey % 3 = 2 AND o_totalprice >= 1000) THEN NULL
      ELSE CAST(o_totalprice AS DECIMAL(18,4)) END AS amount FROM orders""",
)
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals written the Brazilian way, plainly, with a decimal comma, and with both signs, then parsed back."""
    key = F.col("o_orderkey")
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = (
        F.when(key % 5 == 4, F.concat(F.lit("-"), plain))
        .when(key % 2 == 0, F.concat(F.lit("R$ "), F.translate(us, ",.", ".,")))
        .when(key % 3 == 0, F.concat(F.lit("US$"), plain))
        .when(key % 3 == 1, F.concat(F.translate(plain, ".", ","), F.lit(" USD")))
        .otherwise(F.concat(F.lit("US$"), us))
    )
    currency = F.when(key % 2 == 0, "BRL").otherwise("USD")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), currency.alias("currency"))
    return rows.select("o_orderkey", money.parse_money(F.col("text"), F.col("currency")).alias("amount"))


@query(
    "price_checks",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,4)) AS original,
        CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS price,
        CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.97 AS DECIMAL(4,2)) AS DECIMAL(18,4)) END AS pix FROM lineitem)
    SELECT concat_ws(',', CASE WHEN original < pix THEN 'original_lt_pix' END,
      CASE WHEN original < price THEN 'original_lt_card' END,
      CASE WHEN pix > price THEN 'pix_gt_card' END) AS warnings, count(*) AS offers,
      count(*) FILTER (original > coalesce(pix, price)) AS discounted FROM p GROUP BY 1""",
)
def price_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem").select(
        base.cast("decimal(18,4)").alias("original"),
        (base * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, (base * F.lit("0.97").cast("decimal(4,2)")).cast("decimal(18,4)")).alias("pix"),
    )
    warnings = money.consistency_warnings(F.col("original"), F.col("pix"), F.col("price"))
    off = money.discount_percent(F.col("price"), F.col("original"), F.col("pix"))
    return rows.groupBy(F.array_join(warnings, ",").alias("warnings")).agg(
        F.count("*").alias("offers"), F.count(off).alias("discounted")
    )


@query(
    "fx_failures",
    "WITH " + QUOTES_SQL + """,
    f AS (SELECT *, seq % 3 <> 0 AND seq % 32 < 20 AS ok FROM q),
    g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY base_currency, quote_currency, rate_type ORDER BY fetched_at, seq) AS island FROM f)
    SELECT seq, base_currency, quote_currency, rate_type, ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (
      PARTITION BY base_currency, quote_currency, rate_type, island ORDER BY fetched_at, seq) AS BIGINT) AS failures_in_a_row FROM g""",
)
def fx_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as fetches, some of which fail: failures in a row of each pair and type, none after a fetch that worked."""
    fetches = quotes(spark, sf_dir).withColumn("ok", (F.col("seq") % 3 != 0) & (F.col("seq") % 32 < 20))
    return fx.failure_counts(fetches, ["fetched_at", "seq"]).select(
        "seq", *fx.RATE_KEY, "ok", F.col("failures_in_a_row").cast("long").alias("failures_in_a_row")
    )


@query(
    "fx_freshness",
    f"""WITH r AS (SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'broken' END AS status, epoch(o_orderdate) AS fetched FROM orders)
    SELECT seq, status, CASE WHEN status IN ('fresh', 'unavailable') THEN status
      WHEN fetched < epoch(TIMESTAMP '1996-01-01') - {fx.STALE_AFTER_SECONDS} THEN 'stale' ELSE 'fresh' END AS freshness FROM r""",
)
def fx_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with a known, an unknown or no status: what their age makes of them."""
    k, now = F.col("seq"), F.lit("1996-01-01").cast("timestamp")
    rows = quotes(spark, sf_dir).select("seq", "fetched_at", F.when(k % 4 == 0, "fresh").when(k % 4 == 1, "unavailable").when(k % 4 == 2, "broken").alias("status"))
    return rows.select("seq", "status", fx.freshness(F.col("status"), F.col("fetched_at"), now).alias("freshness"))


@query(
    "price_plausibility",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,4)) AS price, CAST(l_quantity AS BIGINT) * 1000 AS other,
        ([21.00, 20.00, 20.04])[l_linenumber % 3 + 1] AS pct, ([NULL, 'BRL', 'USD'])[l_linenumber % 3 + 1] AS currency FROM lineitem),
    t AS (SELECT *, CAST(price * CAST(1.25 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS total FROM p)
    SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id, price,
      CASE WHEN total > price AND abs(total * (100 - pct) / 100 - price) <= greatest(0.05, total * 0.0005) THEN total END AS original,
      price > 0 AND other > 0 AND coalesce(currency = 'BRL', true) AND greatest(price, other) >= 4 * least(price, other) AS extreme FROM t""",
)
def price_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices against an instalment total with a cash discount, and against a second price in the same, another or no currency."""
    kind = F.col("l_linenumber") % 3
    price, other = F.col("l_extendedprice").cast("decimal(18,4)"), (F.col("l_quantity").cast("long") * 1000).cast("decimal(18,4)")
    percent = F.when(kind == 0, F.lit("21.00")).when(kind == 1, F.lit("20.00")).otherwise(F.lit("20.04")).cast("decimal(6,2)")
    total = (price * F.lit("1.25").cast("decimal(3,2)")).cast("decimal(18,4)")
    currency = F.when(kind == 1, "BRL").when(kind == 2, "USD")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), price.alias("price"),
        money.original_from_instalments(total, percent, price).alias("original"),
        money.price_extreme(price, other, F.lit("BRL"), currency).alias("extreme"),
    )
