from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import trading as tr
from ..sources.tables import table
from .registry import query

_O = """
SELECT o_orderkey, substr('ABCDEFGH', (o_custkey % 7 + 1)::INT, (o_orderkey % 7)::INT) AS symbol, CASE o_orderkey % 5 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'STOP' WHEN 3 THEN 'limit' ELSE 'ICEBERG' END AS kind,
  (o_orderkey % 300 - 5)::DOUBLE AS qty, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1000 END AS price, o_totalprice / 1000 * (0.85 + (o_custkey % 30) / 100.0) AS ref, o_orderkey % 2 = 0 AS buy, o_orderdate::DATE AS day FROM orders"""
_REJECT = """CASE WHEN trim(symbol) = '' OR length(symbol) > 5 THEN 'symbol' WHEN upper(kind) NOT IN ('MARKET', 'LIMIT', 'STOP') THEN 'type' WHEN qty <= 0 OR qty <> floor(qty) THEN 'quantity'
  WHEN upper(kind) <> 'MARKET' AND (price IS NULL OR price <= 0) THEN 'price' WHEN upper(kind) <> 'MARKET' AND ref > 0 AND (price < ref * 0.9 OR price > ref * 1.1) THEN 'band' END"""


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") / 1000
    return o.select(
        "o_orderkey", F.substring(F.lit("ABCDEFGH"), (c % 7 + 1).cast("int"), (k % 7).cast("int")).alias("symbol"), F.element_at(F.array(*map(F.lit, ("MARKET", "LIMIT", "STOP", "limit", "ICEBERG"))), (k % 5 + 1).cast("int")).alias("kind"),
        (k % 300 - 5).cast("double").alias("qty"), F.when(k % 11 != 0, p).alias("price"), (p * (0.85 + (c % 30) / 100.0)).alias("ref"), (k % 2 == 0).alias("buy"), F.to_date("o_orderdate").alias("day"),
    )


def _checked(spark, sf_dir):
    return _orders(spark, sf_dir).withColumn("reason", tr.rejection(*(F.col(c) for c in ("symbol", "kind", "qty", "price", "ref"))))


@query(f"SELECT o_orderkey, {_REJECT} AS reason, qty % 100 <> 0 AS odd_lot FROM ({_O})")
def order_validate(spark, sf_dir):
    return _checked(spark, sf_dir).select("o_orderkey", "reason", (F.col("qty") % 100 != 0).alias("odd_lot"))


@query(f"SELECT coalesce({_REJECT}, 'accepted') AS outcome, count(*) AS n FROM ({_O}) GROUP BY 1")
def order_outcomes(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, CASE WHEN upper(kind) = 'MARKET' THEN 'IEX' ELSE 'NSDQ' END AS venue, round(CASE WHEN upper(kind) = 'MARKET' THEN 0.0009 ELSE -0.0025 END * qty, 4) AS fee FROM ({_O}) WHERE ({_REJECT}) IS NULL")
def order_route(spark, sf_dir):
    venue, fee = tr.route(F.upper("kind") == "MARKET")
    return _checked(spark, sf_dir).filter("reason is null").select("o_orderkey", venue.alias("venue"), F.round(fee * F.col("qty"), 4).alias("fee"))


@query(f"""
WITH a AS (SELECT * FROM ({_O}) WHERE ({_REJECT}) IS NULL), s AS (SELECT *, coalesce(price, ref) * qty AS principal FROM a)
SELECT o_orderkey, (day + CASE dayofweek(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::DATE AS settles, floor(principal * 100 + 0.5) / 100 AS principal, floor(CASE WHEN buy THEN 0 ELSE principal * 0.0000278 END * 10000 + 0.5) / 10000 AS sec_fee FROM s""")
def order_settle_t1(spark, sf_dir):
    a = _checked(spark, sf_dir).filter("reason is null").withColumn("principal", F.coalesce("price", "ref") * F.col("qty"))
    return a.select("o_orderkey", tr.add_business_days(F.col("day"), 1).alias("settles"), half_up(F.col("principal"), 2).alias("principal"), half_up(F.when(F.col("buy"), 0.0).otherwise(F.col("principal") * tr.SEC_FEE), 4).alias("sec_fee"))


@query("SELECT o_orderkey, (d + CASE WHEN dayofweek(d) IN (4, 5) THEN 4 WHEN dayofweek(d) = 6 THEN 3 ELSE 2 END)::DATE AS settles FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def settle_t2(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tr.add_business_days(F.to_date("o_orderdate"), 2).alias("settles"))


def _trades(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("at"), F.sum("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("price")).select(
        F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("id"), "at", F.when(F.col("l_orderkey") % 3 == 0, "Sell").otherwise("Buy").alias("side"), "quantity", "price"
    )


@query()
def fifo_lots(spark, sf_dir):
    """Realised gain, long-term shares and shortfall of each sell."""
    return tr.fifo(_trades(spark, sf_dir)).select("key", "id", *(F.round(c, 4).alias(c) for c in ("realised", "long_term", "short")))


_TRADES = "SELECT l_suppkey AS key, l_orderkey AS id, min(l_shipdate) AS day, CASE WHEN l_orderkey % 3 = 0 THEN 'Sell' ELSE 'Buy' END AS side, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey, l_orderkey"


@query(f"""
WITH c AS (SELECT *, sum(quantity) OVER (PARTITION BY key, side ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS high FROM ({_TRADES})),
x AS (SELECT s.key, s.id AS sell, b.id AS buy, least(s.high, b.high) - greatest(s.high - s.quantity, b.high - b.quantity) AS matched FROM c s JOIN c b ON s.key = b.key AND s.side = 'Sell' AND b.side = 'Buy' AND s.high - s.quantity < b.high AND b.high - b.quantity < s.high)
SELECT key, count(*) AS matches, round(sum(matched), 4) AS matched FROM x GROUP BY key""")
def fifo_interval_overlap(spark, sf_dir):
    x = tr.fifo_overlap(_trades(spark, sf_dir))
    return x.groupBy("key").agg(F.count("*").alias("matches"), F.round(F.sum("matched"), 4).alias("matched"))


#: Attributes of derivative orders made from the table; each expression reads the same in Spark and in the SQL.
_DERIVATIVE = {
    "o_orderkey": "o_orderkey",
    "asset": "CASE WHEN o_orderkey % 5 = 0 THEN 'BOND' WHEN o_orderkey % 5 = 1 THEN 'bond' WHEN o_custkey % 50 = 3 THEN 'SWAP' ELSE 'OPTION' END",
    "strategy": "CASE o_custkey % 6 WHEN 0 THEN 'SINGLE' WHEN 1 THEN 'VERTICAL_SPREAD' WHEN 2 THEN 'straddle' WHEN 3 THEN 'STRANGLE' WHEN 4 THEN NULL ELSE 'BUTTERFLY' END",
    "right1": "CASE o_orderkey % 3 WHEN 0 THEN 'CALL' WHEN 1 THEN 'put' ELSE 'PUT' END",
    "right2": "CASE WHEN o_custkey % 10 = 9 THEN NULL WHEN o_custkey % 4 < 2 THEN 'PUT' ELSE 'CALL' END",
    "strike1": "CASE WHEN o_orderkey % 97 = 2 THEN 0 ELSE 90 + (o_custkey % 4) * 5 END",
    "strike2": "90 + (o_orderkey % 4) * 5",
    "expiry1": "CASE WHEN o_orderkey % 7 < 4 THEN '2024-06' ELSE '2024-09' END",
    "expiry2": "CASE WHEN o_custkey % 7 < 4 THEN '2024-06' ELSE '2024-09' END",
    "price": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 20011.0 END",
    "underlying": "80 + o_custkey % 40",
    "quantity": "o_orderkey % 10 + 1",
    "buys": "o_orderkey % 2 = 0",
    "issuer": "CASE o_custkey % 3 WHEN 0 THEN 'TREASURY' WHEN 1 THEN 'treasury' ELSE 'CORPORATE' END",
    "coupon": "(o_custkey % 12 - 1) / 100.0",
    "face": "CASE WHEN o_custkey % 29 = 0 THEN 0 WHEN o_custkey % 29 < 9 THEN NULL ELSE 1000 END",
    "maturity": "CASE WHEN o_orderkey % 13 = 0 THEN 'never' ELSE '2030-01-15' END",
    "days": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 180 END",
}
_D = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _DERIVATIVE.items()) + " FROM orders"
_BOTH = "((upper(right1) = 'CALL' AND coalesce(upper(right2), '') = 'PUT') OR (upper(right1) = 'PUT' AND coalesce(upper(right2), '') = 'CALL'))"
_OPTION = f"""CASE upper(coalesce(strategy, 'SINGLE')) WHEN 'SINGLE' THEN CASE WHEN strike1 <= 0 THEN 'single' END
  WHEN 'VERTICAL_SPREAD' THEN CASE WHEN upper(right1) <> coalesce(upper(right2), '') OR expiry1 <> expiry2 OR strike1 = strike2 THEN 'vertical' END
  WHEN 'STRADDLE' THEN CASE WHEN NOT {_BOTH} OR strike1 <> strike2 OR expiry1 <> expiry2 THEN 'straddle' END
  WHEN 'STRANGLE' THEN CASE WHEN NOT {_BOTH} OR strike1 = strike2 OR expiry1 <> expiry2 THEN 'strangle' END ELSE 'strategy' END"""
_FAULT = f"CASE upper(asset) WHEN 'OPTION' THEN {_OPTION} WHEN 'BOND' THEN CASE WHEN try_cast(maturity AS DATE) IS NULL THEN 'maturity' WHEN coupon < 0 OR face <= 0 THEN 'terms' END ELSE 'asset' END"


def _derivatives(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _DERIVATIVE.items()))


@query(f"SELECT o_orderkey, {_FAULT} AS reason FROM ({_D})")
def option_validate(spark, sf_dir):
    """Checks of option strategies and bonds, the one that fails."""
    c = F.col
    option = tr.option_rejection(*map(c, ("strategy", "right1", "right2", "strike1", "strike2", "expiry1", "expiry2")))
    return _derivatives(spark, sf_dir).select("o_orderkey", tr.derivative_rejection(c("asset"), option, tr.bond_rejection(c("maturity"), c("coupon"), c("face"))).alias("reason"))


@query(f"""SELECT o_orderkey, round(CASE WHEN upper(asset) = 'BOND' THEN coalesce(price, 100) / 100 * coalesce(face, 1000) * quantity * CASE WHEN upper(issuer) = 'TREASURY' THEN 0.01 ELSE 0.1 END
  WHEN buys THEN coalesce(price, 0) * quantity * 100 WHEN upper(coalesce(strategy, 'SINGLE')) = 'VERTICAL_SPREAD' THEN greatest(0, abs(strike1 - strike2) - coalesce(price, 0)) * quantity * 100
  ELSE greatest(underlying * 0.2 - greatest(0, strike1 - underlying), underlying * 0.1) * quantity * 100 + coalesce(price, 0) * quantity * 100 END, 4) AS margin FROM ({_D})""")
def margin_requirement(spark, sf_dir):
    """Initial margin of bonds, options bought, spreads and naked positions sold."""
    margin = tr.initial_margin(*map(F.col, ("asset", "buys", "strategy", "price", "underlying", "strike1", "strike2", "quantity", "face", "issuer")))
    return _derivatives(spark, sf_dir).select("o_orderkey", F.round(margin, 4).alias("margin"))


@query(f"""
WITH v AS (SELECT o_orderkey, CASE WHEN upper(right1) = 'CALL' THEN greatest(0, underlying - strike1) ELSE greatest(0, strike1 - underlying) END::DOUBLE AS intrinsic, coalesce(price, 0) AS premium,
  coalesce(price, 100) AS clean, coupon / 2 * 100 * (coalesce(days, 90) / 180.0) AS accrued, upper(asset) AS asset FROM ({_D}))
SELECT o_orderkey, round(intrinsic, 4) AS intrinsic, round(greatest(0, premium - intrinsic), 4) AS extrinsic, round(accrued, 4) + 0.0 AS accrued, round(clean + accrued, 4) AS dirty FROM v""")
def derivative_pricing(spark, sf_dir):
    """Intrinsic and extrinsic value of the option, accrued interest and dirty price of the bond of each order's terms."""
    c = F.col
    intrinsic, extrinsic = tr.option_value(c("right1"), c("underlying"), c("strike1"), c("price"))
    accrued, dirty = tr.bond_price(c("price"), c("coupon"), F.lit(2), c("days"))
    return _derivatives(spark, sf_dir).select("o_orderkey", *((F.round(v, 4) + 0.0).alias(n) for n, v in (("intrinsic", intrinsic), ("extrinsic", extrinsic), ("accrued", accrued), ("dirty", dirty))))


_SPOT = {
    "o_orderkey": "o_orderkey",
    "symbol": "CASE o_custkey % 7 WHEN 0 THEN 'BTC/USD' WHEN 1 THEN 'eth-usdt' WHEN 2 THEN 'EUR/BTC' WHEN 3 THEN 'EURUSD' WHEN 4 THEN 'GBP/JPY' WHEN 5 THEN '/USD/' ELSE 'EUR-USD' END",
    "quantity": "(o_orderkey % 9 - 1) / 4.0",
    "price": "o_totalprice / 20011.0",
    "crypto": "o_custkey % 7 < 3",
    "sells": "o_orderkey % 3 = 0",
    "wallet": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '0xDEADBEEFsanctionedwalletaddress0001' ELSE concat('bc1q', substr('abcdefghijklmnopqrstuvwxyz0123456789', 1, cast(o_orderkey % 36 as int)), cast(o_custkey AS VARCHAR(20))) END",
    "mixer": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE (o_custkey % 10) / 10.0 END",
    "hops": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 5 END",
    "jurisdiction": "CASE o_custkey % 6 WHEN 0 THEN 'ir' WHEN 1 THEN NULL WHEN 2 THEN 'KP' ELSE 'DE' END",
}
_S = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SPOT.items()) + " FROM orders"


def _spot(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _SPOT.items()))


@query(f"""
WITH s AS (SELECT *, list_filter(regexp_split_to_array(upper(symbol), '[/-]'), lambda p: p <> '') AS pair FROM ({_S}))
SELECT o_orderkey, CASE WHEN len(pair) <> 2 THEN 'pair' WHEN quantity <= 0 THEN 'quantity' WHEN price * quantity > 0 AND price * quantity < CASE pair[2] WHEN 'USD' THEN 10 WHEN 'USDT' THEN 10 WHEN 'USDC' THEN 10 WHEN 'EUR' THEN 10 WHEN 'BTC' THEN 0.0001 ELSE 1 END THEN 'notional'
  WHEN crypto AND sells AND (length(coalesce(wallet, '')) < 26 OR length(coalesce(wallet, '')) > 62) THEN 'wallet' END AS reason FROM s""")
def fx_validate(spark, sf_dir):
    """Currency pairs, quantities, a least notional for each quote currency, and wallets."""
    reason = tr.spot_rejection(*map(F.col, ("symbol", "quantity", "price", "crypto", "sells", "wallet")))
    return _spot(spark, sf_dir).select("o_orderkey", reason.alias("reason"))


_BOOK = ", ".join(f"('{n}', {b}, {a}, {d}, {ms}, {k})" for k, (n, b, a, d, ms) in enumerate(tr.PROVIDERS))


@query(f"""
WITH q AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS buys, (o_orderkey % 20 + 1)::DOUBLE AS quantity, o_totalprice / 1000 * bf AS bid, o_totalprice / 1000 * af AS ask, provider, depth, place FROM orders, (VALUES {_BOOK}) v(provider, bf, af, depth, age, place) WHERE age <= 750),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN buys THEN ask ELSE -bid END, place) AS r FROM q) WHERE r = 1)
SELECT o_orderkey, provider, round(CASE WHEN buys THEN ask * 1.0005 ELSE bid * 0.9995 END, 6) AS price, round(CASE WHEN depth >= quantity THEN 0 ELSE (quantity - depth) / quantity * (ask - bid) END, 6) AS slippage FROM b""")
def quote_aggregation(spark, sf_dir):
    """The best fresh quote for each order, with markup and expected slippage."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("buys"), (F.col("o_orderkey") % 20 + 1).cast("double").alias("quantity"), (F.col("o_totalprice") / 1000).alias("mid"))
    best = tr.best_execution(tr.provider_quotes(o, "mid"), "o_orderkey", "buys", "quantity")
    return best.select("o_orderkey", "provider", F.round("price", 6).alias("price"), F.round("slippage", 6).alias("slippage"))


@query(f"""
WITH r AS (SELECT *, CASE WHEN coalesce(wallet, '') = '' THEN 0 ELSE greatest(0, least(1, ('0x' || substr(sha256(wallet), 1, 2))::INT / 255.0 * 0.4 + 0.4 * coalesce(mixer, 0) + 0.4 * CASE WHEN coalesce(hops, 6) <= 0 THEN 1 ELSE least(1, 1.0 / coalesce(hops, 6)) END)) END AS risk FROM ({_S}))
SELECT o_orderkey, round(risk, 6)::DOUBLE AS risk, CASE WHEN crypto THEN CASE WHEN lower(wallet) = '0xdeadbeefsanctionedwalletaddress0001' THEN 'listed' WHEN risk >= 0.75 THEN 'risk' END WHEN upper(coalesce(jurisdiction, 'US')) IN ('KP', 'IR', 'SY', 'CU') THEN 'jurisdiction' END AS reason FROM r""")
def counterparty_risk(spark, sf_dir):
    """Wallets by list and score (0.75 rejects), others by jurisdiction."""
    s = _spot(spark, sf_dir).withColumn("risk", tr.wallet_risk(F.col("wallet"), F.col("mixer"), F.col("hops")))
    return s.select("o_orderkey", F.round("risk", 6).alias("risk"), tr.screening_rejection(*map(F.col, ("crypto", "wallet", "risk", "jurisdiction"))).alias("reason"))
