"""Order stages as column expressions, FIFO lots, ledger; every stage fails an order at most once, and the first failure stands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Venues with taker fee, maker rebate and liquidity; fee per dollar of sales; price band.
VENUES = (("ARCA", 0.0030, 0.0020, 0.35), ("NSDQ", 0.0030, 0.0025, 0.30), ("EDGX", 0.0029, 0.0021, 0.15), ("IEX", 0.0009, 0.0000, 0.20))
SEC_FEE, BAND = 0.0000278, 0.10
# Least notional by quote currency (1 for others), liquidity providers with bid and ask factors, depth and
# age in milliseconds, freshness window and markup, listed wallets and jurisdictions, and the score that escalates.
LEAST_NOTIONAL = {"USD": 10.0, "USDT": 10.0, "USDC": 10.0, "EUR": 10.0, "BTC": 0.0001}
PROVIDERS = (("LP-CUMBERLAND", 0.9995, 1.0004, 5.0, 120), ("LP-B2C2", 0.9994, 1.0005, 12.0, 300), ("LP-JUMP", 0.9996, 1.0003, 3.0, 90), ("LP-STALE", 0.9990, 1.0001, 50.0, 2000))
FRESH_MS, MARKUP = 750, 0.0005
LISTED_WALLETS = ("1BadActorSanctionedWalletAddrXXXXXXX", "0xdeadbeefsanctionedwalletaddress0001")
LISTED_JURISDICTIONS = ("KP", "IR", "SY", "CU")
ESCALATES = 0.75


def attribute(attributes: Column, key: str, default: float) -> Column:
    """A number from an open map, or the default."""
    return F.coalesce(F.try_to_number(F.get(F.filter(F.array(attributes[key]), lambda x: x.rlike(r"^-?\d+(\.\d+)?$")), 0), F.lit("S999999999D9999999")).cast("double"), F.lit(default))


def rejection(symbol: Column, kind: Column, quantity: Column, limit_price: Column, reference: Column) -> Column:
    """The first failing check of an equity order, or null."""
    priced = F.upper(kind) != "MARKET"
    return (
        F.when(symbol.isNull() | (F.trim(symbol) == "") | (F.length(symbol) > 5), "symbol")
        .when(kind.isNull() | ~F.upper(kind).isin("MARKET", "LIMIT", "STOP"), "type")
        .when(quantity.isNull() | (quantity <= 0) | (quantity != F.floor(quantity)), "quantity")
        .when(priced & (limit_price.isNull() | (limit_price <= 0)), "price")
        .when(priced & (reference > 0) & ((limit_price < reference * (1 - BAND)) | (limit_price > reference * (1 + BAND))), "band")
    )


def order_record(reason: Column, journal: Column) -> tuple[Column, Column]:
    """Status of an order that went through all stages or failed one, and its journal as one text."""
    return F.when(reason.isNull(), "FILLED").otherwise("REJECTED"), F.array_join(journal, " | ")


def add_business_days(day: Column, n: int) -> Column:
    """The n-th day after that is no Saturday or Sunday."""
    ahead = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, n + 2 * (n // 5 + 1) + 2)), lambda d: ~F.dayofweek(d).isin(1, 7))
    return F.element_at(ahead, n)


def route(marketable: Column) -> tuple[Column, Column]:
    """Venue and fee per share: least taker fee net of price improvement, or greatest maker rebate; the first of equals."""
    taker = min(VENUES, key=lambda v: v[1] - v[3] * 0.0001)
    maker = max(VENUES, key=lambda v: v[2])
    return F.when(marketable, taker[0]).otherwise(maker[0]), F.when(marketable, taker[1]).otherwise(-maker[2])


def _text(value: Column, default: str = "") -> Column:
    return F.upper(F.coalesce(value, F.lit(default)))


def _number(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.cast("double"), F.lit(default))


def option_rejection(strategy: Column, right1: Column, right2: Column, strike1: Column, strike2: Column, expiry1: Column, expiry2: Column) -> Column:
    """The failing check of an option order by its strategy (single if none is given), or null. Rights are compared without case."""
    s, r1, r2 = _text(strategy, "SINGLE"), _text(right1), _text(right2)
    k1, k2, e1, e2 = _number(strike1), _number(strike2), F.coalesce(expiry1, F.lit("")), F.coalesce(expiry2, F.lit(""))
    both = ((r1 == "CALL") & (r2 == "PUT")) | ((r1 == "PUT") & (r2 == "CALL"))
    return (
        F.when(s == "SINGLE", F.when(~r1.isin("CALL", "PUT") | (k1 <= 0), "single"))
        .when(s == "VERTICAL_SPREAD", F.when((r1 != r2) | (e1 != e2) | (k1 == k2), "vertical"))
        .when(s == "STRADDLE", F.when(~both | (k1 != k2) | (e1 != e2), "straddle"))
        .when(s == "STRANGLE", F.when(~both | (k1 == k2) | (e1 != e2), "strangle"))
        .otherwise("strategy")
    )


def bond_rejection(maturity: Column, coupon: Column, face: Column) -> Column:
    """The first failing check of a bond order, or null: a readable maturity date, a coupon of 0 or more, a face value over 0 (1000 if none)."""
    return F.when(maturity.try_cast("date").isNull(), "maturity").when((_number(coupon) < 0) | (_number(face, 1000.0) <= 0), "terms")


def derivative_rejection(asset: Column, option: Column, bond: Column) -> Column:
    """The check of the order's kind of asset, given the checks of both kinds."""
    return F.when(_text(asset) == "OPTION", option).when(_text(asset) == "BOND", bond).otherwise("asset")


def initial_margin(asset: Column, buys: Column, strategy: Column, price: Column, underlying: Column, strike1: Column, strike2: Column, quantity: Column, face: Column, issuer: Column) -> Column:
    """Initial margin: of a bond a hundredth (treasuries) or tenth of its notional; of an option bought its premium, of a
    vertical spread sold its greatest loss, of another sold the greater of two rules; a contract is 100."""
    premium = _number(price)
    spread = F.greatest(F.lit(0.0), F.abs(_number(strike1) - _number(strike2)) - premium)
    out = F.greatest(F.lit(0.0), _number(strike1) - _number(underlying))
    naked = F.greatest(_number(underlying) * 0.20 - out + premium, _number(underlying) * 0.10 + premium)
    option = F.when(buys, premium).when(_text(strategy, "SINGLE") == "VERTICAL_SPREAD", spread).otherwise(naked) * quantity * 100.0
    notional = _number(price, 100.0) / 100.0 * _number(face, 1000.0) * quantity
    return F.when(_text(asset) == "BOND", notional * F.when(_text(issuer) == "TREASURY", 0.01).otherwise(0.10)).otherwise(option)


def option_value(right: Column, underlying: Column, strike: Column, premium: Column) -> tuple[Column, Column]:
    """Intrinsic and extrinsic value; a right that is no call is a put."""
    gap = _number(underlying) - _number(strike)
    intrinsic = F.greatest(F.lit(0.0), F.when(_text(right) == "CALL", gap).otherwise(-gap))
    return intrinsic, F.greatest(F.lit(0.0), _number(premium) - intrinsic)


def bond_price(clean: Column, coupon: Column, frequency: Column, days: Column) -> tuple[Column, Column]:
    """Accrued interest by 30E/360 and dirty price, for 100 of face; twice a year and 90 days if not given."""
    f = _number(frequency, 2.0)
    accrued = _number(coupon) / f * 100.0 * (_number(days, 90.0) / (360.0 / f))
    return accrued, _number(clean, 100.0) + accrued


def currency_pair(symbol: Column) -> Column:
    """The parts of BASE/QUOTE or BASE-QUOTE in upper case."""
    return F.filter(F.split(F.upper(symbol), "[/-]"), lambda p: p != "")


def spot_rejection(symbol: Column, quantity: Column, price: Column, crypto: Column, sells: Column, wallet: Column) -> Column:
    """The first failing check of a currency order, or null: a pair, a quantity over 0, the quote currency's least notional, a wallet for crypto that is sold."""
    pair, notional = currency_pair(symbol), price * quantity
    table = F.create_map(*(F.lit(x) for both in LEAST_NOTIONAL.items() for x in both))
    least = F.coalesce(table[F.get(pair, 1)], F.lit(1.0))
    length = F.length(F.coalesce(wallet, F.lit("")))
    return (
        F.when(F.size(pair) != 2, "pair").when(quantity.isNull() | (quantity <= 0), "quantity")
        .when((notional > 0) & (notional < least), "notional").when(crypto & sells & ((length < 26) | (length > 62)), "wallet")
    )


def provider_quotes(orders: DataFrame, mid: str) -> DataFrame:
    """Each order with the fixed providers' quotes around its mid price: provider, bid, ask, depth, age_ms, place."""
    book = F.array(*(F.struct(F.lit(n).alias("provider"), F.lit(b).alias("b"), F.lit(a).alias("a"), F.lit(d).alias("depth"), F.lit(ms).alias("age_ms"), F.lit(k).alias("place")) for k, (n, b, a, d, ms) in enumerate(PROVIDERS)))
    return orders.withColumn("_q", F.explode(book)).select(*orders.columns, "_q.provider", (F.col(mid) * F.col("_q.b")).alias("bid"), (F.col(mid) * F.col("_q.a")).alias("ask"), "_q.depth", "_q.age_ms", "_q.place")


def best_execution(quotes: DataFrame, key: str, buys: str, quantity: str, fresh_ms: int = FRESH_MS, markup: float = MARKUP) -> DataFrame:
    """(key, provider, price, slippage): the best fresh quote of each order, the first of equals, with the client's markup.

    Quotes are (key, buys, quantity, provider, bid, ask, depth, age_ms, place). Stale ones are left out before
    anything is grouped; an order without a fresh one has no row.
    """
    fresh = quotes.filter(F.col("age_ms") <= fresh_ms)
    rank = F.struct(F.when(F.col(buys), F.col("ask")).otherwise(-F.col("bid")), "place")
    best = fresh.groupBy(key).agg(F.min_by(F.struct(buys, quantity, "provider", "bid", "ask", "depth"), rank).alias("q")).select(key, "q.*")
    price = F.when(F.col(buys), F.col("ask") * (1 + markup)).otherwise(F.col("bid") * (1 - markup))
    short = (F.col(quantity) - F.col("depth")) / F.col(quantity) * (F.col("ask") - F.col("bid"))
    return best.select(key, "provider", price.alias("price"), F.when(F.col("depth") >= F.col(quantity), 0.0).otherwise(short).alias("slippage"))


def wallet_risk(wallet: Column, mixer: Column, hops: Column) -> Column:
    """0 to 1 from the wallet's hash, its exposure to mixers and its distance from a flagged cluster (6 if not given); 0 without a wallet."""
    base = F.conv(F.substring(F.sha2(wallet, 256), 1, 2), 16, 10).cast("int") / 255.0 * 0.4
    h = _number(hops, 6.0)
    near = F.when(h <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.lit(1.0), h)))
    return F.when(F.coalesce(wallet, F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + 0.4 * _number(mixer) + 0.4 * near)))


def screening_rejection(crypto: Column, wallet: Column, risk: Column, jurisdiction: Column) -> Column:
    """The failing check, or null: of crypto a listed wallet or a risk that escalates, of others a listed jurisdiction (US if not given)."""
    listed = F.lower(F.coalesce(wallet, F.lit(""))).isin(*(w.lower() for w in LISTED_WALLETS))
    return F.when(crypto, F.when(listed, "listed").when(risk >= ESCALATES, "risk")).when(_text(jurisdiction, "US").isin(*LISTED_JURISDICTIONS), "jurisdiction")


def fifo(trades: DataFrame) -> DataFrame:
    """Sells against the oldest open lots: (key, id, realised, long_term, short).

    `trades` is (key, id, at, side, quantity, price). Within a key trades go in order of time and id. A sell
    that the lots do not cover takes all of them and is short by the rest; lots taken are not put back.
    A key is one task's group; keys are an account's positions and grow with its own trades alone.
    """

    def positions(rows: pd.DataFrame) -> pd.DataFrame:
        lots: list[list] = []
        out, head = [], 0
        for key, id_, at, side, quantity, price in rows.sort_values(["at", "id"]).itertuples(index=False):
            if side == "Buy":
                lots.append([at, quantity, price])
                continue
            left, realised, old = quantity, 0.0, 0.0
            while left > 0 and head < len(lots):
                lot = lots[head]
                part = min(left, lot[1])
                realised += (price - lot[2]) * part
                old += part if (at - lot[0]).days >= 365 else 0.0
                left -= part
                lot[1] -= part
                if lot[1] <= 0:
                    head += 1
            out.append((key, id_, realised, old, left))
        return pd.DataFrame(out, columns=["key", "id", "realised", "long_term", "short"])

    return trades.select("key", "id", "at", "side", "quantity", "price").groupBy("key").applyInPandas(positions, "key long, id long, realised double, long_term double, short double")


def fifo_overlap(trades: DataFrame) -> DataFrame:
    """(key, sell, buy, matched): covered sells and lots by overlap of cumulative quantities; exact where no sell is short.

    The ends of all lots and sells of a key, in order, cut its quantities into pieces; a piece lies in the next lot and
    the next sell to end, so one pass over the sorted ends matches them without comparing all sells with all lots.
    """
    from pyspark.sql.window import Window

    run = Window.partitionBy("key", "side").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    ends = trades.withColumn("high", F.sum("quantity").over(run)).groupBy("key", "high").agg(
        F.min(F.when(F.col("side") == "Buy", F.col("id"))).alias("b"), F.min(F.when(F.col("side") == "Sell", F.col("id"))).alias("s")
    )
    behind, ahead = Window.partitionBy("key").orderBy("high"), Window.partitionBy("key").orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.select(
        "key", (F.col("high") - F.lag("high", 1, 0.0).over(behind)).alias("matched"), F.last("b", ignorenulls=True).over(ahead).alias("buy"), F.last("s", ignorenulls=True).over(ahead).alias("sell")
    )
    return pieces.filter("buy is not null and sell is not null and matched > 0").select("key", "sell", "buy", "matched")
