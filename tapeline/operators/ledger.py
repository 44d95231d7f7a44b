"""Transactions to holdings, orders against risk rules and market rules, trade costs, and quote quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import codes, codes_sql, r6
from tapeline.functions.folds import fold
from tapeline.sources.bars import table

# Limits of the pre-trade rules.
LIMITS = {"value": 250_000, "quantity": 100_000, "position_percent": 20, "orders": 20, "volume": 10_000, "deviation_percent": 2, "spread_percent": 1.5, "age": 30}
# Price steps up to a price, and daily limit in percent.
TICKS, BAND = ((100, 0.1), (500, 0.5), (1_000_000, 1.0)), 10
# Cautious trade costs, in percent of the value or as amounts.
COSTS = {"brokerage": 0.5, "minimum": 10.0, "exchange": 0.02, "regulatory": 0.01, "tax_sell": 0.1, "settlement": 5.0}
ALL_KINDS = ("buy", "buy", "buy", "rights", "sell", "dividend", "bonus", "split", "fee", "tax", "adjustment")
KINDS = ("buy", "buy", "buy", "sell", "dividend", "bonus", "fee")


def apply_transaction(state: list, kind: str, quantity: float, price: float, fees: float) -> tuple:
    """state: [quantity, cost, realised, income]. Average cost; selling more than is held sells what is held and
    counts as `oversold`."""
    held, cost, realised, income, over = state
    if kind in ("buy", "rights"):
        held, cost = held + quantity, cost + (quantity * price + fees)
    elif kind == "sell":
        if quantity > held:
            quantity, over = held, over + 1
        if quantity > 0:
            average = cost / held
            realised += quantity * price - fees - quantity * average
            cost -= quantity * average
            held -= quantity
    elif kind == "dividend":
        income += price if quantity == 0 else quantity * price
    elif kind in ("bonus", "adjustment"):
        held += quantity
    elif kind == "split" and price > 0:
        held *= price
    elif kind in ("fee", "tax"):
        realised -= fees or price
    state[:] = [held, cost, realised, income, over]
    return tuple(state)


def holdings(transactions: DataFrame, order: list[str]) -> DataFrame:
    """symbol, quantity, cost, realised, income, oversold after all of a symbol's transactions in the given order."""
    return fold(transactions, ["symbol"], order, ["kind", "quantity", "price", "fees"], lambda: [0.0, 0.0, 0.0, 0.0, 0], apply_transaction, "held double, cost double, realised double, income double, oversold long", last_only=True)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.col("l_linenumber") - 1, F.lit(7)) + 1).cast("int"))
    return line.select(F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("symbol"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", kind.alias("kind"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * 10).alias("fees"))


def ledger_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as transactions of 40 symbols, folded to holdings with average cost and realised profit."""
    rows = holdings(transactions(spark, sf_dir), ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return rows.select("symbol", *(F.round(c, 3).alias(c) for c in ("held", "cost", "realised", "income")), "oversold")


def ledger_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each symbol's bought value in the whole, and whether it is concentrated."""
    rows = transactions(spark, sf_dir).where("kind = 'buy'").groupBy("symbol").agg(F.sum(F.col("quantity") * F.col("price")).alias("value"))
    total = rows.agg(F.sum("value"))
    share = F.col("value") / total.scalar() * 100
    return rows.select("symbol", r6(share).alias("share_percent"), (F.round(share, 9) > 25).alias("concentrated"))


def order_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposals against the pre-trade rules: reason codes in their order; none means approved."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderkey") % 400 * 300).alias("quantity"), (F.col("o_totalprice") / 1000).alias("price"), (1 + (F.col("o_orderkey") % 7 - 3) / 100).alias("factor"), (F.col("o_custkey") % 40 * 500).alias("volume"), (F.col("o_orderkey") % 45).alias("age"),
        F.row_number().over(Window.partitionBy("o_custkey", F.trunc("o_orderdate", "MM")).orderBy("o_orderkey")).alias("today"), (F.col("o_orderkey") % 5 * 0.5).alias("spread"),
    )
    value = F.col("quantity") * F.col("price") * F.col("factor")
    reasons = codes(
        (F.col("age") > LIMITS["age"], "STALE_OR_UNSAFE_DATA"), (F.round(value, 6) > LIMITS["value"], "MAX_TRADE_VALUE"), (F.col("quantity") > LIMITS["quantity"], "MAX_QUANTITY"), (F.round(value / 1_000_000 * 100, 6) > LIMITS["position_percent"], "MAX_POSITION_PERCENT"),
        (F.col("today") > LIMITS["orders"], "MAX_DAILY_ORDERS"), (F.col("volume") < LIMITS["volume"], "INSUFFICIENT_LIQUIDITY"), (F.round(F.abs(F.col("factor") - 1) * 100, 6) > LIMITS["deviation_percent"], "PRICE_DEVIATION"), (F.col("spread") > LIMITS["spread_percent"], "SPREAD_TOO_WIDE"),
    )
    return rows.select("o_orderkey", reasons.alias("reasons"), (reasons == "").alias("approved"))


def tick(price):
    out = F.lit(TICKS[-1][1])
    for bound, step in reversed(TICKS):
        out = F.when(price <= bound, step).otherwise(out)
    return out


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail prices on the tick grid, half up, and the daily band around them."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 3).alias("price"))
    on_grid = lambda p: F.round(F.floor(F.round(p / tick(p), 6) + 0.5) * tick(p), 4)
    return rows.select("p_partkey", on_grid(F.col("price")).alias("price"), on_grid(F.col("price") * (1 - BAND / 100)).alias("low"), on_grid(F.col("price") * (1 + BAND / 100)).alias("high"))


def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of each order as a buy or a sell: parts and their sum, rounded from the unrounded sum."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("gross"), (F.col("o_orderkey") % 2 == 1).alias("sells"))
    brokerage = F.greatest(F.col("gross") * COSTS["brokerage"] / 100, F.lit(COSTS["minimum"]))
    other = F.col("gross") * COSTS["exchange"] / 100 + F.col("gross") * COSTS["regulatory"] / 100
    tax = F.when(F.col("sells"), F.col("gross") * COSTS["tax_sell"] / 100).otherwise(0.0)
    return rows.select("o_orderkey", F.round(brokerage, 6).alias("brokerage"), F.round(tax, 6).alias("tax"), F.round(brokerage + other + tax + COSTS["settlement"], 6).alias("total"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes: event time, later receipt, price, and a second source's price."""
    late = F.col("event_id") * 7 % 90
    rows = table(spark, sf_dir, "events").withColumn("moment", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("event_id", (F.col("user_id") % 20).alias("symbol"), "moment", (F.col("moment") + late * 1_000_000).alias("received"), late.alias("age"), F.col("value").alias("price"), (F.col("value") * (1 + (F.col("event_id") % 5 - 2) / 100)).alias("second"))


def quote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's quotes in order of receipt: stale and repeated ones, arrivals out of order, longest stale run,
    mean delay and greatest disagreement with the second source."""
    arrival = Window.partitionBy("symbol").orderBy("received", "event_id")
    rows = quotes(spark, sf_dir).withColumn("stale", F.col("age") > 30).withColumn("early", F.col("moment") < F.lag("moment").over(arrival))
    rows = rows.withColumn("run", F.sum(F.when(F.col("stale"), 0).otherwise(1)).over(arrival.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("symbol", "run").agg(F.sum(F.col("stale").cast("int")).alias("size")).groupBy("symbol").agg(F.max("size").cast("long").alias("longest_stale"))
    off = F.abs(F.col("price") - F.col("second")) / F.nullif(F.col("second"), F.lit(0.0)) * 100
    sums = rows.groupBy("symbol").agg(F.count("*").alias("quotes"), (F.count("*") - F.count_distinct("moment")).alias("repeated"), F.count_if("stale").alias("stale"), F.count_if("early").alias("out_of_order"), r6(F.avg("age")).alias("mean_delay"), r6(F.max(off)).alias("disagreement"))
    return sums.join(runs, "symbol")


def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quote of each symbol by event time; ties go to the greater id."""
    return quotes(spark, sf_dir).groupBy("symbol").agg(F.max(F.struct("moment", "event_id", "price")).alias("x")).select("symbol", "x.event_id", r6("x.price").alias("price"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders by the digest of a seed and their key: the same in every run (a sampling operator)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat(F.lit("seed|"), F.col("o_orderkey").cast("string")), 256).alias("digest")).orderBy("digest").limit(50)


def account_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as transactions of their customer in three symbols of all ten kinds; a tenth of what a line has is sold."""
    k = F.pmod(F.col("l_linenumber") * 3 + F.col("l_orderkey"), F.lit(len(ALL_KINDS)))
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account")), "l_orderkey")
    kind = F.when((F.col("l_orderkey") % 13 == 0) & (F.col("l_linenumber") == 1), "cash_balance").otherwise(F.element_at(F.array(*map(F.lit, ALL_KINDS)), (k + 1).cast("int")))
    price = F.when(kind == "split", 2.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    return line.select(
        "account", F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string")).alias("symbol"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", kind.alias("kind"), F.when(kind == "sell", F.col("l_quantity") / 10).otherwise(F.col("l_quantity")).alias("quantity"), price.alias("price"),
        (F.col("l_tax") * 10).alias("fees"), (F.col("l_discount") * 10).alias("taxes"),
    )


def derive(state: list, kind: str, quantity: float, price: float, fees: float, taxes: float) -> tuple:
    """One transaction of an account's symbol; state: shares, cost, realised, dividends, and whether more was sold than was
    held, after which nothing changes."""
    held, cost, realised, income, oversold = state
    if kind in ("buy", "rights"):
        held, cost = held + quantity, cost + (quantity * price + fees + taxes)
    elif kind == "sell" and not oversold:
        if oversold := quantity > held:
            held = cost = realised = income = 0.0
        else:
            average = cost / held if held else 0.0
            realised += quantity * price - fees - taxes - quantity * average
            held, cost = held - quantity, cost - quantity * average
    elif kind == "dividend":
        income += price if quantity == 0 else quantity * price
    elif kind in ("bonus", "adjustment"):
        held += quantity
    elif kind == "split" and price > 0:
        held *= price
    elif kind in ("fee", "tax"):
        realised -= (fees if kind == "fee" else taxes) or price
    state[:] = [held, cost, realised, income, oversold]
    return tuple(state)


def portfolio(rows: DataFrame, order: list[str], prices: DataFrame) -> DataFrame:
    """account, symbol, status, quantity, average, cost, value, unrealised, allocation_percent, realised, dividends, cash of
    transactions (account, symbol, kind, quantity, price, fees, taxes) in the given order: what is held, valued at
    `prices` (symbol, current).

    A history that sells more than is held is none: the account's rows are `oversold` and have no figures. cash is the
    last cash_balance, 0 without one. A symbol without a price has no value, and its account then no allocations."""
    moves = rows.where("kind <> 'cash_balance'")
    held = fold(moves, ["account", "symbol"], order, ["kind", "quantity", "price", "fees", "taxes"], lambda: [0.0, 0.0, 0.0, 0.0, False], derive, "quantity double, cost double, realised double, dividends double, oversold boolean", last_only=True)
    cash = rows.where("kind = 'cash_balance'").groupBy("account").agg(F.max_by("price", F.struct(*order)).alias("cash"))
    own = Window.partitionBy("account")
    every = held.join(prices, "symbol", "left").withColumns({"bad": F.max("oversold").over(own), "value": F.when(F.col("quantity") > 0, F.col("current") * F.col("quantity"))})
    whole = F.when(F.count_if((F.col("quantity") > 0) & F.col("value").isNull()).over(own) == 0, F.sum("value").over(own))
    figures = {"quantity": F.col("quantity"), "average": F.col("cost") / F.col("quantity"), "cost": F.col("cost"), "value": F.col("value"), "unrealised": F.col("value") - F.col("cost"), "allocation_percent": F.col("value") / F.col("whole") * 100, "realised": F.col("realised"), "dividends": F.col("dividends")}
    shown = every.withColumn("whole", whole).where("bad OR quantity > 0").join(cash, "account", "left")
    return shown.select("account", "symbol", F.when(F.col("bad"), "oversold").otherwise("held").alias("status"), *(F.when(~F.col("bad"), v).alias(c) for c, v in figures.items()), F.coalesce("cash", F.lit(0.0)).alias("cash"))


def portfolio_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of every customer's account at each symbol's last price."""
    rows = account_transactions(spark, sf_dir)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    prices = rows.where("kind = 'buy'").groupBy("symbol").agg(F.max_by("price", F.struct(*order)).alias("current"))
    found = portfolio(rows, order, prices)
    return found.select("account", "symbol", "status", *((F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c) for c in found.columns[3:]))


QUERIES = {f.__name__: f for f in (ledger_holdings, ledger_allocation, portfolio_positions, order_risk, order_ticks, trade_costs, quote_quality, latest_quotes, hash_sample)}
_T = """t AS (SELECT 'P' || CAST(l_partkey % 40 AS VARCHAR) AS symbol, ['buy', 'buy', 'buy', 'sell', 'dividend', 'bonus', 'fee'][CAST((l_linenumber - 1) % 7 + 1 AS INT)] AS kind, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_tax * 10 AS fees,
  row_number() OVER (PARTITION BY l_partkey % 40 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem)"""
_TICK = lambda p: "CASE " + " ".join(f"WHEN {p} <= {b} THEN {s}" for b, s in TICKS) + f" ELSE {TICKS[-1][1]} END"
_GRID = lambda p: f"round(floor(round({p} / CAST({_TICK(p)} AS DOUBLE), 6) + 0.5) * CAST({_TICK(p)} AS DOUBLE), 4)"
_VALUE = "CAST(quantity AS DOUBLE) * price * factor"
_QUOTES = "q AS (SELECT event_id, user_id % 20 AS symbol, epoch_us(ts) AS moment, epoch_us(ts) + event_id * 7 % 90 * 1000000 AS received, event_id * 7 % 90 AS age, value AS price, value * (1 + (event_id % 5 - 2) / 100) AS second FROM events)"
ORACLE = {
    "ledger_holdings": f"""WITH RECURSIVE {_T}, s AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS held, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS realised, 0.0::DOUBLE AS income, CAST(0 AS BIGINT) AS oversold FROM t UNION ALL
      SELECT s.symbol, t.rn, CASE t.kind WHEN 'buy' THEN s.held + t.quantity WHEN 'bonus' THEN s.held + t.quantity WHEN 'sell' THEN s.held - least(t.quantity, s.held) ELSE s.held END,
        CASE WHEN t.kind = 'buy' THEN s.cost + (t.quantity * t.price + t.fees) WHEN t.kind = 'sell' AND s.held > 0 THEN s.cost - least(t.quantity, s.held) * (s.cost / s.held) ELSE s.cost END,
        CASE WHEN t.kind = 'sell' AND s.held > 0 THEN s.realised + (least(t.quantity, s.held) * t.price - t.fees - least(t.quantity, s.held) * (s.cost / s.held)) WHEN t.kind = 'fee' THEN s.realised - CASE WHEN t.fees <> 0 THEN t.fees ELSE t.price END ELSE s.realised END,
        CASE WHEN t.kind = 'dividend' THEN s.income + CASE WHEN t.quantity = 0 THEN t.price ELSE t.quantity * t.price END ELSE s.income END, s.oversold + CASE WHEN t.kind = 'sell' AND t.quantity > s.held THEN 1 ELSE 0 END FROM s JOIN t ON t.symbol = s.symbol AND t.rn = s.rn + 1)
      SELECT symbol, round(last(held ORDER BY rn), 3) AS held, round(last(cost ORDER BY rn), 3) AS cost, round(last(realised ORDER BY rn), 3) AS realised, round(last(income ORDER BY rn), 3) AS income, last(oversold ORDER BY rn) AS oversold FROM s GROUP BY symbol""",
    "portfolio_positions": f"""WITH RECURSIVE k AS (SELECT o_custkey AS account, 'P' || (l_partkey % 3) AS symbol, l.*, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 1 THEN 'cash_balance' ELSE {list(ALL_KINDS)}[CAST((l_linenumber * 3 + l_orderkey) % {len(ALL_KINDS)} + 1 AS INT)] END AS kind FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
      t AS (SELECT *, CASE WHEN kind = 'sell' THEN l_quantity / 10 ELSE l_quantity END AS quantity, CASE WHEN kind = 'split' THEN 2.0::DOUBLE ELSE l_extendedprice / l_quantity END AS price, l_tax * 10 AS fees, l_discount * 10 AS taxes FROM k),
      m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM t WHERE kind <> 'cash_balance'),
      s AS (SELECT DISTINCT account, symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS held, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS realised, 0.0::DOUBLE AS income, false AS over FROM m UNION ALL
        SELECT m.account, m.symbol, m.rn, CASE WHEN kind IN ('buy', 'rights', 'bonus', 'adjustment') THEN held + quantity WHEN kind = 'sell' THEN held - quantity WHEN kind = 'split' THEN held * price ELSE held END,
          CASE WHEN kind IN ('buy', 'rights') THEN cost + (quantity * price + fees + taxes) WHEN kind = 'sell' THEN cost - quantity * (CASE WHEN held = 0 THEN 0 ELSE cost / held END) ELSE cost END,
          CASE WHEN kind = 'sell' THEN realised + (quantity * price - fees - taxes - quantity * (CASE WHEN held = 0 THEN 0 ELSE cost / held END)) WHEN kind = 'fee' THEN realised - CASE WHEN fees <> 0 THEN fees ELSE price END WHEN kind = 'tax' THEN realised - CASE WHEN taxes <> 0 THEN taxes ELSE price END ELSE realised END,
          CASE WHEN kind = 'dividend' THEN income + CASE WHEN quantity = 0 THEN price ELSE quantity * price END ELSE income END, over OR (kind = 'sell' AND quantity > held) FROM s JOIN m ON s.account = m.account AND s.symbol = m.symbol AND m.rn = s.rn + 1),
      e AS (SELECT account, symbol, last(held ORDER BY rn) AS quantity, last(cost ORDER BY rn) AS cost, last(realised ORDER BY rn) AS realised, last(income ORDER BY rn) AS dividends, bool_or(over) AS over FROM s GROUP BY ALL),
      p AS (SELECT symbol, last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS current FROM t WHERE kind = 'buy' GROUP BY symbol), c AS (SELECT account, last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS cash FROM t WHERE kind = 'cash_balance' GROUP BY account),
      v AS (SELECT e.*, bool_or(over) OVER (PARTITION BY account) AS bad, CASE WHEN quantity > 0 THEN current * quantity END AS value FROM e LEFT JOIN p USING (symbol)), w AS (SELECT *, sum(value) OVER (PARTITION BY account) AS whole FROM v)
      SELECT w.account, symbol, CASE WHEN bad THEN 'oversold' ELSE 'held' END AS status, {", ".join(f"CASE WHEN NOT bad THEN floor(({x}) * 1000 + 0.5) / 1000 END AS {c}" for c, x in (("quantity", "quantity"), ("average", "cost / quantity"), ("cost", "cost"), ("value", "value"), ("unrealised", "value - cost"), ("allocation_percent", "value / whole * 100"), ("realised", "realised"), ("dividends", "dividends")))}, floor(coalesce(cash, 0.0) * 1000 + 0.5) / 1000 AS cash FROM w LEFT JOIN c ON c.account = w.account WHERE bad OR quantity > 0""",
    "ledger_allocation": f"WITH {_T}, v AS (SELECT symbol, sum(quantity * price) AS value FROM t WHERE kind = 'buy' GROUP BY symbol) SELECT symbol, round(value / (SELECT sum(value) FROM v) * 100, 6) AS share_percent, round(value / (SELECT sum(value) FROM v) * 100, 9) > 25 AS concentrated FROM v",
    "order_risk": f"""WITH r AS (SELECT o_orderkey, o_orderkey % 400 * 300 AS quantity, o_totalprice / 1000 AS price, 1 + (o_orderkey % 7 - 3) / 100 AS factor, o_custkey % 40 * 500 AS volume, o_orderkey % 45 AS age, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS today, o_orderkey % 5 * 0.5 AS spread FROM orders),
      c AS (SELECT o_orderkey, {codes_sql((f"age > {LIMITS['age']}", 'STALE_OR_UNSAFE_DATA'), (f"round({_VALUE}, 6) > {LIMITS['value']}", 'MAX_TRADE_VALUE'), (f"quantity > {LIMITS['quantity']}", 'MAX_QUANTITY'), (f"round({_VALUE} / 1000000 * 100, 6) > {LIMITS['position_percent']}", 'MAX_POSITION_PERCENT'), (f"today > {LIMITS['orders']}", 'MAX_DAILY_ORDERS'), (f"volume < {LIMITS['volume']}", 'INSUFFICIENT_LIQUIDITY'), (f"round(abs(factor - 1) * 100, 6) > {LIMITS['deviation_percent']}", 'PRICE_DEVIATION'), (f"spread > {LIMITS['spread_percent']}", 'SPREAD_TOO_WIDE'))} AS reasons FROM r)
      SELECT o_orderkey, reasons, reasons = '' AS approved FROM c""",
    "order_ticks": f"WITH r AS (SELECT p_partkey, p_retailprice / 3 AS price, p_retailprice / 3 * (1 - {BAND} / 100) AS low, p_retailprice / 3 * (1 + {BAND} / 100) AS high FROM part) SELECT p_partkey, {_GRID('price')} AS price, {_GRID('low')} AS low, {_GRID('high')} AS high FROM r",
    "trade_costs": f"""WITH g AS (SELECT o_orderkey, o_totalprice AS gross, o_orderkey % 2 = 1 AS sells, greatest(o_totalprice * {COSTS['brokerage']}::DOUBLE / 100, {COSTS['minimum']}) AS brokerage FROM orders), p AS (SELECT *, CASE WHEN sells THEN gross * {COSTS['tax_sell']}::DOUBLE / 100 ELSE 0.0 END AS tax FROM g)
      SELECT o_orderkey, round(brokerage, 6) AS brokerage, round(tax, 6) AS tax, round(brokerage + (gross * {COSTS['exchange']}::DOUBLE / 100 + gross * {COSTS['regulatory']}::DOUBLE / 100) + tax + {COSTS['settlement']}, 6) AS total FROM p""",
    "quote_quality": f"""WITH {_QUOTES}, w AS (SELECT *, age > 30 AS stale, moment < lag(moment) OVER a AS early, sum(CASE WHEN age > 30 THEN 0 ELSE 1 END) OVER (a ROWS UNBOUNDED PRECEDING) AS run FROM q WINDOW a AS (PARTITION BY symbol ORDER BY received, event_id)),
      r AS (SELECT symbol, CAST(max(size) AS BIGINT) AS longest_stale FROM (SELECT symbol, run, sum(CAST(stale AS INT)) AS size FROM w GROUP BY ALL) GROUP BY symbol)
      SELECT w.symbol, count(*) AS quotes, count(*) - count(DISTINCT moment) AS repeated, count(*) FILTER (stale) AS stale, count(*) FILTER (early) AS out_of_order, round(avg(age), 6) AS mean_delay, round(max(abs(price - second) / nullif(second, 0) * 100), 6) AS disagreement, any_value(longest_stale) AS longest_stale FROM w JOIN r USING (symbol) GROUP BY w.symbol""",
    "latest_quotes": f"WITH {_QUOTES} SELECT symbol, last(event_id ORDER BY moment, event_id) AS event_id, round(last(price ORDER BY moment, event_id), 6) AS price FROM q GROUP BY symbol",
    "hash_sample": "SELECT o_orderkey, sha256('seed|' || CAST(o_orderkey AS VARCHAR)) AS digest FROM orders ORDER BY digest LIMIT 50",
}
