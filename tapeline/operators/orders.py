"""Orders: all pre-trade rules and their scenarios, fills against cash and shares, reconciliation, costs, market phases,
quote comparison, suspension and readiness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import codes, codes_sql, r6
from tapeline.functions.folds import fold
from tapeline.operators.ledger import LIMITS
from tapeline.sources.bars import BARS_SQL, bars, table

# Limits of the rules beside those of a single order.
ACCOUNT_LIMITS = {"daily_loss": 3, "drawdown": 10, "losses": 3, "disagreement": 1, "open_orders": 10}
# Fills take a tenth of the volume, slip by 0.1 % and cost 0.4 %.
PARTICIPATION, SLIP_PERCENT, FEE_RATE, START_CASH = 0.1, 0.1, 0.004, 1_000_000.0
# Modes of the queue (share of the visible volume, penalty), costs in percent or as amounts, their multipliers.
MODES = {"conservative": (0.05, 0.5), "normal": (0.1, 0.25), "optimistic": (0.2, 0.0)}
COSTS = {"brokerage": "0.005", "minimum": "10.00", "exchange": "0.0002", "regulatory": "0.0001", "tax_sell": "0.001", "settlement": "5.00"}
MULTIPLIERS = ("0.75", "1.00", "1.25")
# The trading day in local time, six hours before UTC, and days off (Friday and Saturday).
PHASES, OFFSET_HOURS, WEEKEND = (("auction", 585, 600), ("continuous", 600, 870)), 6, (4, 5)
# The rules in their order.
RULES = (
    "KILL_SWITCH_NOT_HEALTHY DAILY_LOSS_LIMIT CAMPAIGN_DRAWDOWN_LIMIT REPEATED_LOSS_COOLDOWN STRATEGY_SUSPENDED RESTART_RECONCILIATION_REQUIRED RECONCILIATION_MISMATCH STALE_OR_UNSAFE_DATA PROVIDER_CONFLICT MAX_TRADE_VALUE "
    "MAX_QUANTITY MAX_POSITION_PERCENT MAX_DAILY_ORDERS MAX_OPEN_ORDERS INSUFFICIENT_LIQUIDITY RESTRICTED_SYMBOL SYMBOL_NOT_APPROVED PRICE_DEVIATION SPREAD_TOO_WIDE"
).split()
#: A proposal that meets all rules, and for each rule the change that breaks it.
SAFE = {
    "switch": "healthy", "daily_loss": 0.0, "drawdown": 0.0, "losses": 0.0, "suspended": False, "restarted": True, "reconciled": True, "age": 1.0, "disagreement": 0.0, "quantity": 100.0, "limit_price": 100.0, "price": 100.0,
    "position": 0.0, "portfolio": 1_000_000.0, "today": 0.0, "open_orders": 0.0, "volume": 50_000.0, "restricted": False, "approved": True, "bid": 99.9, "ask": 100.0,
}
BREAKS = (
    {"switch": "paused"}, {"daily_loss": 3.0}, {"drawdown": 10.0}, {"losses": 3.0}, {"suspended": True}, {"restarted": False}, {"reconciled": False}, {"age": 31.0}, {"disagreement": 1.5}, {"quantity": 2600.0, "portfolio": 9e6},
    {"quantity": 100_001.0, "limit_price": 1.0, "price": 1.0, "bid": 0.999, "ask": 1.0}, {"position": 195_000.0}, {"today": 20.0}, {"open_orders": 10.0}, {"volume": 9_999.0}, {"restricted": True}, {"approved": False}, {"limit_price": 103.0}, {"bid": 98.0},
)


def rule_codes() -> Column:
    """The codes of the rules that a proposal (columns as in SAFE) breaks, in their order."""
    c = F.col
    value = c("quantity") * c("limit_price")
    conditions = (
        c("switch") != "healthy", c("daily_loss") >= ACCOUNT_LIMITS["daily_loss"], c("drawdown") >= ACCOUNT_LIMITS["drawdown"], c("losses") >= ACCOUNT_LIMITS["losses"], c("suspended"), ~c("restarted"), ~c("reconciled"), c("age") > LIMITS["age"],
        c("disagreement") > ACCOUNT_LIMITS["disagreement"], F.round(value, 6) > LIMITS["value"], c("quantity") > LIMITS["quantity"], (c("portfolio") > 0) & (F.round((c("position") + value) / c("portfolio") * 100, 9) > LIMITS["position_percent"]), c("today") >= LIMITS["orders"],
        c("open_orders") >= ACCOUNT_LIMITS["open_orders"], c("volume") < LIMITS["volume"], c("restricted"), ~c("approved"), F.round(F.abs(c("limit_price") - c("price")) / c("price") * 100, 9) > LIMITS["deviation_percent"], F.round((c("ask") - c("bid")) / c("ask") * 100, 9) > LIMITS["spread_percent"],
    )
    return codes(*zip(conditions, RULES, strict=True))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposals; their key decides what the account and the market look like."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 97 == 0, "paused").otherwise("healthy").alias("switch"), (k % 40 / 10).alias("daily_loss"), (k % 23 / 2).alias("drawdown"), (k % 5 - k % 3).cast("double").alias("losses"), (cust % 31 == 0).alias("suspended"), (k % 53 != 0).alias("restarted"),
        (k % 59 != 0).alias("reconciled"), (k % 45).cast("double").alias("age"), (k % 13 / 10).alias("disagreement"), (k % 400 * 30).cast("double").alias("quantity"), (price * (1 + (k % 7 - 3) / 100)).alias("limit_price"), price.alias("price"), (cust % 100 * 2000).cast("double").alias("position"),
        F.lit(1_000_000.0).alias("portfolio"), (k % 22).cast("double").alias("today"), (k % 12).cast("double").alias("open_orders"), (cust % 40 * 500).cast("double").alias("volume"), (cust % 41 == 0).alias("restricted"), (cust % 43 != 0).alias("approved"), (price * (1 - k % 5 / 200)).alias("bid"), price.alias("ask"),
    )


def order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each proposal against all nineteen rules."""
    return proposals(spark, sf_dir).select("o_orderkey", rule_codes().alias("reasons")).withColumn("approved", F.col("reasons") == "")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule is broken, and by how many proposals alone."""
    rows = order_rules(spark, sf_dir).where("not approved").select(F.split("reasons", ",").alias("codes"))
    return rows.select(F.explode("codes").alias("rule"), (F.size("codes") == 1).alias("alone")).groupBy("rule").agg(F.count("*").alias("broken"), F.count_if("alone").alias("alone"))


def scenario_verdicts(rows: DataFrame) -> DataFrame:
    """The rows (scenario and the columns of SAFE) with the reasons against each, and whether just its own rule speaks."""
    return rows.withColumn("reasons", rule_codes()).withColumn("passed", F.when(F.col("scenario") == "SAFE", F.col("reasons") == "").otherwise(F.col("reasons") == F.col("scenario")))


def rule_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a safe proposal at its own price, and for each rule with the change that breaks it: by scenario how
    many orders there are, for how many just that rule speaks, and what else does."""
    cases = [("SAFE", SAFE), *((rule, SAFE | change) for rule, change in zip(RULES, BREAKS, strict=True))]
    scale = F.col("o_totalprice") / 100_000
    priced = {"limit_price", "price", "bid", "ask"}

    def value(rule: str, c: str, v: object) -> Column:
        if rule == "MAX_QUANTITY" or c not in priced | {"quantity"}:
            return F.lit(v).alias(c)
        return (F.lit(v) * scale if c in priced else F.lit(v) / scale).alias(c)

    each = F.inline(F.array(*(F.struct(F.lit(rule).alias("scenario"), *(value(rule, c, v) for c, v in case.items())) for rule, case in cases)))
    rows = scenario_verdicts(table(spark, sf_dir, "orders").where("o_totalprice > 0").select(each))
    other = F.max(F.when(~F.col("passed"), F.col("reasons")))
    return rows.groupBy("scenario").agg(F.count("*").alias("orders"), F.count_if("passed").alias("passed"), other.alias("other"))


def cents(x: float) -> float:
    return math.floor(round(x * 100, 6) + 0.5) / 100


def fill(state: list, side: str, quantity: int, limit: float, price: float, volume: int) -> tuple:
    """One order against an account's [cash, shares]: status, filled, fill price, fee, cash, shares."""
    cash, held = state
    cap = math.floor(round(volume * PARTICIPATION, 6))
    size = min(quantity, max(0, cap))
    if (limit < price if side == "buy" else limit > price) or size == 0:
        return "submitted", 0, 0.0, 0.0, cash, held
    slipped = price * (1 + SLIP_PERCENT / 100) if side == "buy" else price * (1 - SLIP_PERCENT / 100)
    at = cents(min(slipped, limit) if side == "buy" else max(slipped, limit))
    fee = cents(at * size * FEE_RATE)
    if (round(cash - (at * size + fee), 6) < 0) if side == "buy" else held < size:
        return "rejected", 0, 0.0, 0.0, cash, held
    state[:] = [cash - (at * size + fee), held + size] if side == "buy" else [cash + (at * size - fee), held - size]
    return "filled" if size == quantity else "partially_filled", size, at, fee, *state


def account_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cent = lambda x: F.floor(F.round(x * 100, 6) + 0.5) / 100
    price = cent(F.col("o_totalprice") / 1000)
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("account"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", F.when(k % 3 == 0, "sell").otherwise("buy").alias("side"), (k % 200 + 1).alias("quantity"), cent(price * (1 + (k % 7 - 3) / 100)).alias("limit_price"), price.alias("price"), (F.col("o_custkey") % 11 * 200).alias("volume"))


def filled_orders(rows: DataFrame) -> DataFrame:
    """account, o_orderkey, side, status, filled, at, fee, cash, shares: each account's orders in turn, one state a task."""
    step = lambda state, key, side, *rest: (key, side, *fill(state, side, *rest))
    return fold(rows, ["account"], ["day", "o_orderkey"], ["o_orderkey", "side", "quantity", "limit_price", "price", "volume"], lambda: [START_CASH, 0], step, "o_orderkey long, side string, status string, filled long, at double, fee double, cash double, shares long")


def order_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_orders(account_orders(spark, sf_dir)).select("account", "o_orderkey", "side", "status", "filled", F.round("at", 4).alias("fill"), F.round("fee", 4).alias("fee"), F.round("cash", 3).alias("cash"), "shares")


def cash_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's cash derived from its fills against that of its last order (a cent at most apart), its shares, how
    its orders ended, and whether it is healthy."""
    rows = order_fills(spark, sf_dir).withColumnRenamed("fill", "price")
    buy, value = F.col("side") == "buy", F.col("filled") * F.col("price")
    sums = rows.groupBy("account").agg((START_CASH + F.sum(F.when(buy, -value - F.col("fee")).otherwise(value - F.col("fee")))).alias("derived"), F.sum(F.when(buy, F.col("filled")).otherwise(-F.col("filled"))).alias("held"), *(F.count_if(F.col("status") == s).alias(s) for s in ("filled", "partially_filled", "rejected", "submitted")))
    days = account_orders(spark, sf_dir).select("o_orderkey", "day")
    last = rows.join(days, "o_orderkey").groupBy("account").agg(F.max_by(F.struct("cash", "shares"), F.struct("day", "o_orderkey")).alias("last"))
    return sums.join(last, "account").select("account", F.round("derived", 2).alias("derived"), "held", "filled", "partially_filled", "rejected", "submitted", ((F.abs(F.col("derived") - F.col("last.cash")) <= 0.011) & (F.col("held") == F.col("last.shares")) & (F.col("last.cash") >= 0)).alias("healthy"))


def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of each order to the cent, half up: parts, the sum of the unrounded parts, and the sum under multipliers."""
    dec = lambda x: F.lit(x).cast("decimal(8,4)")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("gross"), (F.col("o_orderkey") % 2 == 1).alias("sells"))
    part = lambda c: (F.col("gross") * dec(COSTS[c])).cast("decimal(24,6)")
    rows = rows.withColumn("brokerage", F.greatest(part("brokerage"), F.lit(COSTS["minimum"]).cast("decimal(24,6)"))).withColumn("exchange", part("exchange")).withColumn("regulatory", part("regulatory")).withColumn("tax", F.when(F.col("sells"), part("tax_sell")).otherwise(F.lit("0").cast("decimal(24,6)")))
    total = (F.col("brokerage") + F.col("exchange") + F.col("regulatory") + F.col("tax") + F.lit(COSTS["settlement"]).cast("decimal(24,6)")).cast("decimal(24,6)")
    rows = rows.withColumn("total", F.round(total, 2))
    money = lambda c: F.round(c, 2).cast("double")
    return rows.select("o_orderkey", *(money(F.col(c)).alias(c) for c in ("brokerage", "exchange", "regulatory", "tax", "total")), *(money(F.col("total") * F.lit(m).cast("decimal(4,2)")).alias(f"times_{m.replace('.', '_')}") for m in MULTIPLIERS))


def fillable_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode may fill of a line's volume behind its queue."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(0.0), F.col("l_quantity") * 100 - F.col("l_partkey") % 500).alias("visible"))
    return rows.groupBy("l_orderkey").agg(*(F.sum(F.floor(F.round(F.col("visible") * share * (1 - penalty), 6))).cast("long").alias(mode) for mode, (share, penalty) in MODES.items()))


def market_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by market phase and reason in local time: days off, holidays (the first of a month), auction, continuous."""
    local = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + OFFSET_HOURS * 3_600_000_000)
    rows = table(spark, sf_dir, "events").select(local.alias("at")).withColumn("day", F.to_date("at")).withColumn("minute", F.hour("at") * 60 + F.minute("at"))
    holidays = rows.where("dayofmonth(day) = 1").select("day").distinct().withColumn("off", F.lit(True))
    met = rows.join(holidays, "day", "left")
    inside = lambda low, high: (F.col("minute") >= low) & (F.col("minute") < high)
    phase = F.lit("closed")
    for name, low, high in reversed(PHASES):
        phase = F.when(inside(low, high), name).otherwise(phase)
    shut = F.when(F.weekday("day").isin(*WEEKEND), "weekend").when(F.col("off"), "holiday")
    phase = F.when(shut.isNotNull(), "closed").otherwise(phase)
    reason = F.coalesce(shut, F.when(phase == "closed", "outside_configured_period").otherwise("configured_trading_period"))
    return met.groupBy(phase.alias("phase"), reason.alias("reason")).agg(F.count("*").alias("events"), F.count_distinct("day").alias("days"))


BLOCKING = ("STALE_PRIMARY_DATA", "PRIMARY_DATA_UNSAFE", "INSUFFICIENT_TIMESTAMP_TRUST", "PROVIDER_PRICE_CONFLICT", "PROVIDER_PREVIOUS_CLOSE_CONFLICT")


def quote_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of two sources (each lacks some): reasons against the first, whether it is safe, and which one is used."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("price"), (k * 7 % 45).alias("age"), (k % 19 == 0).alias("unsafe"), (k % 17 != 0).alias("trusted"), F.col("value").alias("close"))
    first = rows.where("event_id % 29 <> 0")
    second = rows.where("event_id % 11 <> 0").select("event_id", (F.col("price") * (1 + (k % 9 - 4) / 200)).alias("price_2"), (k * 5 % 43).alias("age_2"), (F.col("close") * (1 + (k % 7 - 3) / 150)).alias("close_2"))
    met = first.join(second, "event_id", "full")
    have, other = F.col("price").isNotNull(), F.col("price_2").isNotNull()
    apart = lambda a, b: F.round(F.abs(F.col(a) - F.col(b)) / F.greatest(F.abs(a), F.abs(b), F.lit(0.0001)) * 100, 9)
    pairs = (
        (have & (F.col("age") > LIMITS["age"]), "STALE_PRIMARY_DATA"), (have & F.col("unsafe"), "PRIMARY_DATA_UNSAFE"), (have & ~F.col("trusted"), "INSUFFICIENT_TIMESTAMP_TRUST"), (have & other & (F.col("age_2") > LIMITS["age"]), "STALE_SECONDARY_DATA"),
        (have & other & (apart("price", "price_2") > 1), "PROVIDER_PRICE_CONFLICT"), (have & other & (apart("close", "close_2") > 1), "PROVIDER_PREVIOUS_CLOSE_CONFLICT"), (have & ~other, "SECONDARY_PROVIDER_UNAVAILABLE"), (~have, "primary_provider_failed"),
    )
    blocked = F.lit(False)
    for condition, label in pairs:
        blocked = blocked | F.coalesce(condition, F.lit(False)) if label in BLOCKING else blocked
    status = F.when(~have, "DEGRADED").when(blocked, "UNSAFE").otherwise("HEALTHY")
    return met.select("event_id", codes(*pairs).alias("reasons"), status.alias("status"), r6(F.when(have, F.col("price")).otherwise(F.col("price_2"))).alias("price"))


def suspensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as strategies: the first of seven triggers that fits, and how many do."""
    k = F.col("s_suppkey")
    tests = (
        (k % 20 / 100 > 0.15, "excessive_drawdown"), (k % 6 >= 5, "repeated_data_failures"), (k % 13 / 2 > 5, "abnormal_turnover"), (k % 9 >= 8, "repeated_risk_rejection"), (k % 23 == 0, "behavior_divergence"), (F.col("s_acctbal") < 0, "insufficient_liquidity"),
        (F.sha2(F.col("s_name"), 256) != F.sha2(F.concat(F.lit("Supplier#"), F.lpad((k - (k % 37 == 1).cast("int")).cast("string"), 9, "0")), 256), "implementation_hash_change"),
    )
    first = F.lit(None).cast("string")
    for condition, label in reversed(tests):
        first = F.when(condition, label).otherwise(first)
    every = codes(*tests)
    return table(spark, sf_dir, "supplier").select("s_suppkey", first.alias("trigger"), F.when(every == "", 0).otherwise(F.size(F.split(every, ","))).alias("triggers"))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a table of quotes and orders that fail: age of the last event, share of errors, orders in progress, users."""
    events = table(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.avg((F.col("event_type") == "error").cast("double")).alias("errors"), F.count_distinct("user_id").alias("users"), F.datediff(F.max("ts"), F.min("ts")).alias("span"))
    orders = table(spark, sf_dir, "orders").agg(F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("open"), F.count("*").alias("orders"))
    row = events.crossJoin(orders)  # a row each
    checks = codes((F.col("span") < 30, "history_too_short"), (F.col("errors") > 0.1, "too_many_errors"), (F.col("open") > 0.5, "too_many_open_orders"), (F.col("users") < 10, "too_few_users"), (F.col("orders") == 0, "no_orders"))
    return row.select("events", "orders", F.round("errors", 4).alias("errors"), F.round("open", 4).alias("open"), checks.alias("failing"), (checks == "").alias("ready"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and those finished on each day, their mean delay to the customer's next order, and the next free key."""
    rows = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    rows = rows.withColumn("delay", F.datediff(F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")), "day"))
    return rows.groupBy("day").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), r6(F.avg("delay")).alias("mean_delay"), (F.max("o_orderkey") + 1).alias("next_key"))


def count_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of orders by status and priority against claimed ones (each claim is off for one status): full outer."""
    found = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("found"))
    claimed = found.where("o_orderpriority <> '2-HIGH'").select("o_orderstatus", "o_orderpriority", (F.col("found") + (F.col("o_orderstatus") == "F").cast("int")).alias("claimed"))
    met = found.join(claimed, ["o_orderstatus", "o_orderpriority"], "full")
    return met.select("*", F.when(F.col("claimed").isNull(), "unclaimed").when(F.col("claimed") != F.col("found"), "mismatch").otherwise("reconciled").alias("status"))


def runtime_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of each user: mean and peak value, and the longest run of samples above 50."""
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 50)
    rows = rows.withColumn("run", F.sum(F.when(F.col("high"), 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("user_id", "run").agg(F.count_if("high").alias("high"), F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    return runs.groupBy("user_id").agg(F.sum("n").alias("samples"), r6(F.sum("total") / F.sum("n")).alias("mean"), r6(F.max("peak")).alias("peak"), F.max("high").alias("longest_high"))


def redacted_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON with the value of k redacted, and its canonical form with type and id: how many of each differ."""
    text = F.regexp_replace("props", r'("k":\s*)[^,}]+', '$1"[REDACTED]"')
    return table(spark, sf_dir, "events").select("event_type", text.alias("props")).groupBy("event_type", "props").agg(F.count("*").alias("events"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account's fills contributed: sales and shares at the last price less purchases; its share of all,
    its rank, and the concentration of all purchases."""
    rows = order_fills(spark, sf_dir).withColumnRenamed("fill", "price").where("filled > 0")
    days = account_orders(spark, sf_dir).select("o_orderkey", "day")
    buy, value = F.col("side") == "buy", F.col("filled") * F.col("price")
    sums = rows.join(days, "o_orderkey").groupBy("account").agg(
        F.sum(F.when(~buy, value).otherwise(0.0)).alias("sold"), F.sum(F.when(buy, value).otherwise(0.0)).alias("bought"), F.sum(F.when(buy, F.col("filled")).otherwise(-F.col("filled"))).alias("held"), F.max_by("price", F.struct("day", "o_orderkey")).alias("last"), F.sum("fee").alias("fees"),
    )
    every = Window.partitionBy(F.lit(1))  # a row for each account
    rows = sums.withColumn("gain", F.round(F.col("sold") + F.col("held") * F.col("last") - F.col("bought"), 4)).withColumn("weight", F.col("bought") / F.sum("bought").over(every))
    return rows.select("account", F.round("gain", 3).alias("gain"), F.round("fees", 3).alias("fees"), r6(F.col("gain") / F.sum("gain").over(every)).alias("share"), F.rank().over(every.orderBy(F.desc("gain"), "account")).alias("place"), r6(F.sum(F.col("weight") * F.col("weight")).over(every)).alias("concentration"))


# The dimensions of an experiment.
DESIGN = {"fast": (10, 20, 30), "slow": (50, 100), "rebalance": ("monthly", "quarterly"), "cost": ("base", "double")}


def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol with every design of four short dimensions: the design's name, the symbol's bars, and whether they are
    three times its longer mean."""
    rows = bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"))
    for name, values in DESIGN.items():
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return rows.select("symbol", F.concat_ws("-", *DESIGN).alias("design"), "bars", (F.col("bars") >= 3 * F.col("slow")).alias("usable"))


QUERIES = {
    f.__name__: f
    for f in (
        order_rules, rule_counts, rule_scenarios, order_fills, cash_reconciliation, cost_breakdown, fillable_volume, market_phases, quote_comparison, suspensions, readiness, daily_orders, count_claims, runtime_samples, redacted_properties,
        contributions, experiment_matrix,
    )
}

_RULES_SQL = codes_sql(*zip((
    "switch <> 'healthy'", f"daily_loss >= {ACCOUNT_LIMITS['daily_loss']}", f"drawdown >= {ACCOUNT_LIMITS['drawdown']}", f"losses >= {ACCOUNT_LIMITS['losses']}", "suspended", "NOT restarted", "NOT reconciled", f"age > {LIMITS['age']}", f"disagreement > {ACCOUNT_LIMITS['disagreement']}",
    f"round(quantity * limit_price, 6) > {LIMITS['value']}", f"quantity > {LIMITS['quantity']}", f"portfolio > 0 AND round((position + quantity * limit_price) / portfolio * 100, 9) > {LIMITS['position_percent']}", f"today >= {LIMITS['orders']}", f"open_orders >= {ACCOUNT_LIMITS['open_orders']}", f"volume < {LIMITS['volume']}",
    "restricted", "NOT approved", f"round(abs(limit_price - price) / price * 100, 9) > {LIMITS['deviation_percent']}", f"round((ask - bid) / ask * 100, 9) > {LIMITS['spread_percent']}",
), RULES, strict=True))
_PROPOSED = f"""WITH p AS (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c, o_totalprice / 1000 AS price FROM orders), q AS (SELECT o_orderkey, CASE WHEN k % 97 = 0 THEN 'paused' ELSE 'healthy' END AS switch, k % 40 / 10 AS daily_loss, k % 23 / 2 AS drawdown, k % 5 - k % 3 AS losses, c % 31 = 0 AS suspended, k % 53 <> 0 AS restarted, k % 59 <> 0 AS reconciled, k % 45 AS age, k % 13 / 10 AS disagreement,
  CAST(k % 400 * 30 AS DOUBLE) AS quantity, price * (1 + (k % 7 - 3) / 100) AS limit_price, price, CAST(c % 100 * 2000 AS DOUBLE) AS position, 1000000.0::DOUBLE AS portfolio, k % 22 AS today, k % 12 AS open_orders, c % 40 * 500 AS volume, c % 41 = 0 AS restricted, c % 43 <> 0 AS approved, price * (1 - k % 5 / 200) AS bid, price AS ask FROM p), ruled AS (SELECT o_orderkey, {_RULES_SQL} AS reasons FROM q)"""
_LITERAL = lambda v: f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE"
_SCENARIOS = " UNION ALL ".join("SELECT " + ", ".join([f"'{name}' AS scenario", *(f"{_LITERAL(v)} AS {c}" for c, v in (SAFE | change).items())]) for name, change in [("SAFE", {}), *zip(RULES, BREAKS, strict=True)])
_C = lambda x: f"(floor(round(({x}) * 100, 6) + 0.5) / 100)"
_FILLS = f"""WITH RECURSIVE o AS (SELECT o_custkey % 40 AS account, CAST(o_orderdate AS DATE) AS day, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, o_orderkey % 200 + 1 AS quantity, {_C('o_totalprice / 1000')} AS price, o_custkey % 11 * 200 AS volume FROM orders),
n AS (SELECT *, {_C('price * (1 + (o_orderkey % 7 - 3) / 100)')} AS lim, least(quantity, greatest(0, CAST(floor(round(volume * {PARTICIPATION}::DOUBLE, 6)) AS BIGINT))) AS size, row_number() OVER (PARTITION BY account ORDER BY day, o_orderkey) AS rn FROM o),
m AS (SELECT *, CASE side WHEN 'buy' THEN lim >= price ELSE lim <= price END AND size > 0 AS crosses, CASE side WHEN 'buy' THEN {_C(f'least(price * (1 + {SLIP_PERCENT}::DOUBLE / 100), lim)')} ELSE {_C(f'greatest(price * (1 - {SLIP_PERCENT}::DOUBLE / 100), lim)')} END AS fp FROM n),
c AS (SELECT *, {_C(f'fp * size * {FEE_RATE}::DOUBLE')} AS f FROM m),
s AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS o_orderkey, '' AS side, '' AS status, CAST(0 AS BIGINT) AS filled, 0.0::DOUBLE AS fill, 0.0::DOUBLE AS fee, {START_CASH}::DOUBLE AS cash, CAST(0 AS BIGINT) AS shares, CAST(NULL AS DATE) AS day FROM c
 UNION ALL SELECT account, rn, o_orderkey, side, CASE WHEN NOT crosses THEN 'submitted' WHEN NOT can THEN 'rejected' WHEN size = quantity THEN 'filled' ELSE 'partially_filled' END, CASE WHEN crosses AND can THEN size ELSE 0 END, CASE WHEN crosses AND can THEN fp ELSE 0.0 END, CASE WHEN crosses AND can THEN f ELSE 0.0 END,
  CASE WHEN crosses AND can THEN CASE side WHEN 'buy' THEN cash - (fp * size + f) ELSE cash + (fp * size - f) END ELSE cash END, CASE WHEN crosses AND can THEN CASE side WHEN 'buy' THEN shares + size ELSE shares - size END ELSE shares END, day
  FROM (SELECT c.*, s.cash, s.shares, CASE c.side WHEN 'buy' THEN round(s.cash - (c.fp * c.size + c.f), 6) >= 0 ELSE s.shares >= c.size END AS can FROM s JOIN c ON c.account = s.account AND c.rn = s.rn + 1)),
fills AS (SELECT account, rn, day, o_orderkey, side, status, filled, round(fill, 4) AS fill, round(fee, 4) AS fee, round(cash, 3) AS cash, shares FROM s WHERE rn > 0)"""
_PART = lambda c: f"CAST(gross * CAST('{COSTS[c]}' AS DECIMAL(8,4)) AS DECIMAL(24,6))"
_TRIGGERS = (
    ("k % 20 / 100 > 0.15::DOUBLE", "excessive_drawdown"), ("k % 6 >= 5", "repeated_data_failures"), ("k % 13 / 2 > 5", "abnormal_turnover"), ("k % 9 >= 8", "repeated_risk_rejection"), ("k % 23 = 0", "behavior_divergence"), ("s_acctbal < 0", "insufficient_liquidity"),
    ("sha256(s_name) <> sha256('Supplier#' || lpad(CAST(k - CAST(k % 37 = 1 AS INT) AS VARCHAR), 9, '0'))", "implementation_hash_change"),
)
_APART = lambda a, b: f"round(abs({a} - {b}) / greatest(abs({a}), abs({b}), 0.0001) * 100, 9) > 1"
_QUOTE_PAIRS = (
    (f"have AND age > {LIMITS['age']}", "STALE_PRIMARY_DATA"), ("have AND unsafe", "PRIMARY_DATA_UNSAFE"), ("have AND NOT trusted", "INSUFFICIENT_TIMESTAMP_TRUST"), (f"have AND other AND age_2 > {LIMITS['age']}", "STALE_SECONDARY_DATA"), (f"have AND other AND {_APART('price', 'price_2')}", "PROVIDER_PRICE_CONFLICT"),
    (f"have AND other AND {_APART('close', 'close_2')}", "PROVIDER_PREVIOUS_CLOSE_CONFLICT"), ("have AND NOT other", "SECONDARY_PROVIDER_UNAVAILABLE"), ("NOT have", "primary_provider_failed"),
)
ORACLE = {
    "order_rules": f"{_PROPOSED} SELECT o_orderkey, reasons, reasons = '' AS approved FROM ruled",
    "rule_counts": f"{_PROPOSED}, l AS (SELECT string_split(reasons, ',') AS codes FROM ruled WHERE reasons <> ''), u AS (SELECT unnest(codes) AS rule, len(codes) = 1 AS alone FROM l) SELECT rule, count(*) AS broken, count(*) FILTER (alone) AS alone FROM u GROUP BY rule",
    "rule_scenarios": f"""WITH c AS ({_SCENARIOS}), s AS (SELECT c.* REPLACE ({", ".join(f"CASE WHEN scenario = 'MAX_QUANTITY' THEN {x} ELSE {x} {sign} (o_totalprice / 100000) END AS {x}" for x, sign in (("limit_price", "*"), ("price", "*"), ("bid", "*"), ("ask", "*"), ("quantity", "/")))}) FROM orders, c WHERE o_totalprice > 0),
      r AS (SELECT scenario, {_RULES_SQL} AS reasons FROM s), p AS (SELECT *, CASE WHEN scenario = 'SAFE' THEN reasons = '' ELSE reasons = scenario END AS passed FROM r) SELECT scenario, count(*) AS orders, count(*) FILTER (passed) AS passed, max(reasons) FILTER (NOT passed) AS other FROM p GROUP BY scenario""",
    "order_fills": f"{_FILLS} SELECT account, o_orderkey, side, status, filled, fill, fee, cash, shares FROM fills",
    "cash_reconciliation": f"""{_FILLS}, a AS (SELECT account, {START_CASH} + sum(CASE side WHEN 'buy' THEN -filled * fill - fee ELSE filled * fill - fee END) AS derived, CAST(sum(CASE side WHEN 'buy' THEN filled ELSE -filled END) AS BIGINT) AS held, last(cash ORDER BY rn) AS cash, last(shares ORDER BY rn) AS shares, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("filled", "partially_filled", "rejected", "submitted"))} FROM fills GROUP BY account)
      SELECT account, round(derived, 2) AS derived, held, filled, partially_filled, rejected, submitted, abs(derived - cash) <= 0.011 AND held = shares AND cash >= 0 AS healthy FROM a""",
    "cost_breakdown": f"""WITH g AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS gross, o_orderkey % 2 = 1 AS sells FROM orders), p AS (SELECT o_orderkey, greatest({_PART('brokerage')}, CAST('{COSTS['minimum']}' AS DECIMAL(24,6))) AS brokerage, {_PART('exchange')} AS exchange, {_PART('regulatory')} AS regulatory, CASE WHEN sells THEN {_PART('tax_sell')} ELSE CAST(0 AS DECIMAL(24,6)) END AS tax FROM g),
      t AS (SELECT *, CAST(round(brokerage + exchange + regulatory + tax + CAST('{COSTS['settlement']}' AS DECIMAL(24,6)), 2) AS DECIMAL(24,2)) AS total FROM p) SELECT o_orderkey, {", ".join(f"CAST(round({c}, 2) AS DOUBLE) AS {c}" for c in ("brokerage", "exchange", "regulatory", "tax", "total"))}, {", ".join(f"CAST(round(total * CAST('{m}' AS DECIMAL(4,2)), 2) AS DOUBLE) AS times_{m.replace('.', '_')}" for m in MULTIPLIERS)} FROM t""",
    "fillable_volume": f"WITH v AS (SELECT l_orderkey, greatest(0.0, l_quantity * 100 - l_partkey % 500) AS visible FROM lineitem) SELECT l_orderkey, {', '.join(f'CAST(sum(floor(round(visible * {a}::DOUBLE * (1 - {b}::DOUBLE), 6))) AS BIGINT) AS {m}' for m, (a, b) in MODES.items())} FROM v GROUP BY l_orderkey",
    "market_phases": f"""WITH l AS (SELECT ts + INTERVAL {OFFSET_HOURS} HOUR AS moment FROM events), d AS (SELECT CAST(moment AS DATE) AS day, hour(moment) * 60 + minute(moment) AS m FROM l), s AS (SELECT day, m, CASE WHEN isodow(day) - 1 IN {WEEKEND} THEN 'weekend' WHEN day(day) = 1 THEN 'holiday' END AS shut FROM d),
      p AS (SELECT day, shut, CASE WHEN shut IS NOT NULL THEN 'closed' {" ".join(f"WHEN m >= {a} AND m < {b} THEN '{n}'" for n, a, b in PHASES)} ELSE 'closed' END AS phase FROM s) SELECT phase, coalesce(shut, CASE WHEN phase = 'closed' THEN 'outside_configured_period' ELSE 'configured_trading_period' END) AS reason, count(*) AS events, count(DISTINCT day) AS days FROM p GROUP BY ALL""",
    "quote_comparison": f"""WITH r AS (SELECT event_id, value AS price, event_id * 7 % 45 AS age, event_id % 19 = 0 AS unsafe, event_id % 17 <> 0 AS trusted, value AS close FROM events), a AS (SELECT * FROM r WHERE event_id % 29 <> 0), b AS (SELECT event_id, price * (1 + (event_id % 9 - 4) / 200) AS price_2, event_id * 5 % 43 AS age_2, close * (1 + (event_id % 7 - 3) / 150) AS close_2 FROM r WHERE event_id % 11 <> 0),
      j AS (SELECT *, price IS NOT NULL AS have, price_2 IS NOT NULL AS other FROM a FULL JOIN b USING (event_id)), k AS (SELECT event_id, {codes_sql(*_QUOTE_PAIRS)} AS reasons, have, coalesce({" OR ".join(f"coalesce({c}, false)" for c, label in _QUOTE_PAIRS if label in BLOCKING)}, false) AS blocked, CASE WHEN have THEN price ELSE price_2 END AS price FROM j)
      SELECT event_id, reasons, CASE WHEN NOT have THEN 'DEGRADED' WHEN blocked THEN 'UNSAFE' ELSE 'HEALTHY' END AS status, round(price, 6) AS price FROM k""",
    "suspensions": "WITH s AS (SELECT s_suppkey, s_suppkey AS k, s_acctbal, s_name FROM supplier), e AS (SELECT s_suppkey, CASE " + " ".join(f"WHEN {c} THEN '{label}'" for c, label in _TRIGGERS) + f" END AS trigger, {codes_sql(*_TRIGGERS)} AS every FROM s) SELECT s_suppkey, trigger, CAST(CASE WHEN every = '' THEN 0 ELSE len(string_split(every, ',')) END AS INT) AS triggers FROM e",
    "readiness": f"""WITH e AS (SELECT count(*) AS events, avg(CAST(event_type = 'error' AS DOUBLE)) AS errors, count(DISTINCT user_id) AS users, date_diff('day', min(ts), max(ts)) AS span FROM events), o AS (SELECT avg(CAST(o_orderstatus = 'P' AS DOUBLE)) AS open, count(*) AS orders FROM orders),
      c AS (SELECT *, {codes_sql(("span < 30", "history_too_short"), ("errors > 0.1", "too_many_errors"), ("open > 0.5", "too_many_open_orders"), ("users < 10", "too_few_users"), ("orders = 0", "no_orders"))} AS failing FROM e, o) SELECT events, orders, round(errors, 4) AS errors, round(open, 4) AS open, failing, failing = '' AS ready FROM c""",
    "daily_orders": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderstatus, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) - CAST(o_orderdate AS DATE) AS delay FROM orders) SELECT day, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, round(avg(delay), 6) AS mean_delay, max(o_orderkey) + 1 AS next_key FROM o GROUP BY day",
    "count_claims": "WITH f AS (SELECT o_orderstatus, o_orderpriority, count(*) AS found FROM orders GROUP BY ALL), c AS (SELECT o_orderstatus, o_orderpriority, found + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS claimed FROM f WHERE o_orderpriority <> '2-HIGH') SELECT *, CASE WHEN claimed IS NULL THEN 'unclaimed' WHEN claimed <> found THEN 'mismatch' ELSE 'reconciled' END AS status FROM f FULL JOIN c USING (o_orderstatus, o_orderpriority)",
    "runtime_samples": "WITH r AS (SELECT *, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), g AS (SELECT user_id, run, count(*) FILTER (value > 50) AS high, count(*) AS n, sum(value) AS total, max(value) AS peak FROM r GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS samples, round(sum(total) / sum(n), 6) AS mean, round(max(peak), 6) AS peak, max(high) AS longest_high FROM g GROUP BY user_id",
    "redacted_properties": """SELECT event_type, regexp_replace(props, '("k":\\s*)[^,}]+', '\\1"[REDACTED]"', 'g') AS props, count(*) AS events FROM events GROUP BY ALL""",
    "contributions": f"""{_FILLS}, a AS (SELECT account, sum(CASE WHEN side = 'sell' THEN filled * fill ELSE 0.0 END) AS sold, sum(CASE WHEN side = 'buy' THEN filled * fill ELSE 0.0 END) AS bought, sum(CASE side WHEN 'buy' THEN filled ELSE -filled END) AS held, last(fill ORDER BY rn) AS last, sum(fee) AS fees FROM fills WHERE filled > 0 GROUP BY account),
      g AS (SELECT *, round(sold + held * last - bought, 4) AS gain, bought / sum(bought) OVER () AS weight FROM a) SELECT account, round(gain, 3) AS gain, round(fees, 3) AS fees, round(gain / sum(gain) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY gain DESC, account) AS INT) AS place, round(sum(weight * weight) OVER (), 6) AS concentration FROM g""",
    "experiment_matrix": f"WITH {BARS_SQL}, n AS (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) SELECT symbol, concat_ws('-', f, s, r, c) AS design, bars, bars >= 3 * s AS usable FROM n, (SELECT unnest([10, 20, 30]) AS f), (SELECT unnest([50, 100]) AS s), (SELECT unnest(['monthly', 'quarterly']) AS r), (SELECT unnest(['base', 'double']) AS c)",
}
