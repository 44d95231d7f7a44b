"""Closed trades, drawdowns and reports against days and intervals, and lives without their suspensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, codes, codes_sql
from tapeline.functions.intervals import covering, points_within, subtracted
from tapeline.operators.backtest import SLIPPAGE, _curve_sql, _ma_sql, backtest, ma_signal, signalled
from tapeline.operators.windows import ORACLE as _WINDOWS_SQL
from tapeline.operators.windows import win_drawdown_episodes
from tapeline.sources.bars import BARS_SQL, bars, table
from tapeline.sources.scratch import written

# What makes an entry or exit late, a gap adverse, a cost high, a trade short or prolonged, and days near.
LATE_ENTRY, LATE_EXIT, ADVERSE, HIGH_COST, SHORT, PROLONGED, NEAR, GAP = 0.05, -0.10, 0.03, 0.25, 10, 60, 5, 7
#: A close that is so many times the one before, or so small a part of it, excludes its day.
JUMP = 3.0


def excluded_days(series: DataFrame) -> DataFrame:
    """symbol, day: sessions whose close jumps against the one before."""
    move = F.col("close") / F.lag("close").over(by_day())
    return series.withColumn("move", move).where((F.col("move") >= JUMP) | (F.col("move") <= 1 / JUMP)).select("symbol", "day")


def closed_trade_records(curve: DataFrame, excluded: DataFrame) -> DataFrame:
    """Each closed trade of a curve (symbol, day, open, close, side, fill, traded, fee): when, what it made and cost, its
    flags, and how many excluded days lie strictly inside it. Buys pair with sells in turn: a trade's bars share the
    number of buys so far. Of the primary classes the first that holds counts."""
    before = lambda c, n=1: F.lag(c, n).over(by_day())
    rows = curve.withColumns({"prior": F.coalesce(before("close"), F.col("open")), "before": before("close", 20), "gap": F.datediff("day", before("day")), "k": F.sum(F.when(F.col("side") == "buy", 1).otherwise(0)).over(by_day().rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(by_day())})
    rows = rows.withColumns({"gap_before": before("gap"), "gap_after": F.lead("gap").over(by_day()), "sold": F.max(F.when(F.col("side") == "sell", F.col("day"))).over(Window.partitionBy("symbol", "k"))})
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    names = {"i": "i", "day": "day", "fill": "price", "fee": "fee", "open": "open", "prior": "prior", "before": "before", "traded": "quantity", "gap_before": "gap_before", "gap_after": "gap_after"}
    held = rows.where("k > 0 AND day <= sold").groupBy("symbol", "k").agg(F.max("close").alias("peak"), F.max("gap").alias("gap"), *(at(side, c).alias(f"{x}_{side}") for side in ("buy", "sell") for c, x in names.items()))
    t = held.withColumns({
        "gross": F.col("price_sell") * F.col("quantity_sell") - F.col("price_buy") * F.col("quantity_buy"), "holding": F.col("i_sell") - F.col("i_buy"), "slipped": (F.col("open_buy") * F.col("quantity_buy") + F.col("open_sell") * F.col("quantity_sell")) * SLIPPAGE,
        "adverse": F.round(F.greatest(F.col("price_buy") / F.col("prior_buy") - 1, F.col("prior_sell") / F.col("price_sell") - 1), 9),
    }).withColumns({"net": F.col("gross") - F.col("fee_buy") - F.col("fee_sell"), "cost": F.col("fee_buy") + F.col("fee_sell") + F.col("slipped"), "entry": F.col("day_buy"), "exit": F.col("day_sell")})
    near = lambda c: (F.date_sub(c, NEAR), F.date_add(c, NEAR))
    t = points_within(t, excluded, ["symbol"], inside=(F.date_add("entry", 1), F.date_sub("exit", 1)), near_entry=near("entry"), near_exit=near("exit"))
    lost, gap_loss = F.col("net") < 0, (F.col("net") < 0) & (F.col("adverse") >= ADVERSE)
    flags = codes(
        (F.round(F.col("price_buy") / F.col("before_buy") - 1, 9) >= LATE_ENTRY, "late_entry"), (F.round(F.col("price_sell") / F.col("peak") - 1, 9) <= LATE_EXIT, "late_exit"), (gap_loss, "gap_loss"),
        (F.greatest("gap", "gap_before_buy", "gap_after_sell") > GAP, "missing_data_adjacency"), (F.col("near_entry") + F.col("near_exit") > 0, "exclusion_interval_adjacency"),
        (F.when(F.col("gross") != 0, F.round(F.col("cost") - HIGH_COST * F.abs("gross"), 9) >= 0).otherwise(F.col("cost") > 0), "high_cost_trade"), (F.col("holding") <= SHORT, "low_duration_trade"),
        (lost & (F.col("holding") >= PROLONGED), "prolonged_losing_trade"), (lost & (F.col("holding") < PROLONGED), "whipsaw"), (F.col("net") > 0, "profitable_trend_capture"),
    )
    primary = F.when(gap_loss, "gap_loss").when(lost & (F.col("holding") >= PROLONGED), "prolonged_losing_trade").when(lost, "whipsaw").otherwise("profitable_trend_capture")
    money = [F.round(c, 2).alias(c) for c in ("gross", "net", "cost")]
    return t.select("symbol", F.col("k").cast("long").alias("k"), "entry", "exit", F.col("holding").cast("long").alias("holding"), *money, primary.alias("primary"), flags.alias("flags"), F.col("inside").cast("long").alias("inside"))


def trade_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades of the 20/50 run against the days that jumps exclude."""
    series = written(bars(spark, sf_dir), "interval-bars")
    return closed_trade_records(backtest(signalled(series, {"ma_20_50": ma_signal(20, 50)})), excluded_days(series))


def drawdown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawdown episodes of the closes with the excluded days from a week before to a week after each."""
    episodes = win_drawdown_episodes(spark, sf_dir).select("symbol", "first_day", "last_day", "depth")
    near = points_within(episodes, excluded_days(bars(spark, sf_dir)), ["symbol"], events=(F.date_sub("first_day", 7), F.date_add("last_day", 7)))
    return near.withColumn("events", F.col("events").cast("long"))


def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By symbol and month: sessions that some report covers, and the most reports on one. Reports are finished orders, of
    the customer's symbol, from their day on for as many days as their key leaves of 4 (none for 0)."""
    reports = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderkey % 8 < 4").select(F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("first"), (F.col("o_orderkey") % 4 - 1).cast("int").alias("more"))
    ranges = reports.select("symbol", "first", F.date_add("first", F.col("more")).alias("last"))
    days = covering(bars(spark, sf_dir).select("symbol", "day"), ranges, ["symbol"])
    return days.groupBy("symbol", F.trunc("day", "MM").alias("month")).agg(F.count("*").alias("sessions"), F.count_if(F.col("covers") > 0).alias("covered"), F.max("covers").cast("long").alias("most"))


def lifecycle_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's days from first to last shipment without its suspensions (returned lines, from some days before
    their shipment to some after it), with the number of days."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_returnflag", F.col("l_linenumber").cast("int").alias("line"))
    bounds = lines.groupBy("l_suppkey").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    holes = lines.where("l_returnflag = 'R'").select("l_suppkey", F.date_sub("day", F.col("line") % 3).alias("first"), F.date_add("day", F.col("line") * 3 - 5).alias("last"))
    left = subtracted(bounds, holes, ["l_suppkey"])
    return left.select("l_suppkey", F.col("first").alias("first_day"), F.col("last").alias("last_day"), (F.datediff("last", "first") + 1).cast("long").alias("days"))


QUERIES = {f.__name__: f for f in (trade_intervals, drawdown_events, report_coverage, lifecycle_intervals)}

_JUMPS = f"jumps AS (SELECT symbol, day FROM (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) AS move FROM bars) WHERE move >= {JUMP} OR move <= 1 / {JUMP}::DOUBLE)"
_BY = "(PARTITION BY c.symbol ORDER BY c.day)"
_NAMES = {"i": "i", "day": "day", "fill": "price", "fee": "fee", "open": "open", "prior": "prior", "before": "before", "traded": "quantity", "gap_before": "gap_before", "gap_after": "gap_after"}
_WITHIN = lambda low, high: f"(SELECT count(*) FROM jumps j WHERE j.symbol = t.symbol AND j.day BETWEEN {low} AND {high})"
_GAP_LOSS = f"net < 0 AND adverse >= {ADVERSE}"
_FLAGS = codes_sql(
    (f"round(price_buy / before_buy - 1, 9) >= {LATE_ENTRY}", "late_entry"), (f"round(price_sell / peak - 1, 9) <= {LATE_EXIT}", "late_exit"), (_GAP_LOSS, "gap_loss"), (f"greatest(gap, gap_before_buy, gap_after_sell) > {GAP}", "missing_data_adjacency"), ("near_entry + near_exit > 0", "exclusion_interval_adjacency"),
    (f"CASE WHEN gross <> 0 THEN round(cost - {HIGH_COST} * abs(gross), 9) >= 0 ELSE cost > 0 END", "high_cost_trade"), (f"holding <= {SHORT}", "low_duration_trade"), (f"net < 0 AND holding >= {PROLONGED}", "prolonged_losing_trade"), (f"net < 0 AND holding < {PROLONGED}", "whipsaw"), ("net > 0", "profitable_trend_capture"),
)
ORACLE = {
    "trade_intervals": f"""{_curve_sql({"ma_20_50": _ma_sql(20, 50)})}, {_JUMPS},
      b AS (SELECT c.*, r.close, coalesce(lag(r.close) OVER {_BY}, c.open) AS prior, lag(r.close, 20) OVER {_BY} AS before, c.day - lag(c.day) OVER {_BY} AS gap, sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) OVER (PARTITION BY c.symbol ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS k, row_number() OVER {_BY} AS i FROM curve c JOIN bars r ON r.symbol = c.symbol AND r.day = c.day),
      g AS (SELECT *, lag(gap) OVER (PARTITION BY symbol ORDER BY day) AS gap_before, lead(gap) OVER (PARTITION BY symbol ORDER BY day) AS gap_after, max(CASE WHEN side = 'sell' THEN day END) OVER (PARTITION BY symbol, k) AS sold FROM b),
      h AS (SELECT symbol, k, max(close) AS peak, max(gap) AS gap, {", ".join(f"max({c}) FILTER (side = '{side}') AS {x}_{side}" for side in ("buy", "sell") for c, x in _NAMES.items())} FROM g WHERE k > 0 AND day <= sold GROUP BY symbol, k),
      t AS (SELECT *, price_sell * quantity_sell - price_buy * quantity_buy AS gross, i_sell - i_buy AS holding, day_buy AS entry, day_sell AS exit, round(greatest(price_buy / prior_buy - 1, prior_sell / price_sell - 1), 9) AS adverse, (open_buy * quantity_buy + open_sell * quantity_sell) * {SLIPPAGE}::DOUBLE AS slipped FROM h),
      n AS (SELECT *, gross - fee_buy - fee_sell AS net, fee_buy + fee_sell + slipped AS cost, {_WITHIN("entry + 1", "exit - 1")} AS inside, {_WITHIN(f"entry - {NEAR}", f"entry + {NEAR}")} AS near_entry, {_WITHIN(f"exit - {NEAR}", f"exit + {NEAR}")} AS near_exit FROM t)
      SELECT symbol, CAST(k AS BIGINT) AS k, entry, exit, holding, round(gross, 2) AS gross, round(net, 2) AS net, round(cost, 2) AS cost, CASE WHEN {_GAP_LOSS} THEN 'gap_loss' WHEN net < 0 AND holding >= {PROLONGED} THEN 'prolonged_losing_trade' WHEN net < 0 THEN 'whipsaw' ELSE 'profitable_trend_capture' END AS "primary", {_FLAGS} AS flags, inside FROM n""",
    "drawdown_events": f"WITH {BARS_SQL}, {_JUMPS}, t AS (SELECT * FROM ({_WINDOWS_SQL['win_drawdown_episodes']})) SELECT symbol, first_day, last_day, depth, {_WITHIN('first_day - 7', 'last_day + 7')} AS events FROM t",
    "report_coverage": f"""WITH {BARS_SQL}, r AS (SELECT 'S' || CAST(o_custkey % 5 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS first, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 - 1 AS INT) AS last FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 8 < 4),
      d AS (SELECT b.symbol, b.day, count(r.first) AS covers FROM bars b LEFT JOIN r ON r.symbol = b.symbol AND b.day BETWEEN r.first AND r.last GROUP BY b.symbol, b.day)
      SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS sessions, count(*) FILTER (covers > 0) AS covered, max(covers) AS most FROM d GROUP BY ALL""",
    "lifecycle_intervals": """WITH l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_returnflag, CAST(l_linenumber AS INT) AS line FROM lineitem), h AS (SELECT l_suppkey, day - line % 3 AS first, day + (line * 3 - 5) AS last FROM l WHERE l_returnflag = 'R'),
      d AS (SELECT l_suppkey, unnest(range(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM l GROUP BY l_suppkey), k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_suppkey = d.l_suppkey AND d.day BETWEEN h.first AND h.last)),
      i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY day) AS INT) AS island FROM k) SELECT l_suppkey, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY l_suppkey, island""",
}
