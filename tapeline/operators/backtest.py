"""Signals, the long-or-flat backtest of one series, and its metrics; every run of every configuration is a key.

A signal at a close is traded at the next open, with whole shares, fee, slippage and a volume limit on buying.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, r6, wilson
from tapeline.functions.folds import fold
from tapeline.operators.windows import drawdown_summary, with_drawdown
from tapeline.sources.bars import BARS_SQL, bars, cyclic_bars, cyclic_index

# Capital, cost rates and parameters of the runs.
CAPITAL, FEE, SLIPPAGE = 25_000.0, 0.004, 0.001
GRID = ((10, 30), (20, 50), (30, 100))
COSTS = ((0.0, 0.0), (0.004, 0.001), (0.008, 0.0025))


def ma_signal(fast: int, slow: int):
    n = F.row_number().over(by_day())
    mean = lambda k: F.avg("close").over(by_day().rowsBetween(1 - k, 0))
    return F.coalesce(F.when(n >= slow, mean(fast) > mean(slow)), F.lit(False))


def breakout_signal(lookback: int = 20, times: float = 1.5):
    before = by_day().rowsBetween(-lookback, -1)
    return F.coalesce(F.when(F.row_number().over(by_day()) > lookback, (F.col("close") > F.max("close").over(before)) & (F.col("volume") > F.avg("volume").over(before) * times)), F.lit(False))


def momentum_signal(lookback: int = 60):
    """close above that of `lookback` bars before, where `index_close` (joined beforehand, by position) is so too."""
    up = lambda c: F.col(c) > F.lag(c, lookback).over(by_day())
    return F.coalesce(up("close") & up("index_close"), F.lit(False))


def hold_signal():
    return F.lit(True)


def _bar(state: list, want: bool, open_: float, volume: int, *, fee_rate: float, slip_rate: float, lot: int) -> tuple:
    """One bar of a run: state is [cash, quantity]; returns side, traded, fill, fee, cash, quantity."""
    cash, quantity = state
    side, traded, fill, fee = None, 0, 0.0, 0.0
    if want and quantity == 0:
        price = open_ * (1 + slip_rate)
        size = int(cash / (price * (1 + fee_rate)))
        size -= size % lot
        if size > 0 and (volume or 0) >= size:
            side, traded, fill, fee = "buy", size, price, size * price * fee_rate
            state[:] = [cash - (size * price + fee), size]
    elif not want and quantity > 0:
        fill = open_ * (1 - slip_rate)
        side, traded, fee = "sell", quantity, quantity * fill * fee_rate
        state[:] = [cash + (quantity * fill - fee), 0]
    return side, traded, fill, fee, *state


def backtest(signals: DataFrame, *, capital: float = CAPITAL, fee: float = FEE, slippage: float = SLIPPAGE, lot: int = 1, rates: tuple[str, str] | None = None) -> DataFrame:
    """run, symbol, day, desired, side, traded, fill, fee, cash, quantity, open, close, equity of signals (run, symbol,
    day, open, close, volume, desired). A null volume counts as 0; one bar alone trades nothing. rates names columns
    with a row's fee and slippage rates, in place of the two values."""
    window = Window.partitionBy("run", "symbol").orderBy("day")
    rows = signals.withColumn("want", F.coalesce(F.lag("desired").over(window), F.lit(False)))
    fee_column, slip_column = rates or ("_fee", "_slip")
    if not rates:
        rows = rows.withColumns({"_fee": F.lit(fee), "_slip": F.lit(slippage)})
    columns = ["want", "open", "volume", "day", "close", "desired", fee_column, slip_column]
    traded = fold(rows, ["run", "symbol"], ["day"], columns, lambda: [capital, 0], partial(_step, lot=lot), "side string, traded long, fill double, fee double, cash double, quantity long, open double, day date, close double, desired boolean")
    return traded.withColumn("equity", F.col("cash") + F.col("quantity") * F.col("close"))


def _step(state, want, open_, volume, day, close, desired, fee_rate, slip_rate, *, lot):
    """_bar with the bar's other columns passed through."""
    return *_bar(state, want, open_, volume, fee_rate=fee_rate, slip_rate=slip_rate, lot=lot), open_, day, close, desired


def closed_trades(curve: DataFrame) -> DataFrame:
    """run, symbol, k, buy_day, sell_day, profit: the k-th buy with the k-th sell, in one pass over the curve."""
    window = Window.partitionBy("run", "symbol", "side").orderBy("day")
    trades = curve.where("side is not null").withColumn("k", F.row_number().over(window))
    value = F.col("fill") * F.col("traded") + F.when(F.col("side") == "buy", F.col("fee")).otherwise(-F.col("fee"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, c))
    both = trades.groupBy("run", "symbol", "k").agg(*(of(side, F.col("day")).alias(f"{side}_day") for side in ("buy", "sell")), *(of(side, value).alias(side) for side in ("buy", "sell")))
    return both.where("buy is not null and sell is not null").select("run", "symbol", "k", "buy_day", "sell_day", (F.col("sell") - F.col("buy")).alias("profit"))


def metrics(curve: DataFrame, *, capital: float = CAPITAL, slippage: float = SLIPPAGE) -> DataFrame:
    """run, symbol and return, risk and cost figures; ratios without a denominator are null.

    Years are bars / 252, deviations are of the population, the Sortino ratio needs two falling bars."""
    window = Window.partitionBy("run", "symbol").orderBy("day")
    rows = with_drawdown(curve, "equity", ("run", "symbol")).withColumn("ret", F.col("equity") / F.nullif(F.lag("equity").over(window), F.lit(0.0)) - 1)
    rows = rows.withColumn("under", F.row_number().over(Window.partitionBy("run", "symbol", "spell").orderBy("day")) - 1)  # a spell begins at its peak
    down = F.when(F.col("ret") < 0, F.col("ret"))
    year = F.sqrt(F.lit(252.0))
    out = rows.groupBy("run", "symbol").agg(
        F.min("drawdown").alias("max_drawdown"), F.max("under").cast("long").alias("longest_bars"),
        F.count("*").alias("bars"), (F.max_by("equity", "day") / capital - 1).alias("total"), (F.stddev_pop("ret") * year).alias("volatility"), F.when(F.count(down) > 1, F.stddev_pop(down) * year).alias("downside"),
        F.count("side").alias("trades"), F.count_if(F.col("side") == "sell").alias("exits"), F.sum("fee").alias("fees"), F.sum(F.when(F.col("side").isNotNull(), F.col("open") * slippage * F.col("traded")).otherwise(0.0)).alias("slippage"),
        (F.sum(F.col("fill") * F.col("traded")) / capital).alias("turnover"), F.avg(F.col("desired").cast("double")).alias("exposure"),
    )
    out = out.withColumn("annual", F.when(F.col("total") > -1, F.pow(1 + F.col("total"), F.lit(252.0) / F.col("bars")) - 1).otherwise(-1.0))
    over = lambda c: F.col("annual") / F.nullif(F.round(c, 12), F.lit(0.0))
    return out.select(
        "run", "symbol", "bars", "trades", "exits", "longest_bars", *(r6(F.col(c) * 100).alias(f"{c}_percent") for c in ("total", "annual", "volatility", "exposure", "max_drawdown")),
        r6(over(F.col("volatility"))).alias("sharpe"), r6(over(F.col("downside"))).alias("sortino"), r6(over(F.abs("max_drawdown"))).alias("calmar"), *(r6(c).alias(c) for c in ("fees", "slippage", "turnover")),
    )


def signalled(series: DataFrame, runs: dict) -> DataFrame:
    """series once for each named signal, in one pass: the signals are columns first and then rows."""
    wide = series.withColumns({f"_{i}": s for i, s in enumerate(runs.values())})
    marks = F.explode(F.array(*(F.struct(F.lit(name).alias("run"), F.col(f"_{i}").alias("desired")) for i, name in enumerate(runs))))
    return wide.select("symbol", "day", "open", "close", "volume", marks.alias("x")).select("x.run", "symbol", "day", "open", "close", "volume", "x.desired")


def engine_backtest_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the 20/50 moving-average run of each symbol."""
    return metrics(backtest(signalled(bars(spark, sf_dir), {"ma_20_50": ma_signal(20, 50)})))


def engine_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buy and hold, breakout and the grid of moving averages, all symbols in one job."""
    runs = {"hold": hold_signal(), "breakout": breakout_signal()} | {f"ma_{a}_{b}": ma_signal(a, b) for a, b in GRID}
    return metrics(backtest(signalled(bars(spark, sf_dir), runs)))


def index_of(series: DataFrame) -> DataFrame:
    """day, close of an index: the mean close of the symbols that have a bar."""
    return series.groupBy("day").agg(F.avg("close").alias("close"))


def with_index(series: DataFrame, index: DataFrame) -> DataFrame:
    """series with index_close, the index's close at the same position (not day), null beyond its end."""
    at = F.row_number().over(Window.orderBy("day")).alias("at")
    places = index.select(at, F.col("close").alias("index_close"))
    return series.withColumn("at", F.row_number().over(by_day())).join(places, "at", "left").drop("at")


def with_alpha(figures: DataFrame, index: DataFrame) -> DataFrame:
    """metrics() with the index's total return and benchmark_alpha_percent, the annual return less that total; without
    an index of two bars the return is null and alpha 0."""
    total = F.when(F.count("*") > 1, (F.max_by("close", "day") / F.min_by("close", "day") - 1) * 100)
    out = figures.crossJoin(index.agg(total.alias("benchmark")))
    return out.select(*figures.columns, r6("benchmark").alias("benchmark_return_percent"), F.coalesce(r6(F.col("annual_percent") - F.col("benchmark")), F.lit(0.0)).alias("benchmark_alpha_percent"))


def engine_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four strategies, momentum with the mean close of all symbols as its index, and their alpha against it."""
    series = bars(spark, sf_dir)
    index = index_of(series)
    runs = {"hold": hold_signal(), "breakout": breakout_signal(), "momentum": momentum_signal()} | {f"ma_{a}_{b}": ma_signal(a, b) for a, b in GRID}
    return with_alpha(metrics(backtest(signalled(with_index(series, index), runs))), index)


def engine_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four strategies on the 500-bar cycle with a capital of 1,000,000, whose figures are known; the tables of
    sf_dir are not read."""
    index = cyclic_index(spark)
    runs = {"hold": hold_signal(), "ma_20_50": ma_signal(20, 50), "momentum": momentum_signal(60), "breakout": breakout_signal(20, 1.5)}
    curve = backtest(signalled(with_index(cyclic_bars(spark), index), runs), capital=1_000_000.0)
    return with_alpha(metrics(curve, capital=1_000_000.0), index)


def engine_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = backtest(signalled(bars(spark, sf_dir), {"ma_20_50": ma_signal(20, 50)}))
    return curve.select("symbol", "day", "side", "traded", r6("fill").alias("fill"), r6("fee").alias("fee"), r6("equity").alias("equity"))


def engine_closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades of each run: counts, profit factor, expectancy and the Wilson interval of the share of wins."""
    trades = closed_trades(backtest(signalled(bars(spark, sf_dir), {f"ma_{a}_{b}": ma_signal(a, b) for a, b in GRID})))
    win = F.col("profit") > 0
    out = trades.groupBy("run", "symbol").agg(F.count("*").alias("closed"), F.count_if(win).alias("wins"), F.sum(F.when(win, F.col("profit")).otherwise(0.0)).alias("gained"), F.sum(F.when(~win, -F.col("profit")).otherwise(0.0)).alias("lost"))
    low, high = wilson(F.col("wins"), F.col("closed"))
    return out.select("run", "symbol", "closed", "wins", r6(F.col("gained") / F.nullif("lost", F.lit(0.0))).alias("profit_factor"), r6((F.col("gained") - F.col("lost")) / F.col("closed")).alias("expectancy"), r6(low).alias("win_low"), r6(high).alias("win_high"))


def engine_cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final equity of the 20/50 run under three levels of cost."""
    series = signalled(bars(spark, sf_dir), {"ma_20_50": ma_signal(20, 50)})
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(f).alias("fee_rate"), F.lit(s).alias("slip_rate")) for k, (f, s) in enumerate(COSTS))))
    runs = series.withColumn("x", levels).select("*", F.col("x.level").cast("string").alias("run_level"), "x.fee_rate", "x.slip_rate").drop("run", "x").withColumnRenamed("run_level", "run")
    curve = backtest(runs, rates=("fee_rate", "slip_rate"))
    return curve.groupBy("symbol", F.col("run").cast("int").alias("level")).agg(r6(F.max_by("equity", "day")).alias("final_equity"))


def engine_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return and volatility of the 20/50 curve in fifths of its bars, each from its own first equity."""
    window = Window.partitionBy("symbol").orderBy("day")
    curve = backtest(signalled(bars(spark, sf_dir), {"ma_20_50": ma_signal(20, 50)}))
    rows = curve.withColumn("fold", F.floor((F.row_number().over(window) - 1) * 5 / F.count("*").over(Window.partitionBy("symbol"))))
    rows = rows.withColumn("ret", F.col("equity") / F.lag("equity").over(Window.partitionBy("symbol", "fold").orderBy("day")) - 1)
    return rows.groupBy("symbol", "fold").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), r6(F.max_by("equity", "day") / F.min_by("equity", "day") - 1).alias("ret"), r6(F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("volatility"))


def in_windows(curve: DataFrame) -> DataFrame:
    """The curve's bars once for each window that has them, named in `part`: the holdouts after 40, 60 and 80 % of the
    bars up to 60, 80 and 100 %, all three as one, and the thirds."""
    n = F.count("*").over(Window.partitionBy("run", "symbol"))
    rows = curve.withColumns({"_n": n, "_i": F.row_number().over(Window.partitionBy("run", "symbol").orderBy("day")) - 1})
    at = [F.floor(F.col("_n") * F.lit(x)) for x in (0.4, 0.6, 0.8, 1.0)]
    third = [F.lit(0), F.floor(F.col("_n") / 3), F.floor(F.col("_n") * 2 / 3), F.col("_n")]
    spans = {f"holdout_{k + 1}": (at[k], at[k + 1]) for k in range(3)} | {"holdouts": (at[0], at[3])} | {f"third_{k + 1}": (third[k], third[k + 1]) for k in range(3)}
    parts = F.array_compact(F.array(*(F.when((F.col("_i") >= low) & (F.col("_i") < high), F.lit(name)) for name, (low, high) in spans.items())))
    return rows.withColumn("part", F.explode(parts)).drop("_n", "_i")


def window_metrics(curve: DataFrame) -> DataFrame:
    """run, symbol, part and the figures of each window of two bars or more, from its own first equity; years are days
    / 365.25, deviations of the population, ratios without a denominator null."""
    keys = ("run", "symbol", "part")
    rows = in_windows(curve)
    rows = rows.withColumn("ret", F.col("equity") / F.lag("equity").over(Window.partitionBy(*keys).orderBy("day")) - 1)
    down, year = F.when(F.col("ret") < 0, F.col("ret")), F.sqrt(F.lit(252.0))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("bars"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max_by("equity", "day").alias("final"), F.min_by("equity", "day").alias("initial"),
        F.coalesce(F.when(F.count("ret") > 1, F.stddev_pop("ret") * year), F.lit(0.0)).alias("volatility"), F.when(F.count(down) > 1, F.stddev_pop(down) * year).alias("downside"),
    ).where("bars > 1")
    years = F.greatest(F.datediff("last_day", "first_day") / F.lit(365.25), 1 / F.lit(365.25))
    out = out.withColumn("annual", F.when(F.col("final") > 0, F.pow(F.col("final") / F.col("initial"), 1 / years) - 1).otherwise(-1.0)).withColumn("total", F.col("final") / F.col("initial") - 1)
    out = out.join(drawdown_summary(rows, "equity", keys), list(keys))
    over = lambda c: r6(F.col("annual") / F.nullif(F.round(c, 12), F.lit(0.0)))
    return out.select(
        *keys, "bars", "first_day", "last_day", "longest_bars", "longest_days", *(r6(F.col(c) * 100).alias(f"{c}_percent") for c in ("total", "annual", "volatility", "max_drawdown")),
        over(F.col("volatility")).alias("sharpe"), over(F.col("downside")).alias("sortino"), over(F.abs("max_drawdown")).alias("calmar"), r6("final").alias("final_equity"),
    )


def engine_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the 20/50 curve in the holdouts at 40, 60, 80 and 100 % and in thirds."""
    return window_metrics(backtest(signalled(bars(spark, sf_dir), {"ma_20_50": ma_signal(20, 50)})))


def engine_period_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly returns of the 20/50 curve, chained from the capital."""
    curve = backtest(signalled(bars(spark, sf_dir), {"ma_20_50": ma_signal(20, 50)}))
    years = curve.groupBy("symbol", F.year("day").alias("year")).agg(F.max_by("equity", "day").alias("equity"))
    before = F.coalesce(F.lag("equity").over(Window.partitionBy("symbol").orderBy("year")), F.lit(CAPITAL))
    return years.select("symbol", "year", r6((F.col("equity") / before - 1) * 100).alias("return_percent"))


QUERIES = {f.__name__: f for f in (engine_backtest_ma, engine_strategies, engine_benchmark, engine_curve, engine_closed_trades, engine_cost_stress, engine_walk_forward, engine_holdouts, engine_period_returns)}


def _signal_sql(runs: dict[str, str]) -> str:
    return f"WITH RECURSIVE {BARS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM bars), signals AS (" + " UNION ALL ".join(f"SELECT '{k}' AS run, symbol, day, rn, open, close, volume, coalesce({v}, false) AS desired FROM numbered" for k, v in runs.items()) + ")"


def _ma_sql(a: int, b: int) -> str:
    mean = lambda k: f"avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS {k - 1} PRECEDING)"
    return f"CASE WHEN rn >= {b} THEN {mean(a)} > {mean(b)} END"


def _curve_sql(runs: dict[str, str], fee: float = FEE, slip: float = SLIPPAGE) -> str:
    """The fold as a recursive query over row numbers."""
    size = f"trunc(s.cash / (r.open * (1 + {slip}::DOUBLE) * (1 + {fee}::DOUBLE)))"
    buys = f"(r.want AND s.quantity = 0 AND {size} > 0 AND r.volume >= {size})"
    sells = "(NOT r.want AND s.quantity > 0)"
    fill_b, fill_s = f"(r.open * (1 + {slip}::DOUBLE))", f"(r.open * (1 - {slip}::DOUBLE))"
    return f"""{_signal_sql(runs)}, wants AS (SELECT *, coalesce(lag(desired) OVER (PARTITION BY run, symbol ORDER BY rn), false) AS want FROM signals),
steps AS (SELECT DISTINCT run, symbol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS side, 0.0::DOUBLE AS traded, 0.0::DOUBLE AS fill, 0.0::DOUBLE AS fee, {CAPITAL}::DOUBLE AS cash, 0.0::DOUBLE AS quantity FROM signals
 UNION ALL SELECT r.run, r.symbol, r.rn, CASE WHEN {buys} THEN 'buy' WHEN {sells} THEN 'sell' END, CASE WHEN {buys} THEN {size} WHEN {sells} THEN s.quantity ELSE 0.0 END, CASE WHEN {buys} THEN {fill_b} WHEN {sells} THEN {fill_s} ELSE 0.0 END,
  CASE WHEN {buys} THEN {size} * {fill_b} * {fee}::DOUBLE WHEN {sells} THEN s.quantity * {fill_s} * {fee}::DOUBLE ELSE 0.0 END,
  CASE WHEN {buys} THEN s.cash - ({size} * {fill_b} + {size} * {fill_b} * {fee}::DOUBLE) WHEN {sells} THEN s.cash + (s.quantity * {fill_s} - s.quantity * {fill_s} * {fee}::DOUBLE) ELSE s.cash END,
  CASE WHEN {buys} THEN {size} WHEN {sells} THEN 0.0 ELSE s.quantity END FROM steps s JOIN wants r ON r.run = s.run AND r.symbol = s.symbol AND r.rn = s.rn + 1),
curve AS (SELECT w.run, w.symbol, w.day, w.rn, w.open, w.desired, s.side, CAST(s.traded AS BIGINT) AS traded, s.fill, s.fee, s.cash + s.quantity * w.close AS equity FROM steps s JOIN wants w ON w.run = s.run AND w.symbol = s.symbol AND w.rn = s.rn)"""


_METRICS_SQL = f""", p AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY run, symbol ORDER BY day), 0) - 1 AS ret, max(equity) OVER (PARTITION BY run, symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM curve),
d AS (SELECT *, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY run, symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS spell FROM p),
sp AS (SELECT run, symbol, spell, min(equity / peak - 1) AS deepest, count(*) FILTER (equity < peak) AS n FROM d GROUP BY ALL), dd AS (SELECT run, symbol, min(deepest) AS max_drawdown, max(n) AS longest_bars FROM sp GROUP BY ALL),
m AS (SELECT run, symbol, count(*) AS bars, last(equity ORDER BY day) / {CAPITAL} - 1 AS total, stddev_pop(ret) * sqrt(252.0) AS volatility, CASE WHEN count(*) FILTER (ret < 0) > 1 THEN stddev_pop(ret) FILTER (ret < 0) * sqrt(252.0) END AS downside, count(side) AS trades, count(*) FILTER (side = 'sell') AS exits, sum(fee) AS fees,
  sum(CASE WHEN side IS NOT NULL THEN open * {SLIPPAGE} * traded ELSE 0.0 END) AS slippage, sum(fill * traded) / {CAPITAL} AS turnover, avg(CAST(desired AS DOUBLE)) AS exposure FROM p GROUP BY run, symbol),
a AS (SELECT *, CASE WHEN total > -1 THEN pow(1 + total, 252.0 / bars) - 1 ELSE -1.0 END AS annual FROM m)
SELECT run, symbol, bars, trades, exits, longest_bars, round(total * 100, 6) AS total_percent, round(annual * 100, 6) AS annual_percent, round(volatility * 100, 6) AS volatility_percent, round(exposure * 100, 6) AS exposure_percent, round(max_drawdown * 100, 6) AS max_drawdown_percent,
  round(annual / nullif(round(volatility, 12), 0), 6) AS sharpe, round(annual / nullif(round(downside, 12), 0), 6) AS sortino, round(annual / nullif(round(abs(max_drawdown), 12), 0), 6) AS calmar, round(fees, 6) AS fees, round(slippage, 6) AS slippage, round(turnover, 6) AS turnover FROM a JOIN dd USING (run, symbol)"""
_ONE = {"ma_20_50": _ma_sql(20, 50)}
_MAS = {f"ma_{a}_{b}": _ma_sql(a, b) for a, b in GRID}
_BREAK = "CASE WHEN rn > 20 THEN close > max(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AND volume > avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * 1.5 END"
_INDEX = "(SELECT avg(close) AS close, day, row_number() OVER (ORDER BY day) AS at FROM bars GROUP BY day)"
_UP = f"(SELECT i.close > j.close FROM {_INDEX} i JOIN {_INDEX} j ON i.at = j.at + 60 WHERE i.at = rn)"
_MOMENTUM = f"CASE WHEN rn > 60 THEN close > lag(close, 60) OVER (PARTITION BY symbol ORDER BY day) AND coalesce({_UP}, false) END"
_Z = 1.959963984540054
ORACLE = {
    "engine_backtest_ma": _curve_sql(_ONE) + _METRICS_SQL,
    "engine_strategies": _curve_sql({"hold": "true", "breakout": _BREAK} | _MAS) + _METRICS_SQL,
    "engine_benchmark": f"""WITH m AS ({_curve_sql({"hold": "true", "breakout": _BREAK, "momentum": _MOMENTUM} | _MAS) + _METRICS_SQL}), b AS (WITH {BARS_SQL} SELECT (last(close ORDER BY day) / first(close ORDER BY day) - 1) * 100 AS total FROM {_INDEX})
      SELECT m.*, round(b.total, 6) AS benchmark_return_percent, round(m.annual_percent - b.total, 6) AS benchmark_alpha_percent FROM m, b""",
    "engine_holdouts": _curve_sql(_ONE) + """, n AS (SELECT *, count(*) OVER (PARTITION BY run, symbol) AS n FROM curve), s AS (SELECT *, [{'part': 'holdout_1', 'low': floor(n * 0.4::DOUBLE), 'high': floor(n * 0.6::DOUBLE)}, {'part': 'holdout_2', 'low': floor(n * 0.6::DOUBLE), 'high': floor(n * 0.8::DOUBLE)}, {'part': 'holdout_3', 'low': floor(n * 0.8::DOUBLE), 'high': n::DOUBLE},
      {'part': 'holdouts', 'low': floor(n * 0.4::DOUBLE), 'high': n::DOUBLE}, {'part': 'third_1', 'low': 0::DOUBLE, 'high': (n // 3)::DOUBLE}, {'part': 'third_2', 'low': (n // 3)::DOUBLE, 'high': (n * 2 // 3)::DOUBLE}, {'part': 'third_3', 'low': (n * 2 // 3)::DOUBLE, 'high': n::DOUBLE}] AS spans FROM n),
      u AS (SELECT * EXCLUDE (spans), unnest(spans) AS span FROM s), w AS (SELECT run, symbol, day, equity, span.part AS part FROM u WHERE rn - 1 >= span.low AND rn - 1 < span.high),
      p AS (SELECT *, equity / lag(equity) OVER g - 1 AS ret, max(equity) OVER (g ROWS UNBOUNDED PRECEDING) AS peak FROM w WINDOW g AS (PARTITION BY run, symbol, part ORDER BY day)),
      d AS (SELECT *, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY run, symbol, part ORDER BY day ROWS UNBOUNDED PRECEDING) AS spell FROM p),
      sp AS (SELECT run, symbol, part, spell, min(equity / peak - 1) AS deepest, count(*) FILTER (equity < peak) AS n, max(day) - min(day) FILTER (equity < peak) AS days FROM d GROUP BY ALL), dd AS (SELECT run, symbol, part, min(deepest) AS max_drawdown, max(n) AS longest_bars, coalesce(max(days), 0) AS longest_days FROM sp GROUP BY ALL),
      m AS (SELECT run, symbol, part, count(*) AS bars, min(day) AS first_day, max(day) AS last_day, last(equity ORDER BY day) AS final, first(equity ORDER BY day) AS initial, CASE WHEN count(ret) > 1 THEN stddev_pop(ret) * sqrt(252.0) ELSE 0.0 END AS volatility, CASE WHEN count(*) FILTER (ret < 0) > 1 THEN stddev_pop(ret) FILTER (ret < 0) * sqrt(252.0) END AS downside FROM p GROUP BY run, symbol, part HAVING count(*) > 1),
      a AS (SELECT *, final / initial - 1 AS total, CASE WHEN final > 0 THEN pow(final / initial, 1 / greatest((last_day - first_day) / 365.25, 1 / 365.25)) - 1 ELSE -1.0 END AS annual FROM m)
      SELECT run, symbol, part, bars, first_day, last_day, longest_bars, longest_days, round(total * 100, 6) AS total_percent, round(annual * 100, 6) AS annual_percent, round(volatility * 100, 6) AS volatility_percent, round(max_drawdown * 100, 6) AS max_drawdown_percent,
        round(annual / nullif(round(volatility, 12), 0), 6) AS sharpe, round(annual / nullif(round(downside, 12), 0), 6) AS sortino, round(annual / nullif(round(abs(max_drawdown), 12), 0), 6) AS calmar, round(final, 6) AS final_equity FROM a JOIN dd USING (run, symbol, part)""",
    "engine_curve": _curve_sql(_ONE) + " SELECT symbol, day, side, traded, round(fill, 6) AS fill, round(fee, 6) AS fee, round(equity, 6) AS equity FROM curve",
    "engine_closed_trades": _curve_sql(_MAS) + f""", t AS (SELECT run, symbol, side, row_number() OVER (PARTITION BY run, symbol, side ORDER BY day) AS k, fill * traded + CASE side WHEN 'buy' THEN fee ELSE -fee END AS value FROM curve WHERE side IS NOT NULL),
      c AS (SELECT b.run, b.symbol, s.value - b.value AS profit FROM t b JOIN t s ON b.run = s.run AND b.symbol = s.symbol AND b.k = s.k AND b.side = 'buy' AND s.side = 'sell'),
      g AS (SELECT run, symbol, count(*) AS closed, count(*) FILTER (profit > 0) AS wins, sum(CASE WHEN profit > 0 THEN profit ELSE 0.0 END) AS gained, sum(CASE WHEN profit > 0 THEN 0.0 ELSE -profit END) AS lost FROM c GROUP BY ALL)
      SELECT run, symbol, closed, wins, round(gained / nullif(lost, 0), 6) AS profit_factor, round((gained - lost) / closed, 6) AS expectancy, round((wins / closed + {_Z} * {_Z} / (2 * closed)) / (1 + {_Z} * {_Z} / closed) - {_Z} * sqrt(wins / closed * (1 - wins / closed) / closed + {_Z} * {_Z} / (4 * closed * closed)) / (1 + {_Z} * {_Z} / closed), 6) AS win_low,
        round((wins / closed + {_Z} * {_Z} / (2 * closed)) / (1 + {_Z} * {_Z} / closed) + {_Z} * sqrt(wins / closed * (1 - wins / closed) / closed + {_Z} * {_Z} / (4 * closed * closed)) / (1 + {_Z} * {_Z} / closed), 6) AS win_high FROM g""",
    "engine_cost_stress": " UNION ALL ".join(f"SELECT * FROM ({_curve_sql(_ONE, f, s)} SELECT symbol, {k} AS level, round(last(equity ORDER BY day), 6) AS final_equity FROM curve GROUP BY symbol)" for k, (f, s) in enumerate(COSTS)),
    "engine_walk_forward": _curve_sql(_ONE) + """, f AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY day) - 1) * 5 // count(*) OVER (PARTITION BY symbol) AS fold FROM curve), r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol, fold ORDER BY day) - 1 AS ret FROM f)
      SELECT symbol, fold, min(day) AS first_day, max(day) AS last_day, round(last(equity ORDER BY day) / first(equity ORDER BY day) - 1, 6) AS ret, round(stddev_pop(ret) * sqrt(252.0), 6) AS volatility FROM r GROUP BY symbol, fold""",
    "engine_period_returns": _curve_sql(_ONE) + f""", y AS (SELECT symbol, CAST(year(day) AS INT) AS year, last(equity ORDER BY day) AS equity FROM curve GROUP BY ALL) SELECT symbol, year, round((equity / coalesce(lag(equity) OVER (PARTITION BY symbol ORDER BY year), {CAPITAL}) - 1) * 100, 6) AS return_percent FROM y""",
}
