"""Equity curves: metrics in three conventions, islands, regimes, combinations, contributions and robustness.

The queries' curves hold one unit of each symbol from its first bar on, scaled to CAPITAL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, codes, codes_sql, r6, ratio
from tapeline.operators.windows import drawdown_summary
from tapeline.sources.bars import BARS_SQL, CALENDAR_SQL, bars, common

CAPITAL = 25_000.0
YEAR = 252.0
EPISODE = -0.1
SPLITS, PARTS = 3, (0.5, 0.25, 0.25)


def curves(series: DataFrame) -> DataFrame:
    """symbol, day, close, equity: CAPITAL in each symbol at its first close."""
    return series.select("symbol", "day", "close", (F.col("close") / F.first("close").over(by_day()) * CAPITAL).alias("equity"))


def with_returns(curve: DataFrame) -> DataFrame:
    return curve.withColumn("ret", ratio(F.col("equity"), F.lag("equity").over(by_day())) - 1)


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(F.round(b, 12), F.lit(0.0))


def statistics(curve: DataFrame) -> DataFrame:
    """What the conventions are made of, for each symbol: first and last equity and day, mean and deviations of the
    returns (of the population), of the falling ones, and drawdowns."""
    down = F.when(F.col("ret") < 0, F.col("ret"))
    out = with_returns(curve).groupBy("symbol").agg(
        F.min_by("equity", "day").alias("initial"), F.max_by("equity", "day").alias("final"), F.datediff(F.max("day"), F.min("day")).alias("days"), F.avg("ret").alias("mean"),
        F.when(F.count("ret") > 1, F.stddev_pop("ret")).alias("sd"), F.when(F.count(down) > 1, F.stddev_pop(down)).alias("sd_down"), F.sqrt(F.avg(F.pow(F.when(F.col("ret").isNotNull(), F.least("ret", F.lit(0.0))), F.lit(2)))).alias("rms_down"),
    )
    return out.join(drawdown_summary(curve, "equity"), "symbol").withColumn("total", F.col("final") / F.col("initial") - 1)


def curve_calendar_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual return by calendar days / 365.25; its ratios to volatility, to the falling days' and to the drawdown."""
    rows = statistics(curves(bars(spark, sf_dir)))
    years = F.greatest(F.col("days") / 365.25, F.lit(1 / 365.25))
    rows = rows.withColumn("annual", F.pow(F.col("final") / F.col("initial"), 1 / years) - 1)
    return rows.select(
        "symbol", *(r6(F.col(c) * 100).alias(f"{c}_percent") for c in ("total", "annual", "max_drawdown")), r6(F.col("sd") * YEAR**0.5 * 100).alias("volatility_percent"), r6(_over(F.col("annual"), F.col("sd") * YEAR**0.5)).alias("sharpe"),
        r6(_over(F.col("annual"), F.col("sd_down") * YEAR**0.5)).alias("sortino"), r6(_over(F.col("annual"), F.abs("max_drawdown"))).alias("calmar"), "longest_bars", "longest_days",
    )


def curve_campaign_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean return times 252; ratios of means; the downside as root mean square of min(return, 0); the excess
    over the mean of all symbols' totals."""
    rows = statistics(curves(bars(spark, sf_dir)))
    benchmark = rows.agg(F.avg("total").alias("benchmark"))
    return rows.crossJoin(F.broadcast(benchmark)).select(  # one row
        "symbol", r6("total").alias("total"), r6(F.col("total") - F.col("benchmark")).alias("excess"), r6("max_drawdown").alias("max_drawdown"), r6(_over(F.col("mean"), F.col("sd")) * YEAR**0.5).alias("sharpe"),
        r6(_over(F.col("mean"), F.col("rms_down")) * YEAR**0.5).alias("sortino"), r6(_over(F.col("mean") * YEAR, F.abs("max_drawdown"))).alias("calmar"), "longest_bars",
    )


def curve_shadow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean return times 252 over annual deviations of all and of the falling days; 0 where there is no ratio."""
    rows = statistics(curves(bars(spark, sf_dir)))
    zero = lambda c: r6(F.coalesce(c, F.lit(0.0)))
    return rows.select("symbol", r6("total").alias("ret"), r6("max_drawdown").alias("drawdown"), zero(F.col("sd") * YEAR**0.5).alias("volatility"), zero(_over(F.col("mean") * YEAR, F.col("sd") * YEAR**0.5)).alias("sharpe"), zero(_over(F.col("mean") * YEAR, F.col("sd_down") * YEAR**0.5)).alias("sortino"))


def curve_defensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downside volatility and the worst return over 252 bars of each curve; null for shorter ones."""
    rows = with_returns(curves(bars(spark, sf_dir))).withColumn("year", ratio(F.col("equity"), F.lag("equity", 252).over(by_day())) - 1)
    return rows.groupBy("symbol").agg(r6(F.sqrt(F.avg(F.pow(F.when(F.col("ret").isNotNull(), F.least("ret", F.lit(0.0))), F.lit(2)))) * YEAR**0.5).alias("downside_volatility"), r6(F.min("year")).alias("worst_year"))


def _compounded(ret: Column) -> Column:
    """The natural log of the product of 1 + return, of returns above -1: products of years leave a double's places."""
    return F.sum(F.log1p(ret))


def curve_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's months from first to last equity: how many rose, and what rising and falling ones compound to."""
    months = curves(bars(spark, sf_dir)).groupBy("symbol", F.trunc("day", "MM").alias("month")).agg((F.max_by("equity", "day") / F.min_by("equity", "day") - 1).alias("ret"))
    up = F.col("ret") > 0
    return months.groupBy("symbol").agg(F.count("*").alias("months"), F.count_if(up).alias("rising"), r6(_compounded(F.when(up, F.col("ret")).otherwise(0.0))).alias("log_won"), r6(_compounded(F.when(up, 0.0).otherwise(F.col("ret")))).alias("log_lost"))


def curve_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of five sessions of each symbol, from first to last equity."""
    rows = curves(bars(spark, sf_dir)).withColumn("slice", F.floor((F.row_number().over(by_day()) - 1) / 5))
    return rows.groupBy("symbol", "slice").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("sessions"), r6(F.max_by("equity", "day") / F.min_by("equity", "day") - 1).alias("ret"))


def curve_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each symbol's returns compound to under the labels of the market's day (mean return of the others' day,
    0 where it has none): up or down, and calm or wild; a day has a label of each."""
    rows = with_returns(curves(bars(spark, sf_dir))).where("ret is not null and ret > -1")
    market = rows.where("symbol <> 'S0'").groupBy("day").agg(F.avg("ret").alias("market"))
    met = rows.join(market, "day", "left").withColumn("market", F.round(F.coalesce("market", F.lit(0.0)), 12))
    label = F.explode(F.array(F.when(F.col("market") > 0, "up").otherwise("down"), F.when(F.abs("market") > 0.05, "wild").otherwise("calm")))
    return met.select("symbol", "ret", label.alias("label")).groupBy("symbol", "label").agg(F.count("*").alias("days"), r6(_compounded(F.col("ret"))).alias("log_ret"))


def invested(series: DataFrame) -> DataFrame:
    """series with exposure: 1 above the mean of 20 closes, else 0."""
    mean = F.avg("close").over(by_day().rowsBetween(-19, 0))
    return series.withColumn("exposure", F.when((F.row_number().over(by_day()) >= 20) & (F.round(F.col("close") - mean, 9) > 0), 1.0).otherwise(0.0))


def cash_periods(series: DataFrame) -> DataFrame:
    """symbol, first_day, last_day, sessions of each run of bars without exposure (1e-12 at most)."""
    rows = series.withColumn("run", F.sum(F.when(F.col("exposure") > 1e-12, 1).otherwise(0)).over(by_day().rowsBetween(Window.unboundedPreceding, 0))).where("exposure <= 1e-12")
    return rows.groupBy("symbol", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("sessions")).drop("run")


def curve_cash_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cash_periods(invested(bars(spark, sf_dir)))


def curve_cash_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cash period, the discontinuities of 50 % strictly inside it, and those within 5 days of its ends."""
    series = bars(spark, sf_dir)
    breaks = series.withColumn("move", F.abs(ratio(F.col("close"), F.lag("close").over(by_day())) - 1)).where("round(move, 9) >= 0.5").groupBy("symbol").agg(F.array_sort(F.collect_list("day")).alias("breaks"))
    rows = cash_periods(invested(series)).join(breaks, "symbol", "left")
    days = F.coalesce("breaks", F.array().cast("array<date>"))
    near = lambda d: (F.abs(F.datediff(d, "first_day")) <= 5) | (F.abs(F.datediff(d, "last_day")) <= 5)
    return rows.select("symbol", "first_day", F.size(F.filter(days, lambda d: (d > F.col("first_day")) & (d < F.col("last_day")))).alias("inside"), F.size(F.filter(days, near)).alias("near"))


def curve_drawdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the sum of all curves on common sessions that fall 10 % or more: peak, trough and recovery, and
    each symbol's part in the fall."""
    own = curves(common(bars(spark, sf_dir)))
    at = Window.orderBy("day")  # a row for each session
    whole = own.groupBy("day").agg(F.round(F.sum("equity"), 6).alias("equity"))
    rows = whole.withColumn("peak", F.max("equity").over(at.rowsBetween(Window.unboundedPreceding, 0))).withColumn("episode", F.sum(F.when(F.col("equity") >= F.col("peak"), 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("episode").agg(F.min("day").alias("peak_day"), F.min_by("day", F.struct("equity", "day")).alias("trough_day"), F.max("peak").alias("peak"), F.min("equity").alias("trough"))
    found = found.withColumn("recovery_day", F.lead("peak_day").over(Window.orderBy("episode"))).where(F.round(F.col("trough") / F.col("peak") - 1, 9) <= EPISODE)
    day = lambda d, c: own.select(F.col("day").alias(d), "symbol", F.col("equity").alias(c))
    parts = found.join(day("peak_day", "before"), "peak_day").join(day("trough_day", "after"), ["trough_day", "symbol"])
    return parts.select("peak_day", "trough_day", "recovery_day", r6(F.col("trough") / F.col("peak") - 1).alias("depth"), "symbol", r6((F.col("after") - F.col("before")) / F.col("peak")).alias("part"))


def curve_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All curves as one over the union of their days, each carried forward from its capital: with equal weights, and
    with equal weights for two sectors. A day's changes are summed, then all days' so far."""
    rows = curves(bars(spark, sf_dir)).withColumn("change", F.col("equity") - F.coalesce(F.lag("equity").over(by_day()), F.lit(CAPITAL)))
    symbols = rows.select("symbol", (F.substring("symbol", 2, 1).cast("int") % 2).alias("sector")).distinct()
    weights = symbols.select("symbol", (1 / F.count("*").over(Window.partitionBy(F.lit(1)))).alias("equal"), (1 / (F.lit(2) * F.count("*").over(Window.partitionBy("sector")))).alias("balanced"))  # a row for each symbol
    daily = rows.join(weights, "symbol").groupBy("day").agg(F.sum(F.col("change") * F.col("equal")).alias("equal"), F.sum(F.col("change") * F.col("balanced")).alias("balanced"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", F.round(CAPITAL + F.sum("equal").over(so_far), 4).alias("equal_weight"), F.round(CAPITAL + F.sum("balanced").over(so_far), 4).alias("sector_balanced"))


def curve_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns compounded between discontinuities of 50 % or more, which are left out."""
    rows = with_returns(curves(bars(spark, sf_dir))).withColumn("cut", F.coalesce(F.abs(F.round("ret", 9)) >= 0.5, F.lit(False)))
    rows = rows.withColumn("segment", F.sum(F.col("cut").cast("int")).over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("cut") | F.col("ret").isNull(), 0.0).otherwise(F.col("ret"))
    parts = rows.groupBy("symbol", "segment").agg(F.count("*").alias("bars"), F.sum(F.log1p(kept)).alias("log"))
    return parts.groupBy("symbol").agg(F.count("*").alias("segments"), F.max("bars").alias("longest"), r6(F.sum("log")).alias("log_ret"))


def curve_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return of wild and calm days (by the median of absolute returns) and of days after 63 rising or falling bars."""
    rows = with_returns(curves(bars(spark, sf_dir))).withColumn("trend", F.lag("close").over(by_day()) > F.lag("close", 64).over(by_day())).where("ret is not null")
    middle = rows.groupBy("symbol").agg(F.expr("percentile(round(abs(ret), 12), 0.5)").alias("middle"))
    met = rows.join(middle, "symbol")
    wild = F.round(F.abs("ret"), 12) > F.round("middle", 12)
    mean = lambda condition: r6(F.avg(F.when(condition, F.col("ret"))))
    return met.groupBy("symbol").agg(mean(wild).alias("wild"), mean(~wild).alias("calm"), mean(F.col("trend")).alias("rising"), mean(~F.col("trend")).alias("falling"))


def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to SPLITS rolling windows of each symbol's bars: half to train, a quarter each to validate and to test, moved by
    the test's length (window 50, 25, 25 bars)."""
    sizes = bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 100")
    start = F.explode(F.slice(F.sequence(F.lit(0), (F.col("n") - 100).cast("int"), F.lit(25)), 1, SPLITS))
    return sizes.select("symbol", start.alias("train_from")).select("symbol", "train_from", (F.col("train_from") + 50).alias("validate_from"), (F.col("train_from") + 75).alias("test_from"), (F.col("train_from") + 100).alias("test_to"))


def strategy_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day on which each strategy has its bars: 50 for averages, 61 for momentum, 200 for the long mean."""
    n = F.row_number().over(by_day())
    rows = bars(spark, sf_dir).withColumn("n", n)
    first = lambda k, name: F.min(F.when(F.col("n") >= k, F.col("day"))).alias(name)
    return rows.groupBy("symbol").agg(first(50, "averages"), first(61, "momentum"), first(200, "long_mean"))


def latest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar's 20/50 signal with its strength (0 to 100), a stop at 92 % and a target at 115 %."""
    mean = lambda k: F.avg("close").over(by_day().rowsBetween(1 - k, 0))
    rows = bars(spark, sf_dir).select("symbol", "day", "close", mean(20).alias("fast"), mean(50).alias("slow"), F.row_number().over(by_day()).alias("n"))
    last = rows.groupBy("symbol").agg(*(F.max_by(c, "day").alias(c) for c in ("close", "fast", "slow", "n")), F.max("day").alias("day")).where("n >= 50")
    strength = F.least(F.abs(F.col("fast") / F.col("slow") - 1) * 1000, F.lit(100.0))
    return last.select("symbol", "day", F.when(F.col("fast") > F.col("slow"), "buy").otherwise("flat").alias("signal"), F.round(strength, 5).alias("strength"), r6(F.col("close") * 0.92).alias("stop"), r6(F.col("close") * 1.15).alias("target"))


def curve_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of curves over all bars against those over common sessions alone: which differ by more than 0.05 (0
    for counts), and which side lacks the symbol."""
    figures = lambda rows: curves(rows).groupBy("symbol").agg(F.count("*").alias("bars"), (F.max_by("equity", "day") / CAPITAL - 1).alias("total"))
    series = bars(spark, sf_dir)
    a, b = figures(series), figures(common(series)).withColumnsRenamed({"bars": "bars_b", "total": "total_b"})
    met = a.join(b, "symbol", "full")
    off = codes((F.col("bars").isNull(), "missing_left"), (F.col("bars_b").isNull(), "missing_right"), (F.col("bars") != F.col("bars_b"), "bars"), (F.round(F.abs(F.col("total") - F.col("total_b")), 9) > 0.05, "total"))
    return met.select("symbol", "bars", F.col("bars_b").alias("bars_common"), off.alias("differs"), (off == "").alias("reproduced"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each curve's verdict, the first that fits: too short, deep fall, loss, weak ratio, or worth a further look; with
    all reasons against it."""
    rows = statistics(curves(bars(spark, sf_dir))).join(bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars")), "symbol")
    sharpe = _over(F.col("mean"), F.col("sd")) * YEAR**0.5
    tests = ((F.col("bars") < 252, "insufficient_history"), (F.round("max_drawdown", 9) < -0.6, "drawdown_too_deep"), (F.round("total", 9) <= 0, "no_return"), (F.coalesce(F.round(sharpe, 9) < 0.5, F.lit(True)), "weak_ratio"))
    verdict = F.lit("further_research")
    for condition, label in reversed(tests):
        verdict = F.when(condition, label).otherwise(verdict)
    return rows.select("symbol", verdict.alias("verdict"), codes(*tests).alias("reasons"))


QUERIES = {f.__name__: f for f in (curve_calendar_metrics, curve_campaign_metrics, curve_shadow_metrics, curve_defensive, curve_months, curve_weeks, curve_regimes, curve_cash_periods, curve_cash_conflicts, curve_drawdown_parts, curve_combined, curve_segments, curve_robustness, split_windows, strategy_eligibility, latest_signals, curve_tolerance, verdicts)}

_W = "(PARTITION BY symbol ORDER BY day)"
_CURVE = f"WITH {BARS_SQL}, curve AS (SELECT symbol, day, close, close / first_value(close) OVER {_W} * {CAPITAL}::DOUBLE AS equity FROM bars), rets AS (SELECT *, equity / nullif(lag(equity) OVER {_W}, 0) - 1 AS ret FROM curve)"
_STATS = f"""{_CURVE}, p AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM rets), u AS (SELECT *, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS spell FROM p),
sp AS (SELECT symbol, spell, min(equity / peak - 1) AS deepest, count(*) FILTER (equity < peak) AS n, max(day) - min(day) FILTER (equity < peak) AS days FROM u GROUP BY ALL), dd AS (SELECT symbol, min(deepest) AS max_drawdown, max(n) AS longest_bars, coalesce(max(days), 0) AS longest_days FROM sp GROUP BY symbol),
stats AS (SELECT symbol, count(*) AS bars, first(equity ORDER BY day) AS initial, last(equity ORDER BY day) AS final, max(day) - min(day) AS days, avg(ret) AS mean, CASE WHEN count(ret) > 1 THEN stddev_pop(ret) END AS sd, CASE WHEN count(*) FILTER (ret < 0) > 1 THEN stddev_pop(ret) FILTER (ret < 0) END AS sd_down, sqrt(avg(pow(least(ret, 0.0), 2)) FILTER (ret IS NOT NULL)) AS rms_down FROM rets GROUP BY symbol),
m AS (SELECT *, final / initial - 1 AS total FROM stats JOIN dd USING (symbol))"""
_O = lambda a, b: f"{a} / nullif(round({b}, 12), 0)"
_Y = "sqrt(252.0)"
_CASH = f"""WITH {BARS_SQL}, e AS (SELECT *, CASE WHEN row_number() OVER {_W} >= 20 AND round(close - avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING), 9) > 0 THEN 1.0 ELSE 0.0 END AS exposure FROM bars),
r AS (SELECT *, sum(CASE WHEN exposure > 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM e), cash AS (SELECT symbol, min(day) AS first_day, max(day) AS last_day, count(*) AS sessions FROM r WHERE exposure <= 1e-12 GROUP BY symbol, run)"""
_TESTS = (("bars < 252", "insufficient_history"), ("round(max_drawdown, 9) < -0.6", "drawdown_too_deep"), ("round(total, 9) <= 0", "no_return"), (f"coalesce(round({_O('mean', 'sd')} * {_Y}, 9) < 0.5, true)", "weak_ratio"))
ORACLE = {
    "curve_calendar_metrics": f"""{_STATS}, a AS (SELECT *, pow(final / initial, 1 / greatest(days / 365.25, 1 / 365.25)) - 1 AS annual FROM m)
      SELECT symbol, round(total * 100, 6) AS total_percent, round(annual * 100, 6) AS annual_percent, round(max_drawdown * 100, 6) AS max_drawdown_percent, round(sd * {_Y} * 100, 6) AS volatility_percent, round({_O('annual', f'sd * {_Y}')}, 6) AS sharpe, round({_O('annual', f'sd_down * {_Y}')}, 6) AS sortino, round({_O('annual', 'abs(max_drawdown)')}, 6) AS calmar, longest_bars, longest_days FROM a""",
    "curve_campaign_metrics": f"{_STATS} SELECT symbol, round(total, 6) AS total, round(total - (SELECT avg(total) FROM m), 6) AS excess, round(max_drawdown, 6) AS max_drawdown, round({_O('mean', 'sd')} * {_Y}, 6) AS sharpe, round({_O('mean', 'rms_down')} * {_Y}, 6) AS sortino, round({_O('mean * 252', 'abs(max_drawdown)')}, 6) AS calmar, longest_bars FROM m",
    "curve_shadow_metrics": f"{_STATS} SELECT symbol, round(total, 6) AS ret, round(max_drawdown, 6) AS drawdown, round(coalesce(sd * {_Y}, 0), 6) AS volatility, round(coalesce({_O('mean * 252', f'sd * {_Y}')}, 0), 6) AS sharpe, round(coalesce({_O('mean * 252', f'sd_down * {_Y}')}, 0), 6) AS sortino FROM m",
    "curve_defensive": f"{_CURVE}, y AS (SELECT *, equity / nullif(lag(equity, 252) OVER {_W}, 0) - 1 AS year FROM rets) SELECT symbol, round(sqrt(avg(pow(least(ret, 0.0), 2)) FILTER (ret IS NOT NULL)) * {_Y}, 6) AS downside_volatility, round(min(year), 6) AS worst_year FROM y GROUP BY symbol",
    "curve_months": f"{_CURVE}, m AS (SELECT symbol, date_trunc('month', day) AS month, last(equity ORDER BY day) / first(equity ORDER BY day) - 1 AS ret FROM curve GROUP BY ALL) SELECT symbol, count(*) AS months, count(*) FILTER (ret > 0) AS rising, round(sum(ln(1 + CASE WHEN ret > 0 THEN ret ELSE 0.0 END)), 6) AS log_won, round(sum(ln(1 + CASE WHEN ret > 0 THEN 0.0 ELSE ret END)), 6) AS log_lost FROM m GROUP BY symbol",
    "curve_weeks": f"{_CURVE}, s AS (SELECT *, (row_number() OVER {_W} - 1) // 5 AS slice FROM curve) SELECT symbol, slice, min(day) AS first_day, max(day) AS last_day, count(*) AS sessions, round(last(equity ORDER BY day) / first(equity ORDER BY day) - 1, 6) AS ret FROM s GROUP BY symbol, slice",
    "curve_regimes": f"""{_CURVE}, r AS (SELECT * FROM rets WHERE ret IS NOT NULL AND ret > -1), k AS (SELECT day, avg(ret) AS market FROM r WHERE symbol <> 'S0' GROUP BY day), l AS (SELECT symbol, ret, round(coalesce(market, 0), 12) AS market FROM r LEFT JOIN k USING (day)),
      x AS (SELECT symbol, ret, unnest([CASE WHEN market > 0 THEN 'up' ELSE 'down' END, CASE WHEN abs(market) > 0.05 THEN 'wild' ELSE 'calm' END]) AS label FROM l) SELECT symbol, label, count(*) AS days, round(sum(ln(1 + ret)), 6) AS log_ret FROM x GROUP BY ALL""",
    "curve_cash_periods": f"{_CASH} SELECT * FROM cash",
    "curve_cash_conflicts": f"{_CASH}, b AS (SELECT symbol, day FROM (SELECT symbol, day, abs(close / nullif(lag(close) OVER {_W}, 0) - 1) AS move FROM bars) WHERE round(move, 9) >= 0.5) SELECT c.symbol, first_day, CAST(count(*) FILTER (b.day > first_day AND b.day < last_day) AS INT) AS inside, CAST(count(*) FILTER (abs(b.day - first_day) <= 5 OR abs(b.day - last_day) <= 5) AS INT) AS near FROM cash c LEFT JOIN b ON b.symbol = c.symbol GROUP BY c.symbol, first_day, last_day",
    "curve_drawdown_parts": f"""WITH {BARS_SQL}, {CALENDAR_SQL}, own AS (SELECT symbol, day, close / first_value(close) OVER {_W} * {CAPITAL}::DOUBLE AS equity FROM common), w AS (SELECT day, round(sum(equity), 6) AS equity FROM own GROUP BY day), p AS (SELECT *, max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM w),
      e AS (SELECT *, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS episode FROM p), f AS (SELECT episode, min(day) AS peak_day, first(day ORDER BY equity, day) AS trough_day, max(peak) AS peak, min(equity) AS trough FROM e GROUP BY episode), g AS (SELECT *, lead(peak_day) OVER (ORDER BY episode) AS recovery_day FROM f)
      SELECT peak_day, trough_day, recovery_day, round(trough / peak - 1, 6) AS depth, a.symbol, round((b.equity - a.equity) / peak, 6) AS part FROM g JOIN own a ON a.day = peak_day JOIN own b ON b.day = trough_day AND b.symbol = a.symbol WHERE round(trough / peak - 1, 9) <= {EPISODE}""",
    "curve_combined": f"""{_CURVE}, c AS (SELECT symbol, day, equity - coalesce(lag(equity) OVER {_W}, {CAPITAL}) AS change FROM curve), s AS (SELECT DISTINCT symbol, CAST(substr(symbol, 2, 1) AS INT) % 2 AS sector FROM curve), k AS (SELECT symbol, 1.0::DOUBLE / count(*) OVER () AS e, 1.0::DOUBLE / (2 * count(*) OVER (PARTITION BY sector)) AS b FROM s),
      d AS (SELECT day, sum(change * e) AS e, sum(change * b) AS b FROM c JOIN k USING (symbol) GROUP BY day) SELECT day, round({CAPITAL} + sum(e) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS equal_weight, round({CAPITAL} + sum(b) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS sector_balanced FROM d""",
    "curve_segments": f"""{_CURVE}, c AS (SELECT *, coalesce(abs(round(ret, 9)) >= 0.5, false) AS cut FROM rets), g AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS segment FROM c),
      s AS (SELECT symbol, segment, count(*) AS bars, sum(ln(1 + CASE WHEN cut OR ret IS NULL THEN 0.0 ELSE ret END)) AS l FROM g GROUP BY ALL) SELECT symbol, count(*) AS segments, max(bars) AS longest, round(sum(l), 6) AS log_ret FROM s GROUP BY symbol""",
    "curve_robustness": f"""{_CURVE}, t AS (SELECT *, lag(close) OVER {_W} > lag(close, 64) OVER {_W} AS trend FROM rets), r AS (SELECT * FROM t WHERE ret IS NOT NULL), k AS (SELECT symbol, quantile_cont(round(abs(ret), 12), 0.5) AS middle FROM r GROUP BY symbol), w AS (SELECT *, round(abs(ret), 12) > round(middle, 12) AS wild FROM r JOIN k USING (symbol))
      SELECT symbol, round(avg(ret) FILTER (wild), 6) AS wild, round(avg(ret) FILTER (NOT wild), 6) AS calm, round(avg(ret) FILTER (trend), 6) AS rising, round(avg(ret) FILTER (NOT trend), 6) AS falling FROM w GROUP BY symbol""",
    "split_windows": f"WITH {BARS_SQL}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 100), s AS (SELECT symbol, unnest(range(0, n - 99, 25)[1:{SPLITS}])::INT AS train_from FROM n) SELECT symbol, train_from, train_from + 50 AS validate_from, train_from + 75 AS test_from, train_from + 100 AS test_to FROM s",
    "strategy_eligibility": f"WITH {BARS_SQL}, n AS (SELECT symbol, day, row_number() OVER {_W} AS n FROM bars) SELECT symbol, min(day) FILTER (n >= 50) AS averages, min(day) FILTER (n >= 61) AS momentum, min(day) FILTER (n >= 200) AS long_mean FROM n GROUP BY symbol",
    "latest_signals": f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, close, avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) AS fast, avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING) AS slow, row_number() OVER {_W} AS n FROM bars)
      SELECT symbol, day, CASE WHEN fast > slow THEN 'buy' ELSE 'flat' END AS signal, round(least(abs(fast / slow - 1) * 1000, 100), 5) AS strength, round(close * 0.92, 6) AS stop, round(close * 1.15, 6) AS target FROM r WHERE n >= 50 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1""",
    "curve_tolerance": f"""WITH {BARS_SQL}, {CALENDAR_SQL}, a AS (SELECT symbol, count(*) AS bars, last(close ORDER BY day) / first(close ORDER BY day) - 1 AS total FROM bars GROUP BY symbol), b AS (SELECT symbol, count(*) AS bars, last(close ORDER BY day) / first(close ORDER BY day) - 1 AS total FROM common GROUP BY symbol),
      j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.bars, b.bars AS bars_common, {codes_sql(("a.bars IS NULL", "missing_left"), ("b.bars IS NULL", "missing_right"), ("a.bars <> b.bars", "bars"), ("round(abs(a.total - b.total), 9) > 0.05", "total"))} AS differs FROM a FULL JOIN b ON a.symbol = b.symbol) SELECT *, differs = '' AS reproduced FROM j""",
    "verdicts": f"{_STATS} SELECT symbol, CASE " + " ".join(f"WHEN {c} THEN '{label}'" for c, label in _TESTS) + f" ELSE 'further_research' END AS verdict, {codes_sql(*_TESTS)} AS reasons FROM m",
}
