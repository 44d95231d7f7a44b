"""Research over backtests: a parameter grid with ranks and choices, tuned walk-forward with an untouched holdout,
leave-one-out, failures of closed trades, static benchmarks, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, r6
from tapeline.operators.backtest import CAPITAL, _curve_sql, _ma_sql, backtest, hold_signal, ma_signal, signalled
from tapeline.sources.bars import BARS_SQL, CALENDAR_SQL, bars, common
from tapeline.sources.scratch import written

# The grid, the registered pair, and the folds: ends of training and validation as shares of all bars (half, 70 %
# and 85 % of what is before the holdout), and where the holdout begins.
GRID = tuple((a, b) for a in (10, 20, 30) for b in (50, 100, 150))
REGISTERED, FOLDS, HOLDOUT = "ma_20_50", ((0.4, 0.56), (0.56, 0.68), (0.68, 0.8)), 0.8
LATE, GAP, SHORT = 0.1, -0.03, 5


def grid_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, symbol, day, equity and ret of all nine runs, in one fold; fast and slow as columns."""
    curve = backtest(signalled(bars(spark, sf_dir), {f"ma_{a}_{b}": ma_signal(a, b) for a, b in GRID}))
    window = Window.partitionBy("run", "symbol").orderBy("day")
    part = lambda k: F.split("run", "_")[k].cast("int")
    return curve.select("run", part(1).alias("fast"), part(2).alias("slow"), "symbol", "day", "equity", (F.col("equity") / F.lag("equity").over(window) - 1).alias("ret"), F.row_number().over(window).alias("i"), F.count("*").over(Window.partitionBy("run", "symbol")).alias("n"))


def sharpe(ret: Column) -> Column:
    """Mean over deviation times the root of 252, on nine places; -999 where there is none."""
    return F.coalesce(F.round(F.avg(ret) / F.nullif(F.round(F.stddev_pop(ret), 12), F.lit(0.0)) * 252**0.5, 9), F.lit(-999.0))


def _best(*value: str) -> Column:
    """The run of greatest value, then of the shorter means."""
    return F.max_by("run", F.struct(*value, -F.col("fast"), -F.col("slow")))


def grid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's total return and Sharpe ratio, its rank and the share of the symbol's runs that are no better."""
    rows = grid_curves(spark, sf_dir).groupBy("symbol", "run").agg(F.round(F.max_by("equity", "day") / CAPITAL - 1, 9).alias("total"), sharpe(F.col("ret")).alias("sharpe"))
    by = Window.partitionBy("symbol")
    return rows.select("symbol", "run", r6("total").alias("total"), r6("sharpe").alias("sharpe"), F.rank().over(by.orderBy(F.desc("total"))).alias("place"), F.round(F.cume_dist().over(by.orderBy("total")), 6).alias("share"))


def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's best run by Sharpe ratio, the median total of its grid, and how the registered run stands to it."""
    rows = grid_curves(spark, sf_dir).groupBy("symbol", "run", "fast", "slow").agg(F.round(F.max_by("equity", "day") / CAPITAL - 1, 9).alias("total"), sharpe(F.col("ret")).alias("sharpe"))
    own = F.max(F.when(F.col("run") == REGISTERED, F.col("total")))
    return rows.groupBy("symbol").agg(_best("sharpe").alias("best"), r6(F.median("total")).alias("median_total"), r6(own - F.median("total")).alias("registered_over_median"))


def tuned_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol and fold the run of best Sharpe ratio on the bars up to the end of training, and what it returned on the
    validation bars, from its own equity there; the run of best mean validation return on the holdout as fold 3."""
    rows = grid_curves(spark, sf_dir)
    parts = F.array(*(F.struct(F.lit(k).alias("fold"), F.floor(F.col("n") * F.lit(a)).alias("trained"), F.floor(F.col("n") * F.lit(b)).alias("tested")) for k, (a, b) in enumerate((*FOLDS, (HOLDOUT, 1.0)))))
    each = rows.select("*", F.inline(parts)).where(F.col("i") <= F.col("tested"))
    at = lambda edge: F.max(F.when(F.col("i") == F.col(edge), F.col("equity")))
    made = each.groupBy("symbol", "run", "fast", "slow", "fold").agg(sharpe(F.when(F.col("i") <= F.col("trained"), F.col("ret"))).alias("sharpe"), F.round(at("tested") / at("trained") - 1, 9).alias("ret"))
    folds = written(made, "walk-forward")  # nine runs and four folds a symbol, from one pass over the curves
    every, last = folds.where("fold < 3"), folds.where("fold = 3")
    chosen = every.groupBy("symbol", "fold").agg(_best("sharpe").alias("run"), F.max_by("ret", F.struct("sharpe", -F.col("fast"), -F.col("slow"))).alias("ret"))
    means = every.groupBy("symbol", "run", "fast", "slow").agg(F.round(F.avg("ret"), 9).alias("mean"))
    final = means.groupBy("symbol").agg(_best("mean").alias("run")).join(last.select("symbol", "run", "fold", "ret"), ["symbol", "run"])
    return chosen.unionByName(final).select("symbol", "fold", "run", r6("ret").alias("ret"))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean total return of the registered run without each symbol, what that changes, and the symbol's share of all
    gains; the best and the worst symbol by total, ties by name."""
    rows = backtest(signalled(bars(spark, sf_dir), {REGISTERED: ma_signal(20, 50)})).groupBy("symbol").agg(F.round(F.max_by("equity", "day") / CAPITAL - 1, 9).alias("total"))
    every = Window.partitionBy(F.lit(1))  # a row for each symbol
    n, whole = F.count("*").over(every), F.sum("total").over(every)
    gains = F.sum(F.greatest("total", F.lit(0.0))).over(every)
    return rows.select(
        "symbol", r6((whole - F.col("total")) / (n - 1)).alias("mean_without"), r6((whole - F.col("total")) / (n - 1) - whole / n).alias("change"), r6(F.greatest("total", F.lit(0.0)) / F.nullif(gains, F.lit(0.0))).alias("share_of_gains"),
        (F.row_number().over(every.orderBy(F.desc("total"), "symbol")) == 1).alias("best"), (F.row_number().over(every.orderBy("total", "symbol")) == 1).alias("worst"),
    )


def trade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades of the registered run with what went wrong: labels that may be several, and the highest close while
    held. Buys pair with sells in turn, so a trade's bars share the number of buys so far."""
    curve = backtest(signalled(bars(spark, sf_dir), {REGISTERED: ma_signal(20, 50)}))
    rows = curve.select("symbol", "day", "close", "side", "fill", "traded", "fee", F.lag("close", 20).over(by_day()).alias("before"), F.lag("close").over(by_day()).alias("last"), F.sum(F.when(F.col("side") == "buy", 1).otherwise(0)).over(by_day().rowsBetween(Window.unboundedPreceding, 0)).alias("k"))
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    sold = F.max(F.when(F.col("side") == "sell", F.col("day"))).over(Window.partitionBy("symbol", "k"))
    held = rows.where("k > 0").withColumn("sold", sold).where("day <= sold")
    trades = held.groupBy("symbol", "k").agg(
        at("buy", "day").alias("entry"), F.max("sold").alias("exit"), F.count("*").alias("bars"), F.max("close").alias("peak"), at("buy", "fill").alias("price"), at("buy", "before").alias("before"), at("sell", "last").alias("last"), at("sell", "fill").alias("exit_price"),
        (F.sum(F.when(F.col("side") == "sell", F.col("fill") * F.col("traded") - F.col("fee")).when(F.col("side") == "buy", -(F.col("fill") * F.col("traded") + F.col("fee"))).otherwise(0.0))).alias("profit"),
    )
    move = lambda a, b: F.round(F.col(a) / F.col(b) - 1, 9)
    labels = F.array_compact(F.array(F.when(F.coalesce(move("price", "before") > LATE, F.lit(False)), "late_entry"), F.when(F.coalesce(move("exit_price", "last") < GAP, F.lit(False)), "gap_loss"), F.when(F.col("bars") <= SHORT, "short_hold"), F.when(move("peak", "price") > LATE, "gave_back_gain")))
    return trades.withColumn("labels", F.when(F.col("profit") < 0, labels).otherwise(F.array().cast("array<string>")))


def trade_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many losing trades have each label, and what they lost; labels are not exclusive."""
    rows = trade_records(spark, sf_dir).select("symbol", "profit", F.explode(F.when(F.size("labels") == 0, F.array(F.when(F.col("profit") < 0, "other").otherwise("gain"))).otherwise(F.col("labels"))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("trades"), F.round(F.sum("profit"), 3).alias("profit"), F.count_distinct("symbol").alias("symbols"))


def dominant_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's most frequent label of losing trades, ties by name, with the pooled trade statistics."""
    rows = written(trade_records(spark, sf_dir), "trade-records")
    counts = rows.select("symbol", F.explode("labels").alias("label")).groupBy("symbol", "label").count()
    first = counts.groupBy("symbol").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label"), F.max("count").alias("times"))
    sums = rows.groupBy("symbol").agg(F.count("*").alias("trades"), F.count_if(F.col("profit") < 0).alias("losing"), r6(F.avg("bars")).alias("mean_bars"), r6(F.max(F.col("peak") / F.col("price") - 1)).alias("best_peak"))
    return sums.join(first, "symbol", "left")


def static_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final values of four benchmarks on common sessions from CAPITAL: bought and held in equal parts, half of it in cash,
    and weights restored each month and each quarter (without costs)."""
    series = written(common(bars(spark, sf_dir)), "benchmark-bars")
    rows = series.withColumn("month", F.trunc("day", "MM")).withColumn("quarter", F.trunc("day", "quarter"))

    def restored(period: str) -> DataFrame:
        """Each period's closes over the last close of the period before (its first close in the first period), averaged."""
        last = rows.groupBy("symbol", period).agg(F.max_by("close", "day").alias("close"), F.min_by("close", "day").alias("first"))
        before = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy(period)), F.col("first"))
        growth = last.withColumn("growth", F.col("close") / before).groupBy(period).agg(F.avg("growth").alias("growth"))
        return growth.agg(F.sum(F.log("growth")).alias("log"))

    held = series.groupBy("symbol").agg((F.max_by("close", "day") / F.min_by("close", "day")).alias("growth")).agg(F.log(F.avg("growth")).alias("log"), F.log(0.5 + 0.5 * F.avg("growth")).alias("half"))
    row = lambda frame, name, c="log": frame.select(F.lit(name).alias("benchmark"), r6(c).alias("log_growth"))
    return row(held, "held").unionByName(row(held, "half_cash", "half")).unionByName(row(restored("month"), "monthly")).unionByName(row(restored("quarter"), "quarterly"))


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final equity and mean exposure of holding with a half and with all of the capital: the rest stays in cash."""
    series = signalled(bars(spark, sf_dir), {"hold": hold_signal()})
    parts = [backtest(series, capital=CAPITAL * share).groupBy("symbol").agg(F.lit(share).alias("allocation"), r6(F.max_by("equity", "day") + CAPITAL * (1 - share)).alias("final_equity"), r6(F.avg((F.col("quantity") > 0).cast("double"))).alias("exposure")) for share in (0.5, 1.0)]
    return parts[0].unionByName(parts[1])


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the symbols as CSV, markdown and canonical JSON lines, with the digest of each line."""
    rows = bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").cast("string").alias("bars"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.sum("volume").cast("string").alias("volume"))
    columns = rows.columns
    text = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{c}":"'), F.col(c), F.lit('"')) for c in sorted(columns))), F.lit("}"))
    return rows.select("symbol", F.concat_ws(",", *columns).alias("csv"), F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("markdown"), text.alias("json"), F.sha2(text, 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (grid_ranks, grid_choice, tuned_walk_forward, leave_one_out, trade_failures, dominant_failures, static_benchmarks, allocations, report_rows)}

_RUNS = {f"ma_{a}_{b}": _ma_sql(a, b) for a, b in GRID}
_SHARPE = lambda r: f"coalesce(round(avg({r}) / nullif(round(stddev_pop({r}), 12), 0) * sqrt(252.0), 9), -999)"
_ROWS = f"""{_curve_sql(_RUNS)}, g AS (SELECT run, CAST(split_part(run, '_', 2) AS INT) AS fast, CAST(split_part(run, '_', 3) AS INT) AS slow, symbol, day, equity, equity / lag(equity) OVER (PARTITION BY run, symbol ORDER BY day) - 1 AS ret, row_number() OVER (PARTITION BY run, symbol ORDER BY day) AS i, count(*) OVER (PARTITION BY run, symbol) AS n FROM curve)"""
_GRID = f"{_ROWS}, m AS (SELECT symbol, run, fast, slow, round(last(equity ORDER BY day) / {CAPITAL} - 1, 9) AS total, {_SHARPE('ret')} AS sharpe FROM g GROUP BY ALL)"
_FOLD = lambda k, a, b: f"SELECT symbol, run, fast, slow, {k} AS fold, {_SHARPE(f'CASE WHEN i <= floor(n * {a}::DOUBLE) THEN ret END')} AS sharpe, round(max(equity) FILTER (i = floor(n * {b}::DOUBLE)) / max(equity) FILTER (i = floor(n * {a}::DOUBLE)) - 1, 9) AS ret FROM g GROUP BY ALL"
_ONE = _curve_sql({REGISTERED: _ma_sql(20, 50)})
_TRADES = f"""{_ONE}, b AS (SELECT c.*, r.close, lag(r.close, 20) OVER (PARTITION BY c.symbol ORDER BY c.day) AS before, lag(r.close) OVER (PARTITION BY c.symbol ORDER BY c.day) AS prior, sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) OVER (PARTITION BY c.symbol ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS k FROM curve c JOIN bars r ON r.symbol = c.symbol AND r.day = c.day),
h AS (SELECT *, max(CASE WHEN side = 'sell' THEN day END) OVER (PARTITION BY symbol, k) AS sold FROM b WHERE k > 0), t AS (SELECT symbol, k, count(*) AS bars, max(close) AS peak, max(fill) FILTER (side = 'buy') AS price, max(before) FILTER (side = 'buy') AS before, max(prior) FILTER (side = 'sell') AS prior, max(fill) FILTER (side = 'sell') AS exit_price,
  sum(CASE side WHEN 'sell' THEN fill * traded - fee WHEN 'buy' THEN -(fill * traded + fee) ELSE 0.0 END) AS profit FROM h WHERE day <= sold GROUP BY symbol, k),
l AS (SELECT *, CASE WHEN profit < 0 THEN list_filter([CASE WHEN round(price / before - 1, 9) > {LATE} THEN 'late_entry' END, CASE WHEN round(exit_price / prior - 1, 9) < {GAP} THEN 'gap_loss' END, CASE WHEN bars <= {SHORT} THEN 'short_hold' END, CASE WHEN round(peak / price - 1, 9) > {LATE} THEN 'gave_back_gain' END], lambda x: x IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END AS labels FROM t)"""
_PERIOD = lambda p: f"(WITH c AS (SELECT symbol, date_trunc('{p}', day) AS p, last(close ORDER BY day) AS close, first(close ORDER BY day) AS f FROM common GROUP BY ALL), g AS (SELECT p, close / coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY p), f) AS growth FROM c), a AS (SELECT p, avg(growth) AS growth FROM g GROUP BY p) SELECT sum(ln(growth)) FROM a)"
_HELD = lambda share: _curve_sql({"hold": "true"}).replace(f"{CAPITAL}::DOUBLE AS cash", f"{CAPITAL * share}::DOUBLE AS cash")
ORACLE = {
    "grid_ranks": f"{_GRID} SELECT symbol, run, round(total, 6) AS total, round(sharpe, 6) AS sharpe, CAST(rank() OVER (PARTITION BY symbol ORDER BY total DESC) AS INT) AS place, round(cume_dist() OVER (PARTITION BY symbol ORDER BY total), 6) AS share FROM m",
    "grid_choice": f"{_GRID} SELECT symbol, first(run ORDER BY sharpe DESC, fast, slow) AS best, round(median(total), 6) AS median_total, round(max(total) FILTER (run = '{REGISTERED}') - median(total), 6) AS registered_over_median FROM m GROUP BY symbol",
    "tuned_walk_forward": f"""{_ROWS}, f AS ({" UNION ALL ".join(_FOLD(k, a, b) for k, (a, b) in enumerate(FOLDS))}), hold AS ({_FOLD(3, HOLDOUT, 1.0)}), c AS (SELECT symbol, fold, first(run ORDER BY sharpe DESC, fast, slow) AS run, first(ret ORDER BY sharpe DESC, fast, slow) AS ret FROM f GROUP BY symbol, fold),
      v AS (SELECT symbol, run, fast, slow, round(avg(ret), 9) AS mean FROM f GROUP BY ALL), w AS (SELECT symbol, first(run ORDER BY mean DESC, fast, slow) AS run FROM v GROUP BY symbol)
      SELECT symbol, fold, run, round(ret, 6) AS ret FROM c UNION ALL SELECT symbol, fold, run, round(ret, 6) FROM w JOIN hold USING (symbol, run)""",
    "leave_one_out": f"""{_ONE}, m AS (SELECT symbol, round(last(equity ORDER BY day) / {CAPITAL} - 1, 9) AS total FROM curve GROUP BY symbol) SELECT symbol, round((sum(total) OVER () - total) / (count(*) OVER () - 1), 6) AS mean_without, round((sum(total) OVER () - total) / (count(*) OVER () - 1) - sum(total) OVER () / count(*) OVER (), 6) AS change,
      round(greatest(total, 0.0) / nullif(sum(greatest(total, 0.0)) OVER (), 0), 6) AS share_of_gains, row_number() OVER (ORDER BY total DESC, symbol) = 1 AS best, row_number() OVER (ORDER BY total, symbol) = 1 AS worst FROM m""",
    "trade_failures": f"{_TRADES}, u AS (SELECT symbol, profit, unnest(CASE WHEN len(labels) = 0 THEN [CASE WHEN profit < 0 THEN 'other' ELSE 'gain' END] ELSE labels END) AS label FROM l) SELECT label, count(*) AS trades, round(sum(profit), 3) AS profit, count(DISTINCT symbol) AS symbols FROM u GROUP BY label",
    "dominant_failures": f"{_TRADES}, u AS (SELECT symbol, label, count(*) AS n FROM (SELECT symbol, unnest(labels) AS label FROM l) GROUP BY ALL), f AS (SELECT symbol, first(label ORDER BY n DESC, label) AS label, max(n) AS times FROM u GROUP BY symbol), s AS (SELECT symbol, count(*) AS trades, count(*) FILTER (profit < 0) AS losing, round(avg(bars), 6) AS mean_bars, round(max(peak / price - 1), 6) AS best_peak FROM l GROUP BY symbol) SELECT * FROM s LEFT JOIN f USING (symbol)",
    "static_benchmarks": f"WITH {BARS_SQL}, {CALENDAR_SQL}, h AS (SELECT symbol, last(close ORDER BY day) / first(close ORDER BY day) AS growth FROM common GROUP BY symbol) SELECT 'held' AS benchmark, round(ln(avg(growth)), 6) AS log_growth FROM h UNION ALL SELECT 'half_cash', round(ln(0.5 + 0.5 * avg(growth)), 6) FROM h UNION ALL SELECT 'monthly', round({_PERIOD('month')}, 6) UNION ALL SELECT 'quarterly', round({_PERIOD('quarter')}, 6)",
    "allocations": " UNION ALL ".join(f"SELECT * FROM ({_HELD(x)} SELECT symbol, {x}::DOUBLE AS allocation, round(last(equity ORDER BY day) + {CAPITAL * (1 - x)}, 6) AS final_equity, round(avg(CAST(coalesce(held, 0) > 0 AS DOUBLE)), 6) AS exposure FROM (SELECT c.*, (SELECT quantity FROM steps s WHERE s.run = c.run AND s.symbol = c.symbol AND s.rn = c.rn) AS held FROM curve c) GROUP BY symbol)" for x in (0.5, 1.0)),
    "report_rows": f"""WITH {BARS_SQL}, r AS (SELECT symbol, CAST(count(*) AS VARCHAR) AS bars, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, CAST(sum(volume) AS VARCHAR) AS volume FROM bars GROUP BY symbol), j AS (SELECT *, '{{"bars":"' || bars || '","first_day":"' || first_day || '","last_day":"' || last_day || '","symbol":"' || symbol || '","volume":"' || volume || '"}}' AS json FROM r)
      SELECT symbol, concat_ws(',', symbol, bars, first_day, last_day, volume) AS csv, '| ' || concat_ws(' | ', symbol, bars, first_day, last_day, volume) || ' |' AS markdown, json, sha256(json) AS sha256 FROM j""",
}
