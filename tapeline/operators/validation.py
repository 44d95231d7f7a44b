"""Validation of a registered strategy: why folds fail, what capacity excludes, and natural against common windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, r6
from tapeline.operators.backtest import CAPITAL, FEE, SLIPPAGE, _curve_sql, _ma_sql, backtest, ma_signal, signalled
from tapeline.operators.research import FOLDS, HOLDOUT, tuned_walk_forward
from tapeline.operators.research import ORACLE as _RESEARCH_SQL
from tapeline.operators.windows import with_drawdown
from tapeline.sources.bars import BARS_SQL, bars, sessions
from tapeline.sources.scratch import written

# The part of a day's volume that a buy may take, and the registered pair of means.
CAPACITY, FAST, SLOW = 0.05, 20, 50
#: Where the common window begins; means need SLOW - 1 bars before it.
FLOOR = "1998-01-01"


def liquidity_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By symbol: entries of the registered run (a signal's first bar, traded at the next open), and those whose affordable
    quantity, from the whole capital, is above the capacity of the day."""
    rows = bars(spark, sf_dir).withColumn("desired", ma_signal(FAST, SLOW))
    was = lambda n: F.coalesce(F.lag("desired", n).over(by_day()), F.lit(False))
    rows = rows.withColumn("entry", was(1) & ~was(2))
    affordable = F.floor(CAPITAL / (F.col("open") * (1 + SLIPPAGE) * (1 + FEE)))
    capacity = F.floor(F.round(F.col("volume") * CAPACITY, 6))
    return rows.groupBy("symbol").agg(F.count_if("entry").alias("entries"), F.count_if(F.col("entry") & (capacity < affordable)).alias("excluded"), F.sum(capacity).alias("capacity"))


def walk_forward_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuned walk-forward's folds and holdout: the chosen run's return against holding the symbol over the same bars, why
    the fold fails or not, and the symbol that gained most in it."""
    series = bars(spark, sf_dir)
    own = Window.partitionBy("symbol")
    at = series.select("symbol", "close", F.row_number().over(own.orderBy("day")).alias("i"), F.count("*").over(own).alias("n"))
    edges = F.array(*(F.struct(F.lit(k).alias("fold"), F.floor(F.col("n") * F.lit(a)).alias("low"), F.floor(F.col("n") * F.lit(b)).alias("high")) for k, (a, b) in enumerate((*FOLDS, (HOLDOUT, 1.0)))))
    of = lambda c: F.max(F.when(F.col("i") == F.col(c), F.col("close")))
    held = at.select("*", F.inline(edges)).where("i = low OR i = high").groupBy("symbol", "fold").agg(F.round(of("high") / of("low") - 1, 9).alias("held"))
    rows = tuned_walk_forward(spark, sf_dir).join(held, ["symbol", "fold"])
    ret, stage = F.col("ret"), F.when(F.col("fold") == 3, "final_holdout").otherwise("validation")
    reason = (
        F.when(F.col("fold") == 3, F.when(ret < 0, "negative_holdout").otherwise("positive_holdout")).when((ret < 0) & (F.col("held") >= 0), "failed_to_capture_positive_market").when(ret < 0, "negative_in_nonpositive_market")
        .when(ret < F.col("held"), "positive_but_lagged_benchmark").otherwise("positive_and_outperformed_benchmark")
    )
    best = F.first("symbol").over(Window.partitionBy("fold").orderBy(F.desc("ret"), "symbol"))
    return rows.select("symbol", "fold", stage.alias("stage"), "run", "ret", r6("held").alias("held"), reason.alias("reason"), best.alias("dominant"))


def window_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-weight portfolio of the registered run on common sessions from FLOOR on, once with each symbol's whole
    history before it and once with the bars that its means need alone: growth, deepest drawdown, sessions, and how far
    the two ends are apart. Both are one fold."""
    series = written(bars(spark, sf_dir), "window-bars")
    days = sessions(series).where(F.col("day") >= F.lit(FLOOR).cast("date"))
    i = F.row_number().over(by_day())
    first = F.min(F.when(F.col("day") >= F.lit(FLOOR).cast("date"), F.col("i"))).over(Window.partitionBy("symbol"))
    rows = series.withColumn("i", i).withColumn("first", first)
    runs = F.array_compact(F.array(F.lit("natural"), F.when(F.col("i") > F.col("first") - SLOW, F.lit("common"))))
    each = rows.select(F.explode(runs).alias("window"), "*").withColumn("symbol", F.concat_ws("|", "window", "symbol"))
    curve = backtest(signalled(each, {"ma": ma_signal(FAST, SLOW)})).join(days, "day", "left_semi")
    mean = curve.groupBy(F.split("symbol", r"\|")[0].alias("window"), "day").agg(F.avg("equity").alias("equity")).withColumn("symbol", F.lit("all")).withColumnRenamed("window", "run")
    deep = with_drawdown(mean, "equity", ("run", "symbol")).groupBy("run").agg(F.count("*").alias("sessions"), F.min("drawdown").alias("drawdown"), F.min_by("equity", "day").alias("begin"), F.max_by("equity", "day").alias("end"))
    every = Window.partitionBy(F.lit(1))  # two rows
    end = lambda run: F.max(F.when(F.col("run") == run, F.col("end") / F.col("begin"))).over(every)
    return deep.select(F.col("run").alias("window"), "sessions", r6(F.col("end") / F.col("begin") - 1).alias("growth"), r6("drawdown").alias("drawdown"), r6(end("common") - end("natural")).alias("apart"))


QUERIES = {f.__name__: f for f in (liquidity_exclusions, walk_forward_failures, window_comparison)}

_CUT = BARS_SQL.replace("bars AS (", "every AS (") + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM every), floors AS (SELECT symbol, min(i) AS first FROM placed WHERE day >= DATE '{FLOOR}' GROUP BY symbol),
bars AS (SELECT 'natural|' || symbol AS symbol, * EXCLUDE (symbol, i) FROM placed UNION ALL SELECT 'common|' || symbol, * EXCLUDE (symbol, i, first) FROM placed JOIN floors USING (symbol) WHERE i > first - {SLOW})"""
_EDGES = ", ".join(f"{{'fold': {k}, 'low': floor(n * {a}::DOUBLE), 'high': floor(n * {b}::DOUBLE)}}" for k, (a, b) in enumerate((*FOLDS, (HOLDOUT, 1.0))))
ORACLE = {
    "liquidity_exclusions": f"""WITH {BARS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM bars), d AS (SELECT *, coalesce({_ma_sql(FAST, SLOW)}, false) AS desired FROM r), w AS (SELECT *, coalesce(lag(desired) OVER (PARTITION BY symbol ORDER BY day), false) AND NOT coalesce(lag(desired, 2) OVER (PARTITION BY symbol ORDER BY day), false) AS entry, floor(round(volume * {CAPACITY}::DOUBLE, 6)) AS capacity FROM d)
      SELECT symbol, count(*) FILTER (entry) AS entries, count(*) FILTER (entry AND capacity < floor({CAPITAL}::DOUBLE / (open * (1 + {SLIPPAGE}::DOUBLE) * (1 + {FEE}::DOUBLE)))) AS excluded, CAST(sum(capacity) AS BIGINT) AS capacity FROM w GROUP BY symbol""",
    "walk_forward_failures": f"""WITH t AS ({_RESEARCH_SQL["tuned_walk_forward"]}), b AS (WITH {BARS_SQL} SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), e AS (SELECT *, unnest([{_EDGES}]) AS x FROM b),
      h AS (SELECT symbol, x.fold AS fold, round(max(close) FILTER (i = x.high) / max(close) FILTER (i = x.low) - 1, 9) AS held FROM e GROUP BY ALL)
      SELECT symbol, fold, CASE WHEN fold = 3 THEN 'final_holdout' ELSE 'validation' END AS stage, run, ret, round(held, 6) AS held, CASE WHEN fold = 3 AND ret < 0 THEN 'negative_holdout' WHEN fold = 3 THEN 'positive_holdout' WHEN ret < 0 AND held >= 0 THEN 'failed_to_capture_positive_market' WHEN ret < 0 THEN 'negative_in_nonpositive_market'
        WHEN ret < held THEN 'positive_but_lagged_benchmark' ELSE 'positive_and_outperformed_benchmark' END AS reason, first(symbol) OVER (PARTITION BY fold ORDER BY ret DESC, symbol) AS dominant FROM t JOIN h USING (symbol, fold)""",
    "window_comparison": f"""{_curve_sql({"ma": _ma_sql(FAST, SLOW)}).replace(BARS_SQL, _CUT)}, c AS (SELECT split_part(symbol, '|', 1) AS w, day, avg(equity) AS equity FROM curve WHERE day >= DATE '{FLOOR}' AND day IN (SELECT day FROM every GROUP BY day HAVING count(*) = (SELECT count(DISTINCT symbol) FROM every)) GROUP BY ALL),
      d AS (SELECT *, equity / max(equity) OVER (PARTITION BY w ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS down FROM c), s AS (SELECT w, count(*) AS sessions, min(down) AS drawdown, last(equity ORDER BY day) / first(equity ORDER BY day) AS g FROM d GROUP BY w)
      SELECT w AS "window", sessions, round(g - 1, 6) AS growth, round(drawdown, 6) AS drawdown, round(max(g) FILTER (w = 'common') OVER () - max(g) FILTER (w = 'natural') OVER (), 6) AS apart FROM s""",
}
