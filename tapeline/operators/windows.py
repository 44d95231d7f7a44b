"""Sequence operators over bars: returns, trailing statistics, drawdowns, islands, regimes, gaps and calendars."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, r6, ratio, returns
from tapeline.functions.folds import fold
from tapeline.sources.bars import BARS_SQL, CALENDAR_SQL, bars, common, sessions

WITH = f"WITH {BARS_SQL}, {CALENDAR_SQL}"
W_SQL = "(PARTITION BY symbol ORDER BY day)"


def back(n: int, to: int = 0):
    return by_day().rowsBetween(-n, to)


def with_drawdown(curve: DataFrame, value: str = "close", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """curve with peak (running maximum), drawdown (0 or below), and spell: rows under water share a number."""
    window = Window.partitionBy(*keys).orderBy("day")
    peak = F.max(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
    out = curve.withColumn("peak", peak).withColumn("drawdown", F.col(value) / F.col("peak") - 1)
    return out.withColumn("spell", F.sum(F.when(F.col(value) >= F.col("peak"), 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def drawdown_summary(curve: DataFrame, value: str = "close", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, max_drawdown, longest_bars and longest_days of the spells under water."""
    rows = with_drawdown(curve, value, keys)
    spells = rows.groupBy(*keys, "spell").agg(
        F.min("drawdown").alias("deepest"), F.sum(F.when(F.col("drawdown") < 0, 1).otherwise(0)).alias("bars"), F.datediff(F.max("day"), F.min(F.when(F.col("drawdown") < 0, F.col("day")))).alias("days"),
    )
    return spells.groupBy(*keys).agg(F.min("deepest").alias("max_drawdown"), F.max("bars").alias("longest_bars"), F.coalesce(F.max("days"), F.lit(0)).alias("longest_days"))


def win_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "day", r6(returns("close")).alias("ret"))


def win_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages with a full window, the highest close and mean volume before the bar, and momentum."""
    n = F.row_number().over(by_day())
    return bars(spark, sf_dir).select(
        "symbol", "day",
        r6(F.when(n >= 20, F.avg("close").over(back(19)))).alias("sma20"), r6(F.when(n >= 50, F.avg("close").over(back(49)))).alias("sma50"), r6(F.when(n > 20, F.max("close").over(back(20, -1)))).alias("high20"),
        r6(F.when(n > 20, F.avg("volume").over(back(20, -1)))).alias("volume20"), r6(returns_over(60)).alias("momentum60"), (F.col("close") > F.when(n >= 200, F.avg("close").over(back(199)))).alias("above200"),
    )


def returns_over(n: int):
    return ratio(F.col("close"), F.lag("close", n).over(by_day())) - 1


def win_realized_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annualised volatility of exactly 60 returns on the common calendar."""
    rows = common(bars(spark, sf_dir)).withColumn("ret", returns("close"))
    return rows.select("symbol", "day", r6(F.when(F.count("ret").over(back(59)) == 60, F.stddev_pop("ret").over(back(59)) * F.sqrt(F.lit(252.0)))).alias("volatility60"))


def win_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawdown_summary(bars(spark, sf_dir)).select("symbol", r6("max_drawdown").alias("max_drawdown"), "longest_bars", "longest_days")


def win_drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells under water of 10 % or deeper: peak, first and last day, trough day and depth."""
    rows = with_drawdown(bars(spark, sf_dir)).where("drawdown < 0")
    spells = rows.groupBy("symbol", "spell").agg(F.max("peak").alias("peak"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min(F.struct("drawdown", "day")).alias("low"), F.count("*").alias("bars"))
    return spells.where("low.drawdown <= -0.1").select("symbol", r6("peak").alias("peak"), "first_day", "last_day", F.col("low.day").alias("trough_day"), r6("low.drawdown").alias("depth"), "bars")


def market_index(series: DataFrame) -> DataFrame:
    """day, level: the mean of close over first close, once all symbols have been seen; last closes carry forward."""
    first = F.min(F.struct("day", "close")).over(Window.partitionBy("symbol")).getField("close")
    relative = F.col("close") / first
    changes = series.withColumn("relative", relative).select("symbol", "day", F.col("relative"), F.lag("relative").over(by_day()).alias("was"))
    daily = changes.groupBy("day").agg(F.sum(F.col("relative") - F.coalesce("was", F.lit(0.0))).alias("change"), F.count_if(F.col("was").isNull()).alias("new"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    symbols = series.agg(F.count_distinct("symbol"))
    return daily.select("day", F.sum("change").over(so_far).alias("total"), F.sum("new").over(so_far).alias("seen")).where(F.col("seen") == symbols.scalar()).select("day", (F.col("total") / F.col("seen")).alias("level"))


def win_market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_index(bars(spark, sf_dir)).select("day", r6("level").alias("level"))


def _median_before(state: list, day, value: float) -> tuple:
    """The median of the values before this one, by two heaps: the lower half negated, and the upper half."""
    low, high = state
    median = None if not low else (-low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
    if value is not None and value == value:
        heapq.heappush(high, -heapq.heappushpop(low, -value))
        if len(high) > len(low):
            heapq.heappush(low, -heapq.heappop(high))
    return day, median


def win_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend and volatility labels of each symbol's bar from what came strictly before it."""
    rows = bars(spark, sf_dir).withColumn("ret", returns("close"))
    rows = rows.withColumn("vol20", F.when(F.count("ret").over(back(20, -1)) == 20, F.stddev_pop("ret").over(back(20, -1))))
    usual = fold(rows, ["symbol"], ["day"], ["day", "vol20"], lambda: [[], []], _median_before, "day date, usual double")
    rows = rows.join(usual, ["symbol", "day"]).withColumn("mean200", F.when(F.count("close").over(back(200, -1)) == 200, F.avg("close").over(back(200, -1))))
    before = F.lag("close").over(by_day())
    trend = F.when(F.col("mean200").isNull(), "unknown").when(before > F.col("mean200"), "up").otherwise("down")
    calm = F.when(F.col("vol20").isNull() | F.col("usual").isNull(), "unknown").when(F.round("vol20", 9) > F.round("usual", 9), "high").otherwise("low")
    labelled = rows.select("symbol", trend.alias("trend"), calm.alias("volatility"), "ret")
    return labelled.groupBy("symbol", "trend", "volatility").agg(F.count("*").alias("bars"), r6(F.avg("ret")).alias("mean_return"))


def win_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of falling closes of each symbol, and how many runs there are."""
    rows = bars(spark, sf_dir).withColumn("down", F.coalesce(F.col("close") < F.lag("close").over(by_day()), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("down"), 0).otherwise(1)).over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    sizes = rows.groupBy("symbol", "run").agg(F.sum(F.col("down").cast("int")).alias("size"))
    return sizes.groupBy("symbol").agg(F.max("size").alias("longest"), F.count_if(F.col("size") > 0).alias("runs"))


def win_discontinuities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes that move by 20 % or more, and by more than 50 %."""
    rows = bars(spark, sf_dir).withColumn("change", returns("close")).withColumn("gap_days", F.datediff("day", F.lag("day").over(by_day())))
    return rows.where(F.abs("change") >= 0.2).select("symbol", "day", r6("change").alias("change"), (F.abs("change") > 0.5).alias("outlier"), "gap_days")


def win_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "day", F.lag("day").over(by_day()).alias("before"), F.lead("day").over(by_day()).alias("after"), r6(F.lead("open").over(by_day())).alias("next_open"))


def win_period_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last common session of each month, whether it ends its quarter, and the session after it."""
    days = sessions(bars(spark, sf_dir)).withColumn("next_session", F.lead("day").over(Window.orderBy("day")))  # a row for each session
    ends = days.groupBy(F.trunc("day", "MM").alias("month")).agg(F.max(F.struct("day", "next_session")).alias("last"))
    quarter = F.max("last.day").over(Window.partitionBy(F.trunc("month", "quarter")))
    return ends.select("month", F.col("last.day").alias("session"), F.col("last.next_session").alias("next_session"), (F.col("last.day") == quarter).alias("ends_quarter"))


def win_calendar(spark: SparkSession, sf_dir: str, weekend: tuple[int, int] = (4, 5)) -> DataFrame:
    """For each symbol: days, weekend rows, missing weekdays between its first and last, and gaps above 7 days."""
    rows = bars(spark, sf_dir).select("symbol", "day", F.datediff(F.lead("day").over(by_day()), "day").alias("gap"))
    seen = rows.groupBy("symbol").agg(
        F.count("*").alias("days"), F.count_if(F.weekday("day").isin(*weekend)).alias("weekend_rows"), F.count_if(F.col("gap") > 7).alias("long_gaps"), F.max("gap").alias("longest_gap"), F.min("day").alias("low"), F.max("day").alias("high"),
    )
    expected = seen.select("symbol", F.explode(F.sequence("low", "high")).alias("day")).where(~F.weekday("day").isin(*weekend))
    missing = expected.join(rows.select("symbol", "day"), ["symbol", "day"], "left_anti").groupBy("symbol").agg(F.count("*").alias("missing"))
    return seen.join(missing, "symbol", "left").select("symbol", "days", "weekend_rows", "long_gaps", "longest_gap", F.coalesce("missing", F.lit(0)).alias("missing_days"))


def win_worst_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst return over 252 bars and downside volatility of each symbol."""
    rows = bars(spark, sf_dir).select("symbol", returns("close").alias("ret"), returns_over(252).alias("year"))
    downside = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2)))) * F.sqrt(F.lit(252.0))
    return rows.groupBy("symbol").agg(r6(F.min("year")).alias("worst_year"), r6(downside).alias("downside_volatility"))


def win_position_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars on which a position is held, from buy and sell marks: the last mark counts until the next."""
    n = F.row_number().over(by_day())
    want = F.coalesce(F.when(n >= 50, F.avg("close").over(back(19)) > F.avg("close").over(back(49))), F.lit(False))
    rows = bars(spark, sf_dir).withColumn("want", want)
    was = F.coalesce(F.lag("want").over(by_day()), F.lit(False))
    rows = rows.withColumn("mark", F.when(F.col("want") & ~was, "buy").when(~F.col("want") & was, "sell"))
    held = F.last("mark", ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0)) == "buy"
    return rows.withColumn("held", F.coalesce(held, F.lit(False))).groupBy("symbol").agg(F.count_if("held").alias("held_bars"), F.count_if(F.col("mark") == "buy").alias("buys"), F.count_if(F.col("mark") == "sell").alias("sells"))


def win_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a chain: whether each names its predecessor's digest; every 97th has been altered."""
    chain = Window.partitionBy("user_id").orderBy("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256))
    rows = rows.withColumn("previous", F.when(F.col("event_id") % 97 == 0, "altered").otherwise(F.coalesce(F.lag("digest").over(chain), F.lit("start"))))
    good = F.col("previous") == F.coalesce(F.lag("digest").over(chain), F.lit("start"))
    return rows.withColumn("good", good).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(~F.col("good")).alias("broken"), F.min(F.when(~F.col("good"), F.col("event_id"))).alias("first_broken"))


QUERIES = {f.__name__: f for f in (win_returns, win_trailing, win_realized_volatility, win_drawdowns, win_drawdown_episodes, win_market_index, win_regimes, win_runs, win_discontinuities, win_neighbours, win_period_ends, win_calendar, win_worst_year, win_position_days, win_audit_chain)}

_RET = f"{WITH}, r AS (SELECT *, close / nullif(lag(close) OVER {W_SQL}, 0) - 1 AS ret, row_number() OVER {W_SQL} AS rn FROM bars)"
_DD = f"""{WITH}, p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM bars),
d AS (SELECT *, close / peak - 1 AS drawdown, sum(CASE WHEN close >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS spell FROM p)"""
ORACLE = {
    "win_returns": f"{_RET} SELECT symbol, day, round(ret, 6) AS ret FROM r",
    "win_trailing": f"""{_RET} SELECT symbol, day, round(CASE WHEN rn >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) END, 6) AS sma20,
      round(CASE WHEN rn >= 50 THEN avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING) END, 6) AS sma50,
      round(CASE WHEN rn > 20 THEN max(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END, 6) AS high20,
      round(CASE WHEN rn > 20 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END, 6) AS volume20,
      round(close / nullif(lag(close, 60) OVER {W_SQL}, 0) - 1, 6) AS momentum60,
      close > CASE WHEN rn >= 200 THEN avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 199 PRECEDING) END AS above200 FROM r""",
    "win_realized_volatility": f"""{WITH}, r AS (SELECT *, close / nullif(lag(close) OVER {W_SQL}, 0) - 1 AS ret FROM common)
      SELECT symbol, day, round(CASE WHEN count(ret) OVER w = 60 THEN stddev_pop(ret) OVER w * sqrt(252.0) END, 6) AS volatility60 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING)""",
    "win_drawdowns": f"""{_DD}, s AS (SELECT symbol, spell, min(drawdown) AS deepest, count(*) FILTER (drawdown < 0) AS bars, date_diff('day', min(day) FILTER (drawdown < 0), max(day)) AS days FROM d GROUP BY ALL)
      SELECT symbol, round(min(deepest), 6) AS max_drawdown, max(bars) AS longest_bars, coalesce(max(days), 0) AS longest_days FROM s GROUP BY symbol""",
    "win_drawdown_episodes": f"""{_DD}, s AS (SELECT symbol, spell, max(peak) AS peak, min(day) AS first_day, max(day) AS last_day, first(day ORDER BY drawdown, day) AS trough_day, min(drawdown) AS depth, count(*) AS bars FROM d WHERE drawdown < 0 GROUP BY symbol, spell)
      SELECT symbol, round(peak, 6) AS peak, first_day, last_day, trough_day, round(depth, 6) AS depth, bars FROM s WHERE depth <= -0.1""",
    "win_market_index": f"""{WITH}, f AS (SELECT symbol, first(close ORDER BY day) AS base FROM bars GROUP BY symbol),
      g AS (SELECT d.day, f.symbol, f.base FROM (SELECT DISTINCT day FROM bars) d CROSS JOIN f),
      v AS (SELECT g.day, last_value(b.close / g.base IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.day ROWS UNBOUNDED PRECEDING) AS relative FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.day = g.day)
      SELECT day, round(avg(relative), 6) AS level FROM v GROUP BY day HAVING count(relative) = count(*)""",
    "win_regimes": f"""{_RET}, v AS (SELECT *, CASE WHEN count(ret) OVER a = 20 THEN stddev_pop(ret) OVER a END AS vol20, CASE WHEN count(close) OVER b = 200 THEN avg(close) OVER b END AS mean200, lag(close) OVER {W_SQL} AS was FROM r
        WINDOW a AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
      u AS (SELECT *, quantile_cont(vol20, 0.5) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM v)
      SELECT symbol, CASE WHEN mean200 IS NULL THEN 'unknown' WHEN was > mean200 THEN 'up' ELSE 'down' END AS trend, CASE WHEN vol20 IS NULL OR usual IS NULL THEN 'unknown' WHEN round(vol20, 9) > round(usual, 9) THEN 'high' ELSE 'low' END AS volatility,
        count(*) AS bars, round(avg(ret), 6) AS mean_return FROM u GROUP BY ALL""",
    "win_runs": f"""{WITH}, d AS (SELECT symbol, day, coalesce(close < lag(close) OVER {W_SQL}, false) AS down FROM bars),
      i AS (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM d), s AS (SELECT symbol, run, sum(CAST(down AS INT)) AS size FROM i GROUP BY ALL)
      SELECT symbol, CAST(max(size) AS BIGINT) AS longest, count(*) FILTER (size > 0) AS runs FROM s GROUP BY symbol""",
    "win_discontinuities": f"{_RET}, g AS (SELECT *, date_diff('day', lag(day) OVER {W_SQL}, day) AS gap_days FROM r) SELECT symbol, day, round(ret, 6) AS change, abs(ret) > 0.5 AS outlier, gap_days FROM g WHERE abs(ret) >= 0.2",
    "win_neighbours": f"{WITH} SELECT symbol, day, lag(day) OVER {W_SQL} AS before, lead(day) OVER {W_SQL} AS after, round(lead(open) OVER {W_SQL}, 6) AS next_open FROM bars",
    "win_period_ends": f"""{WITH}, n AS (SELECT day, lead(day) OVER (ORDER BY day) AS next_session FROM sessions), m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, max(day) AS session, last(next_session ORDER BY day) AS next_session FROM n GROUP BY 1)
      SELECT month, session, next_session, session = max(session) OVER (PARTITION BY date_trunc('quarter', month)) AS ends_quarter FROM m""",
    "win_calendar": f"""{WITH}, g AS (SELECT symbol, day, date_diff('day', day, lead(day) OVER {W_SQL}) AS gap FROM bars), s AS (SELECT symbol, count(*) AS days, count(*) FILTER (isodow(day) IN (5, 6)) AS weekend_rows, count(*) FILTER (gap > 7) AS long_gaps, max(gap) AS longest_gap, min(day) AS low, max(day) AS high FROM g GROUP BY symbol),
      e AS (SELECT symbol, CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS day FROM s), m AS (SELECT symbol, count(*) AS missing FROM e WHERE isodow(day) NOT IN (5, 6) AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = e.symbol AND b.day = e.day) GROUP BY symbol)
      SELECT s.symbol, days, weekend_rows, long_gaps, longest_gap, coalesce(missing, 0) AS missing_days FROM s LEFT JOIN m USING (symbol)""",
    "win_worst_year": f"""{WITH}, r AS (SELECT symbol, close / nullif(lag(close) OVER {W_SQL}, 0) - 1 AS ret, close / nullif(lag(close, 252) OVER {W_SQL}, 0) - 1 AS year FROM bars)
      SELECT symbol, round(min(year), 6) AS worst_year, round(sqrt(avg(CASE WHEN ret IS NULL THEN 0.0 ELSE pow(least(ret, 0.0), 2) END)) * sqrt(252.0), 6) AS downside_volatility FROM r GROUP BY symbol""",
    "win_position_days": f"""{_RET}, w AS (SELECT symbol, day, coalesce(CASE WHEN rn >= 50 THEN avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) > avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING) END, false) AS want FROM r),
      m AS (SELECT *, CASE WHEN want AND NOT was THEN 'buy' WHEN NOT want AND was THEN 'sell' END AS mark FROM (SELECT *, coalesce(lag(want) OVER {W_SQL}, false) AS was FROM w))
      SELECT symbol, count(*) FILTER (want) AS held_bars, count(*) FILTER (mark = 'buy') AS buys, count(*) FILTER (mark = 'sell') AS sells FROM m GROUP BY symbol""",
    "win_audit_chain": """WITH d AS (SELECT user_id, event_id, coalesce(lag(sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type))) OVER (PARTITION BY user_id ORDER BY event_id), 'start') AS real_previous FROM events)
      SELECT user_id, count(*) AS events, count(*) FILTER (event_id % 97 = 0) AS broken, min(event_id) FILTER (event_id % 97 = 0) AS first_broken FROM d GROUP BY user_id""",
}
