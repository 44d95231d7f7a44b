"""Rotation plans on the common calendar: momentum, absolute momentum and low volatility, and their simulation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import r6, returns
from tapeline.functions.folds import fold
from tapeline.sources.bars import BARS_SQL, CALENDAR_SQL, bars, common, sessions
from tapeline.sources.scratch import written

# Months, choices, cap, capital and cost rates of the plans.
LOOKBACK, TOP, CAP, CAPITAL, FEE, SLIPPAGE = 12, 3, 0.35, 1_000_000.0, 0.004, 0.0025


def month_index(day: str = "day") -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_ends(series: DataFrame) -> DataFrame:
    """month, day, next_day, known: the last common session of each month, the session after it, and how many of
    the LOOKBACK + 1 months before are there. As many rows as months."""
    days = sessions(series).withColumn("next_day", F.lead("day").over(Window.orderBy("day")))
    ends = days.groupBy(month_index().alias("month")).agg(F.max(F.struct("day", "next_day")).alias("x")).select("month", "x.day", "x.next_day")
    return ends.withColumn("known", F.count("*").over(Window.orderBy("month").rangeBetween(-(LOOKBACK + 1), -1))).withColumn("first_month", F.min("month").over(Window.partitionBy(F.lit(0))))


def momentum_scores(series: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """signal_date, execution_date, symbol, score: return from month m - 1 - lookback to m - 1 at each month's end;
    a missing common month leaves the signal without scores."""
    ends = month_ends(series)
    at = ends.join(series, "day").select("month", "symbol", "close")
    signals = ends.where((F.col("known") == lookback + 1) & F.col("next_day").isNotNull())
    start, end = (at.select((F.col("month") + k).alias("month"), "symbol", F.col("close").alias(name)) for k, name in ((lookback + 1, "start"), (1, "end")))
    rows = signals.join(start, "month").join(end, ["month", "symbol"])
    return rows.where("start > 0").select("month", F.col("day").alias("signal_date"), F.col("next_day").alias("execution_date"), "symbol", (F.col("end") / F.col("start") - 1).alias("score"))


def ranked(scores: DataFrame, *order: Column) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("signal_date").orderBy(*order, "symbol")))


def momentum_plan(series: DataFrame) -> DataFrame:
    best = ranked(momentum_scores(series), F.round("score", 12).desc()).where(F.col("rank") <= TOP)
    return best.withColumn("weight", F.lit(1 / TOP))


def capped_weights(chosen: DataFrame, raw: str, top: int = TOP, cap: float = CAP) -> DataFrame:
    """Weights in proportion to `raw` that sum to the chosen share of `top`; what a cap cuts off goes to the others.

    Each pass fixes the symbols above the cap; after `top` passes nothing is left to move."""
    by = Window.partitionBy("signal_date")
    rows = chosen.withColumn("weight", F.lit(None).cast("double")).withColumn("target", F.count("*").over(by) / top)
    for _ in range(top):
        open_ = F.col("weight").isNull()
        left = F.col("target") - F.coalesce(F.sum("weight").over(by), F.lit(0.0))
        share = F.when(open_, F.col(raw) * left / F.sum(F.when(open_, F.col(raw))).over(by))
        rows = rows.withColumn("share", share).withColumn("over", F.max(F.coalesce(F.col("share") > cap, F.lit(False))).over(by))
        rows = rows.withColumn("weight", F.when(~open_, F.col("weight")).when(F.col("over") & (F.col("share") > cap), cap).when(~F.col("over"), F.col("share")))
    return rows.drop("share", "over", "target")


def volatility_at(series: DataFrame, n: int = 60) -> DataFrame:
    """symbol, day, volatility of exactly n returns on the common calendar."""
    window = Window.partitionBy("symbol").orderBy("day").rowsBetween(1 - n, 0)
    rows = common(series).withColumn("ret", returns("close"))
    return rows.select("symbol", "day", F.when(F.count("ret").over(window) == n, F.stddev_pop("ret").over(window) * F.sqrt(F.lit(252.0))).alias("volatility"))


def plan_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three symbols by 12-1 momentum at each month's end, in equal parts."""
    return momentum_plan(written(bars(spark, sf_dir), "plan-bars")).select("signal_date", "execution_date", "symbol", r6("score").alias("score"), "rank", r6("weight").alias("weight"))


def plan_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of positive momentum at quarter ends, each the same part of at most the cap; it may be all cash."""
    scores = momentum_scores(written(bars(spark, sf_dir), "plan-bars")).where(F.month("signal_date").isin(3, 6, 9, 12) & (F.round("score", 12) > 0))
    return scores.select("signal_date", "execution_date", "symbol", r6("score").alias("score"), r6(F.least(1 / F.count("*").over(Window.partitionBy("signal_date")), F.lit(CAP))).alias("weight"))


def plan_low_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three symbols of least 60-session volatility at each quarter's last common session."""
    series = written(bars(spark, sf_dir), "plan-bars")
    days = sessions(series).withColumn("execution_date", F.lead("day").over(Window.orderBy("day")))
    ends = days.groupBy(F.trunc("day", "quarter").alias("quarter")).agg(F.max(F.struct("day", "execution_date")).alias("x")).select("x.day", "x.execution_date").where("execution_date is not null")
    rows = volatility_at(series).where("volatility is not null").join(ends, "day").withColumnRenamed("day", "signal_date")
    best = ranked(rows, F.round("volatility", 12).asc()).where(F.col("rank") <= TOP)
    return best.select("signal_date", "execution_date", "symbol", r6("volatility").alias("volatility"), "rank", r6(F.lit(1 / TOP)).alias("weight"))


def plan_inverse_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The momentum choice weighted by inverse volatility under a cap."""
    series = written(bars(spark, sf_dir), "plan-bars")
    best = momentum_plan(series).drop("weight")
    chosen = best.join(volatility_at(series).withColumnRenamed("day", "signal_date"), ["signal_date", "symbol"]).where("volatility > 0").withColumn("raw", 1 / F.col("volatility"))
    return capped_weights(chosen, "raw").select("signal_date", "symbol", r6("weight").alias("weight"))


def plan_prior_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The momentum choice weighted by inverse volatility under a cap, the volatility being that of the 60 returns before
    the first of the signal's month: at the month's end before."""
    series = written(bars(spark, sf_dir), "plan-bars")
    before = month_ends(series).select((F.col("month") + 1).alias("month"), "day").join(volatility_at(series), "day").drop("day")
    chosen = momentum_plan(series).drop("weight").join(before, ["month", "symbol"]).where("volatility > 0").withColumn("raw", 1 / F.col("volatility"))
    return capped_weights(chosen, "raw").select("signal_date", "symbol", r6("volatility").alias("volatility"), r6("weight").alias("weight"))


def simulated(series: DataFrame, plan: DataFrame, *, capital: float = CAPITAL, fee: float = FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """execution_date, symbol, quantity, cash after each rebalance of a plan (run, execution_date, symbol, rank,
    weight): targets in whole shares on the opening equity, sells by symbol before buys by rank, cash never below 0.

    A date's symbols are one row; a run's dates are read in turn by a fold that holds cash and shares alone."""
    marks = common(series).select(F.col("day").alias("execution_date"), "symbol", "open")
    named = plan.select("run", "execution_date", "symbol", "rank", "weight")
    rows = named.select("run", "execution_date").distinct().join(marks, "execution_date").join(named, ["run", "execution_date", "symbol"], "left")
    dates = rows.groupBy("run", "execution_date").agg(F.array_sort(F.collect_list(F.struct("symbol", "open", "rank", "weight"))).alias("market"))
    done = fold(dates, ["run"], ["execution_date"], ["execution_date", "market"], lambda: [capital, {}], partial(_rebalance, fee=fee, slippage=slippage), "execution_date date, held array<struct<symbol:string,quantity:double>>, cash double")
    return done.select("run", "execution_date", F.explode("held").alias("x"), "cash").select("run", "execution_date", "x.symbol", "x.quantity", "cash")


def _rebalance(state: list, day, market: list, *, fee: float, slippage: float) -> tuple:
    """One date of a run: state is [cash, shares by symbol]."""
    cash, held = state
    price = {x["symbol"]: x["open"] for x in market}
    chosen = sorted((x for x in market if x["weight"] is not None), key=lambda x: x["rank"])
    equity = cash + sum(q * price[s] for s, q in held.items())
    target = {x["symbol"]: int(equity * x["weight"] / (x["open"] * (1 + slippage) * (1 + fee))) for x in chosen}
    for s in sorted(held):
        if (size := held[s] - target.get(s, 0)) > 0:
            cash += size * price[s] * (1 - slippage) * (1 - fee)
            held[s] -= size
    for x in chosen:
        s, cost = x["symbol"], x["open"] * (1 + slippage) * (1 + fee)
        if (size := min(target[s] - held.get(s, 0), int(cash / cost))) > 0:
            cash -= size * cost
            held[s] = held.get(s, 0) + size
    state[0] = cash
    return day, [{"symbol": s, "quantity": float(held.get(s, 0))} for s in price], cash


def curve(series: DataFrame, holdings: DataFrame) -> DataFrame:
    """run, day, equity: every common session valued at its close with the holdings of the last rebalance."""
    dates = holdings.select("run", "execution_date").distinct()
    runs = dates.agg(F.collect_set("run"))  # configurations
    each = sessions(series).withColumn("run", F.explode(runs.scalar())).join(dates.withColumn("day", F.col("execution_date")), ["run", "day"], "left")
    last = F.last("execution_date", ignorenulls=True).over(Window.partitionBy("run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    days = each.select("run", "day", last.alias("execution_date")).where("execution_date is not null")
    rows = days.join(holdings, ["run", "execution_date"]).join(series.select("day", "symbol", "close"), ["day", "symbol"])
    return rows.groupBy("run", "day").agg((F.first("cash") + F.sum(F.col("quantity") * F.col("close"))).alias("equity"))


def rotation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the momentum rotation by each month's end, as the log of its equity over the capital."""
    series = written(bars(spark, sf_dir), "rotation-bars")  # read many times
    plan = written(momentum_plan(series).withColumn("run", F.lit("momentum")), "rotation-plan")
    rows = curve(series, written(simulated(series, plan), "rotation-holdings"))
    last = F.max_by("equity", "day")
    return rows.groupBy("run", F.trunc("day", "MM").alias("month")).agg(r6(F.log(last / CAPITAL)).alias("log_growth"))


QUERIES = {f.__name__: f for f in (plan_momentum, plan_absolute, plan_low_volatility, plan_inverse_volatility, plan_prior_volatility, rotation_curve)}
_WITH = f"""WITH {BARS_SQL}, {CALENDAR_SQL}, n AS (SELECT day, lead(day) OVER (ORDER BY day) AS next_day, year(day) * 12 + month(day) - 1 AS month FROM sessions),
ends AS (SELECT month, max(day) AS day, last(next_day ORDER BY day) AS next_day FROM n GROUP BY month), e2 AS (SELECT *, count(*) OVER (ORDER BY month RANGE BETWEEN {LOOKBACK + 1} PRECEDING AND 1 PRECEDING) AS known FROM ends), month_close AS (SELECT month, symbol, close FROM ends JOIN bars USING (day)),
scores AS (SELECT e.day AS signal_date, e.next_day AS execution_date, s.symbol, x.close / s.close - 1 AS score FROM e2 e JOIN month_close s ON s.month = e.month - {LOOKBACK + 1} JOIN month_close x ON x.month = e.month - 1 AND x.symbol = s.symbol WHERE known = {LOOKBACK + 1} AND next_day IS NOT NULL AND s.close > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY round(score, 12) DESC, symbol) AS rank FROM scores) WHERE rank <= {TOP}),
r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS ret FROM common),
v AS (SELECT symbol, day, CASE WHEN count(ret) OVER w = 60 THEN stddev_pop(ret) OVER w * sqrt(252.0) END AS volatility FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING))"""


def _passes(at: str = "b.signal_date") -> str:
    out = f", p0 AS (SELECT b.signal_date, b.symbol, 1 / v.volatility AS raw, CAST(NULL AS DOUBLE) AS weight, count(*) OVER (PARTITION BY b.signal_date) / {TOP} AS target FROM best b JOIN v ON v.symbol = b.symbol AND v.day = {at} WHERE v.volatility > 0)"
    for k in range(TOP):
        out += f""", s{k} AS (SELECT *, CASE WHEN weight IS NULL THEN raw * (target - coalesce(sum(weight) OVER (PARTITION BY signal_date), 0.0)) / sum(CASE WHEN weight IS NULL THEN raw END) OVER (PARTITION BY signal_date) END AS share FROM p{k}),
        o{k} AS (SELECT *, max(CASE WHEN share > {CAP} THEN 1 ELSE 0 END) OVER (PARTITION BY signal_date) AS above FROM s{k}), p{k + 1} AS (SELECT signal_date, symbol, raw, target, CASE WHEN weight IS NOT NULL THEN weight WHEN above = 1 AND share > {CAP} THEN {CAP} WHEN above = 0 THEN share END AS weight FROM o{k})"""
    return out


_K = range(5)


def _plus(first: str, *parts: str) -> str:
    return "(" * len(parts) + first + "".join(f" + {p})" for p in parts)


def _rebalance_sql() -> str:
    """One date of the rotation: each trade is a SELECT over the one before, sells by symbol, then buys by rank."""
    sql = f"SELECT d.*, h.cash, {', '.join(f'h.q{k}' for k in _K)} FROM held h JOIN dates d ON d.i = h.i + 1"
    sql = f"SELECT *, {_plus('cash', *(f'q{k} * o{k}' for k in _K))} AS equity FROM ({sql})"
    cost = lambda k: f"(o{k} * (1 + {SLIPPAGE}::DOUBLE) * (1 + {FEE}::DOUBLE))"
    sql = f"SELECT *, {', '.join(f'CASE WHEN r{k} IS NULL THEN 0.0::DOUBLE ELSE trunc(equity * (1.0::DOUBLE / {TOP}) / {cost(k)}) END AS t{k}' for k in _K)} FROM ({sql})"
    for k in _K:
        sql = f"SELECT * REPLACE (cash + greatest(q{k} - t{k}, 0) * o{k} * (1 - {SLIPPAGE}::DOUBLE) * (1 - {FEE}::DOUBLE) AS cash, least(q{k}, t{k}) AS q{k}) FROM ({sql})"
    for rank in range(1, TOP + 1):
        for k in _K:
            sql = f"SELECT *, CASE WHEN r{k} = {rank} THEN greatest(0.0::DOUBLE, least(t{k} - q{k}, trunc(cash / {cost(k)}))) ELSE 0.0::DOUBLE END AS size FROM ({sql})"
            sql = f"SELECT * EXCLUDE (size) REPLACE (cash - size * {cost(k)} AS cash, q{k} + size AS q{k}) FROM ({sql})"
    return f"SELECT i, day, cash, {', '.join(f'q{k}' for k in _K)} FROM ({sql})"


_ROTATED = _WITH.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
dates AS MATERIALIZED (SELECT c.day, {", ".join(f"max(c.open) FILTER (c.symbol = 'S{k}') AS o{k}, max(b.rank) FILTER (c.symbol = 'S{k}') AS r{k}" for k in _K)}, row_number() OVER (ORDER BY c.day) AS i
  FROM common c LEFT JOIN best b ON b.execution_date = c.day AND b.symbol = c.symbol WHERE c.day IN (SELECT execution_date FROM best) GROUP BY c.day),
held AS (SELECT 0::BIGINT AS i, DATE '1900-01-01' AS day, {CAPITAL}::DOUBLE AS cash, {", ".join(f"0.0::DOUBLE AS q{k}" for k in _K)} UNION ALL {_rebalance_sql()}),
closes AS (SELECT day, {", ".join(f"max(close) FILTER (symbol = 'S{k}') AS c{k}" for k in _K)} FROM common GROUP BY day),
valued AS (SELECT c.day, {_plus("h.cash", *(f"h.q{k} * c.c{k}" for k in _K))} AS equity FROM closes c ASOF JOIN held h ON c.day >= h.day WHERE h.i > 0)"""
ORACLE = {
    "plan_momentum": f"{_WITH} SELECT signal_date, execution_date, symbol, round(score, 6) AS score, rank, round(1.0 / {TOP}, 6) AS weight FROM best",
    "plan_absolute": f"{_WITH} SELECT signal_date, execution_date, symbol, round(score, 6) AS score, round(least(1.0 / count(*) OVER (PARTITION BY signal_date), {CAP}), 6) AS weight FROM scores WHERE month(signal_date) IN (3, 6, 9, 12) AND round(score, 12) > 0",
    "plan_low_volatility": f"""{_WITH}, q AS (SELECT max(day) AS signal_date, last(next_day ORDER BY day) AS execution_date FROM n GROUP BY date_trunc('quarter', day)), k AS (SELECT q.*, symbol, volatility, row_number() OVER (PARTITION BY signal_date ORDER BY round(volatility, 12), symbol) AS rank FROM q JOIN v ON v.day = q.signal_date WHERE execution_date IS NOT NULL AND volatility IS NOT NULL)
      SELECT signal_date, execution_date, symbol, round(volatility, 6) AS volatility, rank, round(1.0 / {TOP}, 6) AS weight FROM k WHERE rank <= {TOP}""",
    "plan_inverse_volatility": f"{_WITH}{_passes()} SELECT signal_date, symbol, round(weight, 6) AS weight FROM p{TOP}",
    "plan_prior_volatility": f"""{_WITH}{_passes("(SELECT e.day FROM ends e WHERE e.month = year(b.signal_date) * 12 + month(b.signal_date) - 2)")} SELECT signal_date, symbol, round(1 / raw, 6) AS volatility, round(weight, 6) AS weight FROM p{TOP}""",
    "rotation_curve": f"{_ROTATED} SELECT 'momentum' AS run, CAST(date_trunc('month', day) AS DATE) AS month, round(ln(last(equity ORDER BY day) / {CAPITAL}), 6) AS log_growth FROM valued GROUP BY ALL",
}
