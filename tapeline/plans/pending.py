"""Monthly equal-weight rebalancing on the union calendar: each symbol waits for its own next bar."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.folds import fold
from tapeline.sources.bars import BARS_SQL, bars

# Capital and cost rates.
CAPITAL, FEE, SLIPPAGE = 1_000_000.0, 0.004, 0.0025
FIELDS = "day date, equity double, cash double, fees double, trades long, waiting long, invested boolean"


def rebalanced(series: DataFrame, symbols: DataFrame, *, capital: float = CAPITAL, fee: float = FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """run, day, equity, cash, fees, trades, waiting, invested of every day on which a symbol of the run has a bar.

    With a new month every symbol of `symbols` (run, symbol) is due; it trades at its first open from then on, towards
    an equal part of the equity at that day's opens (the last close for those without a bar): sells of all first, then
    buys within cash and the bar's volume. A day's symbols are one row, and the fold holds one run's state."""
    runs = symbols.groupBy("run").agg(F.array_sort(F.collect_set("symbol")).alias("all"))
    prices = F.struct("symbol", "open", "close", "volume")
    days = series.join(symbols, "symbol").groupBy("run", "day").agg(F.array_sort(F.collect_list(prices)).alias("market")).join(runs, "run")
    start = partial(_start, capital)
    return fold(days, ["run"], ["day"], ["day", "market", "all"], start, partial(_step, fee=fee, slippage=slippage), FIELDS)


def _start(capital: float) -> list:
    """Cash, shares, last closes, symbols that are due, the last month, fees, trades."""
    return [capital, {}, {}, set(), None, 0.0, 0]


def _step(state: list, day, market: list, every: list, *, fee: float, slippage: float) -> tuple:
    cash, held, closes, due, month, fees, trades = state
    if month != (day.year, day.month):
        due = set(every)
    now = {x["symbol"]: x for x in market}
    worth = cash
    for s in every:
        worth += held.get(s, 0) * (now[s]["open"] if s in now else closes.get(s, 0.0))
    part = worth / len(every)
    ready = sorted(due & now.keys())
    for s in ready:
        price = now[s]["open"]
        if held.get(s, 0) * price > part and (size := min(held[s], int((held[s] * price - part) / price))):
            fill = price * (1 - slippage)
            cost = size * fill * fee
            cash += size * fill - cost
            held[s] -= size
            fees, trades = fees + cost, trades + 1
    for s in ready:
        price = now[s]["open"]
        if held.get(s, 0) * price < part:
            fill = price * (1 + slippage)
            each = fill * (1 + fee)
            if size := min(int((part - held.get(s, 0) * price) / each), int(cash / each), int(now[s]["volume"] or 0)):
                cost = size * fill * fee
                cash -= size * fill + cost
                held[s] = held.get(s, 0) + size
                fees, trades = fees + cost, trades + 1
    due -= set(ready)
    for s, x in now.items():
        closes[s] = x["close"]
    equity = cash
    for s in every:
        equity += held.get(s, 0) * closes.get(s, 0.0)
    state[:] = [cash, held, closes, due, (day.year, day.month), fees, trades]
    return day, equity, cash, fees, trades, len(due), any(q > 0 for q in held.values())


def pending_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the monthly equal-weight portfolio of all symbols. The days on which a symbol has no bar are those
    where its day number leaves 0 of 7 with the symbol's own, besides the days it lacks anyway."""
    series = thinned(bars(spark, sf_dir))
    symbols = series.select(F.lit("equal").alias("run"), "symbol").distinct()
    rows = rebalanced(series, symbols)
    return rows.select("run", "day", *(F.round(c, 2).alias(c) for c in ("equity", "cash", "fees")), "trades", "waiting", "invested")


def thinned(series: DataFrame) -> DataFrame:
    number = F.substring("symbol", 2, 9).cast("int")
    return series.where((F.unix_date("day") + number) % 7 != 0)


QUERIES = {"pending_rebalance": pending_rebalance}

_K = range(5)


def _chain(first: str, *parts: str) -> str:
    return "(" * len(parts) + first + "".join(f" + {p})" for p in parts)


def _day_sql() -> str:
    """One day of the portfolio: each trade is a SELECT over the one before."""
    new = "date_trunc('month', d.day) <> date_trunc('month', r.day)"
    sql = f"SELECT d.*, r.cash, r.fees, r.trades, {', '.join(f'r.q{k}, r.l{k}, r.p{k} OR {new} AS p{k}' for k in _K)} FROM steps r JOIN wide d ON d.i = r.i + 1"
    worth = _chain("cash", *(f"q{k} * coalesce(o{k}, l{k})" for k in _K))
    sql = f"SELECT *, {worth} / 5 AS part FROM ({sql})"
    for k in _K:
        sql = f"SELECT *, CASE WHEN p{k} AND q{k} * o{k} > part THEN least(q{k}, CAST(trunc((q{k} * o{k} - part) / o{k}) AS BIGINT)) ELSE 0 END AS size, o{k} * (1 - {SLIPPAGE}::DOUBLE) AS fill FROM ({sql})"
        sql = f"SELECT * EXCLUDE (size, fill) REPLACE (CASE WHEN size > 0 THEN cash + (size * fill - size * fill * {FEE}::DOUBLE) ELSE cash END AS cash, CASE WHEN size > 0 THEN fees + size * fill * {FEE}::DOUBLE ELSE fees END AS fees, trades + CASE WHEN size > 0 THEN 1 ELSE 0 END AS trades, q{k} - size AS q{k}) FROM ({sql})"
    for k in _K:
        each = f"(o{k} * (1 + {SLIPPAGE}::DOUBLE) * (1 + {FEE}::DOUBLE))"
        sql = f"SELECT *, CASE WHEN p{k} AND q{k} * o{k} < part THEN least(CAST(trunc((part - q{k} * o{k}) / {each}) AS BIGINT), CAST(trunc(cash / {each}) AS BIGINT), v{k}) ELSE 0 END AS size, o{k} * (1 + {SLIPPAGE}::DOUBLE) AS fill FROM ({sql})"
        sql = f"SELECT * EXCLUDE (size, fill) REPLACE (CASE WHEN size > 0 THEN cash - (size * fill + size * fill * {FEE}::DOUBLE) ELSE cash END AS cash, CASE WHEN size > 0 THEN fees + size * fill * {FEE}::DOUBLE ELSE fees END AS fees, trades + CASE WHEN size > 0 THEN 1 ELSE 0 END AS trades, q{k} + size AS q{k}) FROM ({sql})"
    return f"SELECT i, day, cash, fees, trades, {', '.join(f'q{k}, coalesce(c{k}, l{k}) AS l{k}, p{k} AND o{k} IS NULL AS p{k}' for k in _K)} FROM ({sql})"


_WIDE = ", ".join(f"max({c}) FILTER (symbol = 'S{k}') AS {c[0]}{k}" for k in _K for c in ("open", "volume", "close"))
ORACLE = {
    "pending_rebalance": f"""WITH RECURSIVE {BARS_SQL}, thin AS (SELECT * FROM bars WHERE ((day - DATE '1970-01-01') + CAST(substr(symbol, 2) AS INT)) % 7 <> 0),
      wide AS MATERIALIZED (SELECT day, {_WIDE}, row_number() OVER (ORDER BY day) AS i FROM thin GROUP BY day),
      steps AS (SELECT 0::BIGINT AS i, DATE '1900-01-01' AS day, {CAPITAL}::DOUBLE AS cash, 0.0::DOUBLE AS fees, 0::BIGINT AS trades, {", ".join(f"0::BIGINT AS q{k}, 0.0::DOUBLE AS l{k}, true AS p{k}" for k in _K)} UNION ALL {_day_sql()})
      SELECT 'equal' AS run, day, round({_chain("cash", *(f"q{k} * l{k}" for k in _K))}, 2) AS equity, round(cash, 2) AS cash, round(fees, 2) AS fees, trades, CAST({" + ".join(f"p{k}::INT" for k in _K)} AS BIGINT) AS waiting, {" OR ".join(f"q{k} > 0" for k in _K)} AS invested FROM steps WHERE i > 0""",
}
