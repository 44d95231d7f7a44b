"""A paper portfolio that follows daily files as a stream: quarterly decisions, their execution, and a running summary.

One row of the stream is a session with its market. State by run holds cash, shares, the closes of recent months,
the last session and running sums; a session that was seen already, or that is older, changes nothing, so that files
may be delivered again and a stopped stream goes on from its checkpoint. The same step folds a finished table.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeline.functions.columns import r6
from tapeline.functions.folds import fold
from tapeline.plans.rotation import LOOKBACK
from tapeline.plans.rotation import _WITH as _PLAN_SQL
from tapeline.sources.bars import bars, common
from tapeline.sources.scratch import scratch, written

# Capital, cost rates and the cap of a symbol's weight.
CAPITAL, FEE, SLIPPAGE, CAP = 1_000_000.0, 0.004, 0.0025, 0.20
KEPT_MONTHS = LOOKBACK + 3
RUN = "absolute_momentum"

FIELDS = "day date, cash double, equity double, drawdown double, fees double, slippage double, traded double, turnover double, exposure double, benchmark double, executions long, rejected long, held string, event_id string"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
#: The state store that keeps the values of a stateful processor.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cents(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


def total(cash: float, held: dict, price: dict) -> float:
    for s in sorted(price):
        cash += held.get(s, 0) * price[s]
    return cash


def opened(capital: float = CAPITAL) -> dict:
    """The state of a run before its first session."""
    return {"start": capital, "cash": capital, "held": {}, "last": None, "months": {}, "peak": capital, "fees": 0.0, "slippage": 0.0, "traded": 0.0, "equities": 0.0, "sessions": 0, "executions": 0, "rejected": 0, "benchmark": None}


def chosen(months: dict, last: date) -> list[str]:
    """Symbols of positive momentum at a session, by the month ends of the months before; none where a month lacks."""
    end = last.year * 12 + last.month - 2
    if any(str(m) not in months for m in range(end - LOOKBACK, end + 1)):
        return []
    start, stop = months[str(end - LOOKBACK)], months[str(end)]
    return sorted(s for s in stop if start.get(s, 0) > 0 and round(stop[s] / start[s] - 1, 12) > 0)


def executed(state: dict, selected: list[str], market: list) -> None:
    """Sells, then buys, at the session's open: whole shares, limits in cents, within volume and cash."""
    held, volume = state["held"], {x["symbol"]: int(x["volume"] or 0) for x in market}
    price = {x["symbol"]: x["open"] for x in market}
    equity = total(state["cash"], held, price)
    weight = min(1 / len(selected), CAP) if selected else 0.0
    target = {s: math.floor(equity * (weight if s in selected else 0.0) / (price[s] * (1 + SLIPPAGE) * (1 + FEE))) for s in price}
    state["executions"] += 1

    def fill(s: str, sign: int, size: int, limit: float) -> None:
        fee = cents(size * limit * FEE)
        state["cash"] += -sign * size * limit - fee
        state["fees"] += fee
        state["slippage"] += cents(abs(limit - price[s]) * size)
        state["traded"] += size * limit
        held[s] = held.get(s, 0) + sign * size

    for s in sorted(price):
        wanted = held.get(s, 0) - target[s]
        if wanted > 0:
            size = min(wanted, volume[s])
            state["rejected"] += wanted - size
            fill(s, -1, size, cents(price[s] * (1 - SLIPPAGE)))
    for s in selected:
        wanted = target[s] - held.get(s, 0)
        if wanted > 0:
            limit = cents(price[s] * (1 + SLIPPAGE))
            size = max(0, min(wanted, volume[s], math.floor(state["cash"] / (limit * (1 + FEE)))))
            state["rejected"] += wanted - size
            fill(s, 1, size, limit)


def observed(state: dict, run: str, day: date, market: list) -> tuple | None:
    """One session: what a quarter's end decided is executed at this open, then the close is summed up. None, and
    nothing changes, for a session that is not after the last one."""
    last = date.fromisoformat(state["last"]) if state["last"] else None
    if last and day <= last:
        return None
    market = sorted(market, key=lambda x: x["symbol"])
    if last and (last.year, (last.month - 1) // 3) != (day.year, (day.month - 1) // 3):
        executed(state, chosen(state["months"], last), market)
    close = {x["symbol"]: x["close"] for x in market}
    if state["benchmark"] is None:
        part = state["start"] / len(close)
        shares = {s: math.floor(part / close[s]) for s in close}
        state["benchmark"] = [shares, state["start"] - total(0.0, shares, close)]
    state["months"][str(day.year * 12 + day.month - 1)] = close
    for month in sorted(state["months"], key=int)[:-KEPT_MONTHS]:
        del state["months"][month]
    equity = total(state["cash"], state["held"], close)
    state["peak"] = max(state["peak"], equity)
    state["equities"] += equity
    state["sessions"] += 1
    state["last"] = day.isoformat()
    invested = total(0.0, state["held"], close)
    mean = state["equities"] / state["sessions"]
    held = ",".join(f"{s}:{q}" for s, q in sorted(state["held"].items()) if q)
    event = hashlib.sha256(f"daily_summary|{run}|{day}".encode()).hexdigest()
    shares, rest = state["benchmark"]
    sums = [state[c] for c in ("fees", "slippage", "traded")]
    return (day, state["cash"], equity, equity / state["peak"] - 1, *sums, state["traded"] / mean, invested / equity, total(rest, shares, close) / state["start"] - 1, state["executions"], state["rejected"], held, event)


class Replay(StatefulProcessor):
    """observed() with its state in the stream's store, one value of JSON for each run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("portfolio", "portfolio string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else opened()
        sessions = sorted((r for frame in rows for r in zip(frame["day"], frame["market"], strict=True)), key=lambda r: r[0])
        out = [made for day, market in sessions if (made := observed(state, key[0], day, list(market))) is not None]
        self.state.update((json.dumps(state),))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["run", *_NAMES])

    def close(self) -> None:
        pass


def daily(series: DataFrame) -> DataFrame:
    """run, day, market: a row for each common session, with a list of its symbols' prices and volumes."""
    prices = F.struct("symbol", "open", "close", "volume")
    return common(series).groupBy("day").agg(F.array_sort(F.collect_list(prices)).alias("market")).select(F.lit(RUN).alias("run"), "day", "market")


def folded(sessions: DataFrame) -> DataFrame:
    """The summary of each session by a fold over a finished table."""
    return fold(sessions, ["run"], ["day"], ["run", "day", "market"], opened, observed, FIELDS)


def followed(spark: SparkSession, folder: str, checkpoint: str, path: str, files: int = 2) -> DataFrame:
    """The summaries so far: takes what is new in a folder of session files, some files at a time in their order, and
    appends to a table; called again, with the same checkpoint, it goes on where it ended."""
    sessions = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        rows = sessions.groupBy("run").transformWithStateInPandas(Replay(), f"run string, {FIELDS}", outputMode="append", timeMode="none")
        rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", path).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.parquet(path)


def stored(sessions: DataFrame, folder: str) -> None:
    """Session files in the order of their days, a file for each half year."""
    half = F.concat(F.year("day").cast("string"), F.when(F.month("day") < 7, "a").otherwise("b"))
    rows = written(sessions.withColumn("half", half), "sessions")
    for (part,) in rows.select("half").distinct().orderBy("half").collect():  # a bounded number of half years
        rows.where(F.col("half") == part).drop("half").coalesce(1).write.mode("append").parquet(folder)


def _report(rows: DataFrame) -> DataFrame:
    money = [F.round(c, 2).alias(c) for c in ("cash", "equity", "fees", "slippage", "traded")]
    return rows.select("run", "day", *money, *(r6(c).alias(c) for c in ("drawdown", "turnover", "exposure", "benchmark")), "executions", "rejected", "held", "event_id")


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's summary, from files of half years followed as a stream."""
    folder = scratch(spark, "replay-sessions")
    stored(daily(written(bars(spark, sf_dir), "replay-bars")), folder)
    return _report(followed(spark, folder, scratch(spark, "replay-state"), scratch(spark, "replay")))


def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last summary of each month, by the fold."""
    rows = folded(daily(written(bars(spark, sf_dir), "replay-bars")))
    last = rows.groupBy("run", F.trunc("day", "MM").alias("month")).agg(F.max_by(F.struct(*_NAMES), "day").alias("x")).select("run", "x.*")
    return _report(last)


QUERIES = {f.__name__: f for f in (stream_replay, replay_summary)}

_K = range(5)
_CENT = "floor(({}) * 100 + 0.5) / 100"


def _sum(first: str, *parts: str) -> str:
    return "(" * len(parts) + first + "".join(f" + {p})" for p in parts)


def _fills() -> str:
    """The trades of one execution in order, each a SELECT over the one before: sells by symbol, then buys by symbol."""
    held = _sum("cash", *(f"q{k} * o{k}" for k in _K))
    sql = f"SELECT *, {held} AS equity FROM (SELECT r.cash, r.fees, r.slip, r.traded, r.rejected, {', '.join(f'r.q{k}' for k in _K)}, e.* FROM steps r JOIN executions e ON e.k = r.k + 1)"
    sql = f"SELECT *, {', '.join(f'CAST(floor(equity * w{k} / (o{k} * (1 + {SLIPPAGE}::DOUBLE) * (1 + {FEE}::DOUBLE))) AS BIGINT) AS t{k}' for k in _K)} FROM ({sql})"
    for sign, word in ((-1, "sell"), (1, "buy")):
        for k in _K:
            wanted = f"greatest(q{k} - t{k}, 0)" if sign < 0 else f"CASE WHEN w{k} > 0 THEN greatest(t{k} - q{k}, 0) ELSE 0 END"
            limit = _CENT.format(f"o{k} * (1 {'-' if sign < 0 else '+'} {SLIPPAGE}::DOUBLE)")
            room = f"least(wanted, v{k})" if sign < 0 else f"greatest(0, least(wanted, v{k}, CAST(floor(cash / (lim * (1 + {FEE}::DOUBLE))) AS BIGINT)))"
            sql = f"SELECT *, {wanted} AS wanted, {limit} AS lim FROM ({sql})"
            sql = f"SELECT *, {room} AS size FROM ({sql})"
            sql = f"SELECT *, {_CENT.format(f'size * lim * {FEE}::DOUBLE')} AS fee FROM ({sql})"
            sql = f"SELECT * EXCLUDE (wanted, lim, size, fee) REPLACE (cash + ({-sign} * size * lim - fee) AS cash, fees + fee AS fees, slip + {_CENT.format(f'abs(lim - o{k}) * size')} AS slip, traded + size * lim AS traded, rejected + wanted - size AS rejected, q{k} + {sign} * size AS q{k}) FROM ({sql})"
    return sql


_WIDE = ", ".join(f"max({c}) FILTER (symbol = 'S{k}') AS {c[0]}{k}" for k in _K for c in ("open", "volume", "close"))
_REPLAY_SQL = _PLAN_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
wide AS MATERIALIZED (SELECT day, {_WIDE}, row_number() OVER (ORDER BY day) AS i FROM common GROUP BY day),
turns AS (SELECT *, lag(day) OVER (ORDER BY day) AS signal_date FROM wide),
picked AS (SELECT signal_date, symbol, least(1.0::DOUBLE / count(*) OVER (PARTITION BY signal_date), {CAP}::DOUBLE) AS weight FROM scores WHERE round(score, 12) > 0),
weights AS (SELECT signal_date, {", ".join(f"max(weight) FILTER (symbol = 'S{k}') AS w{k}" for k in _K)} FROM picked GROUP BY signal_date),
executions AS MATERIALIZED (SELECT t.day, {", ".join(f"t.o{k}, t.v{k}, coalesce(w{k}, 0.0::DOUBLE) AS w{k}" for k in _K)}, row_number() OVER (ORDER BY t.day) AS k FROM turns t LEFT JOIN weights w USING (signal_date) WHERE date_trunc('quarter', t.day) <> date_trunc('quarter', t.signal_date)),
steps AS (SELECT 0::BIGINT AS k, CAST(NULL AS DATE) AS day, {CAPITAL}::DOUBLE AS cash, 0.0::DOUBLE AS fees, 0.0::DOUBLE AS slip, 0.0::DOUBLE AS traded, 0::BIGINT AS rejected, {", ".join(f"0::BIGINT AS q{k}" for k in _K)}
  UNION ALL SELECT k, day, cash, fees, slip, traded, rejected, {", ".join(f"q{k}" for k in _K)} FROM ({_fills()})),
days AS (SELECT w.*, s.cash, s.fees, s.slip, s.traded, s.rejected, s.k, {", ".join(f"s.q{k}" for k in _K)} FROM wide w ASOF JOIN (SELECT * REPLACE (coalesce(day, DATE '1900-01-01') AS day) FROM steps) s ON w.day >= s.day),
bench AS (SELECT {", ".join(f"floor({CAPITAL}::DOUBLE / 5 / c{k}) AS b{k}" for k in _K)}, {", ".join(f"c{k} AS a{k}" for k in _K)} FROM wide WHERE i = 1),
valued AS (SELECT d.*, {_sum("d.cash", *(f"d.q{k} * d.c{k}" for k in _K))} AS equity, {_sum("0.0::DOUBLE", *(f"d.q{k} * d.c{k}" for k in _K))} AS invested,
  ({CAPITAL}::DOUBLE - {_sum("0.0::DOUBLE", *(f"b{k} * a{k}" for k in _K))} + {_sum("0.0::DOUBLE", *(f"b{k} * c{k}" for k in _K))}) / {CAPITAL}::DOUBLE - 1 AS benchmark FROM days d, bench),
report AS (SELECT '{RUN}' AS run, day, round(cash, 2) AS cash, round(equity, 2) AS equity, round(equity / greatest({CAPITAL}::DOUBLE, max(equity) OVER w) - 1, 6) AS drawdown, round(fees, 2) AS fees, round(slip, 2) AS slippage, round(traded, 2) AS traded,
  round(traded / (sum(equity) OVER w / i), 6) AS turnover, round(invested / equity, 6) AS exposure, round(benchmark, 6) AS benchmark, k AS executions, rejected, concat_ws(',', {", ".join(f"CASE WHEN q{k} > 0 THEN 'S{k}:' || q{k} END" for k in _K)}) AS held, sha256('daily_summary|{RUN}|' || day) AS event_id
  FROM valued WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))"""
ORACLE = {
    "stream_replay": f"{_REPLAY_SQL} SELECT * FROM report",
    "replay_summary": f"{_REPLAY_SQL} SELECT * FROM report QUALIFY day = max(day) OVER (PARTITION BY date_trunc('month', day))",
}
