"""What a strategy gives up and gains against holding, runs on adjusted prices behind a gate of quality, how diverse
portfolios are, and whether a provider of quotes passes its certification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, r6
from tapeline.operators.backtest import _METRICS_SQL, _ONE, CAPITAL, FEE, SLIPPAGE, _curve_sql, backtest, hold_signal, ma_signal, metrics, signalled
from tapeline.sources.bars import BARS_SQL, SOURCES_SQL, bars, observations, table
from tapeline.sources.scratch import written

# What a certified provider must offer, its checks in their order, and their bounds.
CAPABILITIES = ("polling_quotes", "historical_data", "dsex_index", "corporate_actions")
CHECKS = (
    "licensed_for_operational_use", "required_capabilities", "timestamp_provenance", "symbol_coverage", "quote_schema", "freshness", "missing_updates", "quote_timestamp_provenance", "latency",
    "event_ordering", "duplicate_handling", "historical_consistency", "historical_coverage",
)
TRUSTED, MOST_AGE, MOST_LATENCY = "exchange_verified", 30, 2000
#: A close that differs from the one before by more than this share is an outlier of a source.
OUTLIER = 0.5


def held_in_part(series: DataFrame, parts: DataFrame, *, capital: float = CAPITAL, fee: float = FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """The curve of run `matched`: of each symbol's capital the part that parts (symbol, part) names is spent on the first
    bar after the first whose volume suffices, and kept; the rest stays cash. No fold: what is bought depends on that
    bar alone. A symbol without a part, or with one too small for a unit, buys nothing."""
    rows = series.withColumn("i", F.row_number().over(by_day())).join(parts, "symbol", "left")
    price = F.col("open") * (1 + slippage)
    size = F.floor(capital * F.coalesce("part", F.lit(0.0)) / (price * (1 + fee)))
    able = (F.col("i") > 1) & (size > 0) & (F.coalesce("volume", F.lit(0)) >= size)
    rows = rows.withColumns({"price": price, "size": size, "entry": F.min(F.when(able, F.col("i"))).over(Window.partitionBy("symbol"))})
    bought, held = F.col("i") == F.col("entry"), by_day().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"side": F.when(bought, "buy"), "traded": F.when(bought, F.col("size")).otherwise(0), "fill": F.when(bought, F.col("price")).otherwise(0.0)})
    rows = rows.withColumn("fee", F.col("traded") * F.col("fill") * fee)
    quantity, spent = F.sum("traded").over(held), F.sum(F.col("traded") * F.col("fill") + F.col("fee")).over(held)
    return rows.select(F.lit("matched").alias("run"), "symbol", "day", "open", "close", "side", "traded", "fill", "fee", (F.col("i") >= F.col("entry")).alias("desired"), (capital - spent + quantity * F.col("close")).alias("equity"))


def cost_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20/50 run against holding, and against holding with a part of the capital that equals the run's exposure: return
    given up, drawdown avoided, the first for each point of the second, and differences of the other figures. A ratio
    that a run has not counts as 0, as does one without a denominator."""
    series = written(bars(spark, sf_dir), "tradeoff-bars")
    figures = written(metrics(backtest(signalled(series, {"ma_20_50": ma_signal(20, 50), "hold": hold_signal()}))), "tradeoff-runs")
    matched = metrics(held_in_part(series, figures.where("run = 'ma_20_50'").select("symbol", (F.col("exposure_percent") / 100).alias("part"))))
    of = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    columns = ("total_percent", "annual_percent", "volatility_percent", "exposure_percent", "max_drawdown_percent", "sharpe", "sortino", "calmar", "fees", "slippage", "turnover")
    wide = figures.unionByName(matched).groupBy("symbol").agg(*(of(run, c).alias(f"{x}_{c}") for run, x in (("ma_20_50", "ma"), ("hold", "hold"), ("matched", "part")) for c in columns))
    less = lambda c, a="ma", b="hold": F.coalesce(f"{a}_{c}", F.lit(0.0)) - F.coalesce(f"{b}_{c}", F.lit(0.0))
    avoided, given_up = F.abs("hold_max_drawdown_percent") - F.abs("ma_max_drawdown_percent"), less("total_percent", "hold", "ma")
    return wide.select(
        "symbol", r6(given_up).alias("return_sacrificed"), r6(avoided).alias("drawdown_avoided"), r6(given_up / F.nullif(F.round(avoided, 6), F.lit(0.0))).alias("sacrificed_per_point"),
        *(r6(less(c)).alias(f"{name}_difference") for c, name in (("annual_percent", "annual"), ("volatility_percent", "volatility"), ("sharpe", "sharpe"), ("sortino", "sortino"), ("calmar", "calmar"), ("exposure_percent", "exposure"), ("turnover", "turnover"))),
        r6(less("fees")).alias("additional_fees"), r6(less("slippage")).alias("additional_slippage"),
        r6(less("total_percent", b="part")).alias("return_over_matched"), r6(F.abs("part_max_drawdown_percent") - F.abs("ma_max_drawdown_percent")).alias("drawdown_below_matched"), r6(less("sharpe", b="part")).alias("sharpe_over_matched"),
    )


def dataset_quality(rows: DataFrame) -> DataFrame:
    """Of each dataset (rows: dataset, symbol, day, open, high, low, close, factor): rows, symbols, repeated keys, weekdays
    without a row between a symbol's first and last, outliers of the unadjusted closes, rows that can't be valid, rows
    with an adjustment, and whether it passes, which no fault may prevent. A row without symbol or day is an error and
    counts in nothing else; of rows of one key the first by close counts for gaps and outliers."""
    key = ["dataset", "symbol", "day"]
    bad = F.coalesce((F.least("open", "low", "close") <= 0) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")) | (F.col("factor") <= 0), F.lit(True)) | F.greatest(*(F.col(c).isNull() for c in (*key, "open", "high", "low", "close", "factor")))
    days = rows.withColumn("bad", bad).groupBy(key).agg(F.count("*").alias("n"), F.count_if("bad").alias("errors"), F.count_if(F.col("factor") != 1).alias("adjusted"), F.min("close").alias("close"))
    known = F.col("symbol").isNotNull() & F.col("day").isNotNull()
    before = Window.partitionBy("dataset", "symbol").orderBy("day")
    last, was = F.lag("day").over(before), F.lag("close").over(before)
    weekdays = lambda d: F.datediff(d, F.lit("1899-12-31").cast("date")) - 2 * F.floor(F.datediff(d, F.lit("1899-12-31").cast("date")) / 7) - F.when(F.dayofweek(d) == 7, 1).otherwise(0)
    own = F.when(F.weekday("day") < 5, 1).otherwise(0)
    days = days.withColumns({"missing": F.when(known & last.isNotNull(), weekdays(F.col("day")) - weekdays(last) - own).otherwise(0), "outlier": known & F.coalesce(F.round(F.abs(F.col("close") / F.nullif(was, F.lit(0.0)) - 1), 9) > OUTLIER, F.lit(False))})
    out = days.groupBy("dataset").agg(
        F.sum("n").alias("row_count"), F.count_distinct("symbol").alias("symbols"), F.sum(F.when(known, F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum("missing").cast("long").alias("missing_days"),
        F.count_if("outlier").alias("outliers"), F.sum("errors").alias("errors"), F.sum("adjusted").alias("corporate_actions_applied"),
    )
    return out.withColumn("passed", F.col("duplicates") + F.col("missing_days") + F.col("outliers") + F.col("errors") == 0)


def adjusted(rows: DataFrame) -> DataFrame:
    """rows with the four prices times their factor."""
    return rows.withColumns({c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")})


def factored(rows: DataFrame) -> DataFrame:
    """rows with the factor of splits: 0.5 before 1995 and 0.8 before 1997 for symbols of odd number, 1 for others."""
    odd = F.substring("symbol", 2, 20).cast("long") % 2 == 1
    return rows.withColumn("factor", F.when(~odd, 1.0).when(F.col("day") < "1995-01-01", 0.5).when(F.col("day") < "1997-01-01", 0.8).otherwise(1.0))


def source_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of the two sources as datasets."""
    return dataset_quality(factored(observations(spark, sf_dir)).withColumnRenamed("source", "dataset"))


def adjusted_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20/50 run on adjusted prices by symbol, with what holding returned; symbols of one bar have none."""
    rows = adjusted(factored(bars(spark, sf_dir))).withColumn("have", F.count("*").over(Window.partitionBy("symbol"))).where("have > 1")
    figures = metrics(backtest(signalled(rows, {"ma_20_50": ma_signal(20, 50), "hold": hold_signal()})))
    held = F.max(F.when(F.col("run") == "hold", F.col("total_percent"))).over(Window.partitionBy("symbol"))
    return figures.withColumn("hold_percent", held).where("run = 'ma_20_50'").select("symbol", "bars", "trades", "total_percent", "max_drawdown_percent", "sharpe", "turnover", "hold_percent")


def diversity(members: DataFrame) -> DataFrame:
    """Of each portfolio (members: portfolio, symbol, sector, source, first, last, held, liquidity, one row a symbol): equal
    weight, counts and greatest weight by sector and by primary source, the common coverage, rows held for corporate
    actions, and the least liquidity. A null sector or source counts as `unknown`; sectors and sources are few."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit("unknown")).alias("value")) for c in ("sector", "source"))))
    counted = members.select("portfolio", "first", "last", "held", "liquidity", each.alias("x")).groupBy("portfolio", "x.kind", "x.value").agg(
        F.count("*").alias("n"), F.max("first").alias("first"), F.min("last").alias("last"), F.sum("held").alias("held"), F.min("liquidity").alias("liquidity")
    )
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    text = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(of(kind, F.struct("value", "n")))), lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",")
    n = F.sum(of("sector", F.col("n")))
    share = lambda kind: F.round(F.max(of(kind, F.col("n"))) / n * 100, 4)
    return counted.groupBy("portfolio").agg(
        n.alias("symbols"), F.round(100 / n, 4).alias("equal_weight"), text("sector").alias("sector_counts"), share("sector").alias("most_of_a_sector"), text("source").alias("source_counts"), share("source").alias("most_of_a_source"),
        F.max("first").alias("common_start"), F.min("last").alias("common_end"), F.sum(of("sector", F.col("held"))).alias("held_rows"), r6(F.min("liquidity")).alias("least_liquidity"),
    )


def portfolio_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios are the suppliers of a balance band, sectors their nations; the primary source is the return flag of most
    of a supplier's lines, held rows are its returned ones, liquidity the share of lines of 10 units or more."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count_if(F.col("l_quantity") >= 10).alias("liquid"))
    own = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.min_by("l_returnflag", F.struct(-F.col("n"), F.col("l_returnflag"))).alias("source"), F.to_date(F.min("first")).alias("first"), F.to_date(F.max("last")).alias("last"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("n")).otherwise(0)).alias("held"), (F.sum("liquid") / F.sum("n")).alias("liquidity")
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sector"))
    members = own.join(table(spark, sf_dir, "supplier"), "s_suppkey").join(F.broadcast(nation), "s_nationkey")  # 25 nations
    return diversity(members.withColumn("portfolio", F.floor(F.col("s_acctbal") / 1000).cast("long")).withColumnRenamed("s_suppkey", "symbol"))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def certified(providers: DataFrame, requested: DataFrame, quotes: DataFrame, history: DataFrame, again: DataFrame) -> DataFrame:
    """provider, check, passed and failures: all checks of every provider; it may be activated if all pass.

    providers: provider, licensing, capabilities (array), trust. requested: symbol, each to be had from all. quotes:
    provider, asked, symbol, at, now, latency_ms, stale, trust, one for each that was asked; a null `at` or symbol is a
    fault of its check, and no latency at all one of its. history and again: provider, symbol, place, at, close, two
    readings of the same bars in order of place, which must be one list; a symbol fails once whatever it has wrong. What
    nobody requested counts for nothing."""
    wanted = requested.distinct()
    all_wanted = wanted.agg(F.count("symbol")).scalar()
    stale = F.col("at").isNull() | F.col("now").isNull() | (F.abs(_micros("now") - _micros("at")) > MOST_AGE * 1_000_000) | F.coalesce("stale", F.lit(False))
    quoted = quotes.join(wanted.withColumnRenamed("symbol", "asked"), "asked", "left_semi").groupBy("provider").agg(
        F.count_if(~F.col("asked").eqNullSafe(F.col("symbol"))).alias("quote_schema"), F.count_if(stale).alias("freshness"), F.count_distinct("asked").alias("answered"),
        F.count_if(F.col("at").isNull() | ~F.col("trust").eqNullSafe(TRUSTED)).alias("quote_timestamp_provenance"), F.when(F.count("latency_ms") > 0, F.count_if(F.col("latency_ms") > MOST_LATENCY)).alias("latency"),
    )
    place = Window.partitionBy("provider", "symbol").orderBy("place")
    first = history.join(wanted, "symbol", "left_semi").withColumn("back", F.col("at") < F.lag("at").over(place)).groupBy("provider", "symbol").agg(F.count_if("back").alias("back"), (F.count("at") - F.count_distinct("at")).alias("repeated"))
    readings = history.withColumn("side", F.lit(1)).unionByName(again.withColumn("side", F.lit(-1))).join(wanted, "symbol", "left_semi")
    apart = readings.groupBy("provider", "symbol", "place", "at", "close").agg(F.sum("side").alias("rest")).where("rest <> 0").select("provider", "symbol").distinct().withColumn("differs", F.lit(True))
    past = first.join(apart, ["provider", "symbol"], "left").groupBy("provider").agg(F.count("*").alias("had"), F.count_if(F.col("back") > 0).alias("event_ordering"), F.count_if(F.col("repeated") > 0).alias("duplicate_handling"), F.count_if("differs").alias("historical_consistency"))
    lacks = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, CAPABILITIES)), "capabilities")), F.lit(len(CAPABILITIES)))
    own = providers.select("provider", (~F.col("licensing").eqNullSafe("licensed")).cast("int").alias("licensed_for_operational_use"), lacks.alias("required_capabilities"), (~F.col("trust").eqNullSafe(TRUSTED)).cast("int").alias("timestamp_provenance"))
    wide = own.join(quoted, "provider", "left").join(past, "provider", "left").fillna(1, ["latency"]).fillna(0)
    missing = {"missing_updates": all_wanted - F.col("answered"), "symbol_coverage": all_wanted - F.col("had"), "historical_coverage": all_wanted - F.col("had")}
    wide = wide.withColumns(missing)
    rows = wide.select("provider", F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("failures")) for c in CHECKS))).alias("x")).select("provider", "x.*")
    return rows.select("provider", "check", (F.col("failures") == 0).alias("passed"), "failures", (F.max("failures").over(Window.partitionBy("provider")) == 0).alias("activation_allowed"))


def provider_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as providers, users as 40 symbols, of which the last quote counts; the second reading differs in one
    of 907 rows of errors, and clicks alone are in order and without repeats."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("symbol"), "event_id", "ts", "value")
    size = F.length("provider")
    have = lambda *names: F.array(*map(F.lit, names))
    providers = events.select("provider").distinct().select("provider", F.when(size == 4, "unlicensed").otherwise("licensed").alias("licensing"), F.when(size > 5, have(*CAPABILITIES[:3])).otherwise(have(*CAPABILITIES, "streaming")).alias("capabilities"), F.when(size == 8, "received").otherwise(TRUSTED).alias("trust"))
    requested = events.select("symbol").distinct()
    last = events.groupBy("provider", F.col("symbol").alias("asked")).agg(F.max_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("x")).select("provider", "asked", "x.*")
    k = lambda n: F.col("event_id") % n
    quotes = last.where(k(29) != 0).select(
        "provider", "asked", F.when(k(31) == 0, "other").otherwise(F.col("asked")).alias("symbol"), F.when(k(37) != 0, F.col("ts")).alias("at"), F.timestamp_add("SECOND", k(32), F.col("ts")).alias("now"), k(2010).alias("latency_ms"),
        (k(23) == 0).alias("stale"), F.when(k(19) == 0, "received").otherwise(TRUSTED).alias("trust"),
    )
    tidy = F.col("provider") == "click"
    at = F.when(tidy, F.timestamp_seconds("event_id")).otherwise(F.date_trunc("minute", F.when(k(211) == 0, F.timestamp_add("MINUTE", F.lit(-10), F.col("ts"))).otherwise(F.col("ts"))))
    history = events.select("provider", "symbol", F.col("event_id").alias("place"), at.alias("at"), F.col("value").alias("close"))
    again = history.withColumn("close", F.when((F.col("provider") == "error") & (F.col("place") % 907 == 0), F.col("close") + 1).otherwise(F.col("close")))
    return certified(providers, requested, quotes, history, again)


QUERIES = {f.__name__: f for f in (cost_benefit, source_datasets, adjusted_research, portfolio_diversity, provider_certification)}

_FACTOR = "CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 2 <> 1 THEN 1.0::DOUBLE WHEN day < DATE '1995-01-01' THEN 0.5 WHEN day < DATE '1997-01-01' THEN 0.8 ELSE 1.0 END"
_RUNS = _ONE | {"hold": "true"}
_ADJUSTED = f"{BARS_SQL.replace('bars AS', 'raw AS')}, bars AS (SELECT symbol, day, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume, n FROM (SELECT *, {_FACTOR} AS f, count(*) OVER (PARTITION BY symbol) AS have FROM raw) WHERE have > 1)"
_LESS = lambda c, a="m", b="h": f"round(coalesce({a}.{c}, 0) - coalesce({b}.{c}, 0), 6)"
_NONE = " ".join(f"WHEN '{c}' THEN {v}" for c, v in zip(CHECKS, (
    "CAST(licensing <> 'licensed' AS BIGINT)", "lacks", f"CAST(p.trust <> '{TRUSTED}' AS BIGINT)", "uncovered", "quote_schema", "freshness", "missing_updates", "untrusted", "latency", "back", "repeated", "differs", "uncovered",
), strict=True))
ORACLE = {
    "cost_benefit": f"""WITH f AS MATERIALIZED ({_curve_sql(_RUNS) + _METRICS_SQL}),
x AS (WITH {BARS_SQL}, b AS (SELECT bars.*, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn, trunc({CAPITAL} * (exposure_percent / 100) / (open * (1 + {SLIPPAGE}::DOUBLE) * (1 + {FEE}::DOUBLE))) AS size FROM bars JOIN f USING (symbol) WHERE run <> 'hold'),
  c AS (SELECT *, min(CASE WHEN rn > 1 AND size > 0 AND volume >= size THEN rn END) OVER (PARTITION BY symbol) AS entry FROM b),
  e AS (SELECT *, CASE WHEN rn = entry THEN size ELSE 0 END AS traded, CASE WHEN rn = entry THEN open * (1 + {SLIPPAGE}::DOUBLE) ELSE 0.0::DOUBLE END AS fill FROM c),
  curve AS (SELECT 'matched' AS run, symbol, day, rn, open, rn >= entry AS desired, CASE WHEN rn = entry THEN 'buy' END AS side, traded, fill, traded * fill * {FEE}::DOUBLE AS fee, {CAPITAL} - sum(traded * fill + traded * fill * {FEE}::DOUBLE) OVER w + sum(traded) OVER w * close AS equity FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)){_METRICS_SQL}),
m AS (SELECT * FROM f WHERE run <> 'hold'), h AS (SELECT * FROM f WHERE run = 'hold'),
a AS (SELECT symbol, round(abs(h.max_drawdown_percent) - abs(m.max_drawdown_percent), 6) AS avoided FROM m JOIN h USING (symbol))
SELECT m.symbol, {_LESS('total_percent', 'h', 'm')} AS return_sacrificed, avoided AS drawdown_avoided, round({_LESS('total_percent', 'h', 'm')} / nullif(avoided, 0), 6) AS sacrificed_per_point,
  {", ".join(f"{_LESS(c)} AS {name}_difference" for c, name in (("annual_percent", "annual"), ("volatility_percent", "volatility"), ("sharpe", "sharpe"), ("sortino", "sortino"), ("calmar", "calmar"), ("exposure_percent", "exposure"), ("turnover", "turnover")))},
  {_LESS('fees')} AS additional_fees, {_LESS('slippage')} AS additional_slippage, {_LESS('total_percent', 'm', 'x')} AS return_over_matched, round(abs(x.max_drawdown_percent) - abs(m.max_drawdown_percent), 6) AS drawdown_below_matched, {_LESS('sharpe', 'm', 'x')} AS sharpe_over_matched
FROM m JOIN h ON h.symbol = m.symbol JOIN x ON x.symbol = m.symbol JOIN a ON a.symbol = m.symbol""",
    "source_datasets": f"""WITH {BARS_SQL}, {SOURCES_SQL}, r AS (SELECT source AS dataset, *, {_FACTOR} AS factor, least(open, low, close) <= 0 OR low > least(open, close) OR high < greatest(open, close) AS bad FROM observations),
d AS (SELECT dataset, symbol, day, count(*) AS n, count(*) FILTER (bad) AS errors, count(*) FILTER (factor <> 1) AS adjusted, min(close) AS close FROM r GROUP BY dataset, symbol, day),
b AS (SELECT *, lag(day) OVER w AS last, lag(close) OVER w AS was FROM d WINDOW w AS (PARTITION BY dataset, symbol ORDER BY day)),
g AS (SELECT *, (SELECT count(*) FROM generate_series(last + 1, day - 1, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS missing FROM b),
q AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS row_count, count(DISTINCT symbol) AS symbols, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(missing) AS BIGINT) AS missing_days, count(*) FILTER (round(abs(close / nullif(was, 0) - 1), 9) > {OUTLIER}) AS outliers, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(adjusted) AS BIGINT) AS corporate_actions_applied FROM g GROUP BY dataset)
SELECT *, duplicates + missing_days + outliers + errors = 0 AS passed FROM q""",
    "adjusted_research": f"""WITH f AS MATERIALIZED ({(_curve_sql(_RUNS) + _METRICS_SQL).replace(BARS_SQL, _ADJUSTED)}) SELECT symbol, m.bars, m.trades, m.total_percent, m.max_drawdown_percent, m.sharpe, m.turnover, h.total_percent AS hold_percent FROM f m JOIN f h USING (symbol) WHERE m.run <> 'hold' AND h.run = 'hold'""",
    "portfolio_diversity": """WITH n AS (SELECT l_suppkey AS symbol, l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT symbol, first(source ORDER BY n DESC, source) AS source FROM n GROUP BY symbol),
l AS (SELECT l_suppkey AS symbol, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last, count(*) FILTER (l_returnflag = 'R') AS held, avg(CAST(l_quantity >= 10 AS DOUBLE)) AS liquidity FROM lineitem GROUP BY 1),
m AS (SELECT CAST(floor(s_acctbal / 1000) AS BIGINT) AS portfolio, symbol, n_name AS sector, source, first, last, held, liquidity FROM l JOIN s USING (symbol) JOIN supplier ON s_suppkey = symbol JOIN nation ON n_nationkey = s_nationkey),
a AS (SELECT portfolio, string_agg(sector || ':' || n, ',' ORDER BY sector) AS sector_counts, max(n) AS most FROM (SELECT portfolio, sector, count(*) AS n FROM m GROUP BY ALL) GROUP BY portfolio),
b AS (SELECT portfolio, string_agg(source || ':' || n, ',' ORDER BY source) AS source_counts, max(n) AS most FROM (SELECT portfolio, source, count(*) AS n FROM m GROUP BY ALL) GROUP BY portfolio)
SELECT portfolio, count(*) AS symbols, round(100 / count(*), 4) AS equal_weight, any_value(sector_counts) AS sector_counts, round(any_value(a.most) / count(*) * 100, 4) AS most_of_a_sector, any_value(source_counts) AS source_counts, round(any_value(b.most) / count(*) * 100, 4) AS most_of_a_source,
  max(first) AS common_start, min(last) AS common_end, CAST(sum(held) AS BIGINT) AS held_rows, round(min(liquidity), 6) AS least_liquidity FROM m JOIN a USING (portfolio) JOIN b USING (portfolio) GROUP BY portfolio""",
    "provider_certification": f"""WITH e AS (SELECT event_type AS provider, 'S' || user_id % 40 AS symbol, event_id, ts, value FROM events),
p AS (SELECT DISTINCT provider, CASE length(provider) WHEN 4 THEN 'unlicensed' ELSE 'licensed' END AS licensing, CASE WHEN length(provider) > 5 THEN 1 ELSE 0 END AS lacks, CASE length(provider) WHEN 8 THEN 'received' ELSE '{TRUSTED}' END AS trust FROM e),
a AS (SELECT provider, symbol FROM p, (SELECT DISTINCT symbol FROM e)),
l AS (SELECT provider, symbol, max_by(event_id, (ts, event_id)) AS k FROM e GROUP BY ALL), q AS (SELECT * FROM l WHERE k % 29 <> 0),
h AS (SELECT provider, symbol, event_id AS place, CASE WHEN provider = 'click' THEN make_timestamp(event_id * 1000000) ELSE date_trunc('minute', CASE WHEN event_id % 211 = 0 THEN ts - INTERVAL 10 MINUTE ELSE ts END) END AS moment FROM e),
b AS (SELECT *, moment < lag(moment) OVER (PARTITION BY provider, symbol ORDER BY place) AS early FROM h),
s AS (SELECT provider, symbol, count(*) FILTER (early) AS back, count(*) - count(DISTINCT moment) AS repeated, provider = 'error' AND count(*) FILTER (place % 907 = 0) > 0 AS differs FROM b GROUP BY provider, symbol),
w AS (SELECT a.provider, count(*) FILTER (q.k % 31 = 0) AS quote_schema, count(*) FILTER (q.k % 37 = 0 OR q.k % 32 > {MOST_AGE} OR q.k % 23 = 0) AS freshness, count(*) FILTER (q.k IS NULL) AS missing_updates, count(*) FILTER (q.k % 37 = 0 OR q.k % 19 = 0) AS untrusted, CASE WHEN count(q.k) = 0 THEN 1 ELSE count(*) FILTER (q.k % 2010 > {MOST_LATENCY}) END AS latency,
  count(*) FILTER (s.back IS NULL) AS uncovered, count(*) FILTER (s.back > 0) AS back, count(*) FILTER (s.repeated > 0) AS repeated, count(*) FILTER (s.differs) AS differs FROM a LEFT JOIN q ON q.provider = a.provider AND q.symbol = a.symbol LEFT JOIN s ON s.provider = a.provider AND s.symbol = a.symbol GROUP BY a.provider),
r AS (SELECT provider, "check", CASE "check" {_NONE} END AS failures FROM p JOIN w USING (provider), (SELECT unnest({list(CHECKS)}) AS "check"))
SELECT provider, "check", failures = 0 AS passed, CAST(failures AS BIGINT) AS failures, max(failures) OVER (PARTITION BY provider) = 0 AS activation_allowed FROM r""",
}
