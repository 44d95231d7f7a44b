"""Unusual activity: ten features of a bar against its last 60 predecessors, an attention score, and breadth."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, r6, ratio, severity, severity_sql
from tapeline.sources.bars import BARS_SQL, bars

TRAILING, LEAST_HISTORY = 60, 40
MIDDLES, DEVIATIONS = ("daily_return", "volume", "trades", "value", "move"), ("daily_return", "volume")
_ROWS = 4096
# Thresholds and points of the attention score.
RETURN_STEPS, GAP_STEPS, RANGE_STEPS = ((5, 1), (7.5, 2), (10, 3)), ((3, 1), (5, 2)), ((5, 1), (8, 2))
MULTIPLE_STEPS, Z_STEPS, EXPANSION_STEPS = ((2, 1), (5, 2), (10, 3)), ((3, 1), (4, 2), (5, 3)), ((2, 1), (3, 2), (5, 3))
WATCH, HIGH = 4, 8


def _middle(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of each row's n values, which come first in ascending order."""
    at = np.arange(len(n))
    low, high = values[at, np.maximum(n - 1, 0) // 2], values[at, np.minimum(n // 2, values.shape[1] - 1)]
    return np.where(low == high, low, 0.5 * low + 0.5 * high)


def _behind(batch: pa.RecordBatch, first: int, last: int) -> dict[str, np.ndarray]:
    """For the rows first to last of a batch: of each of MIDDLES how many of the TRAILING rows before it have a value (n_),
    their median (m_) and, of DEVIATIONS, their median absolute deviation (d_); greatest high and least low. A row looks
    back no further than its symbol goes."""
    begin = max(first - TRAILING, 0)
    reach = np.minimum(np.asarray(batch.column("i").slice(first, last - first)) - 1, TRAILING)
    far = np.arange(TRAILING, 0, -1)  # so many rows back
    own = far[None, :] <= reach[:, None]

    def windows(name: str) -> np.ndarray:
        values = batch.column(name).slice(begin, last - begin).to_numpy(zero_copy_only=False)
        padded = np.concatenate([np.full(TRAILING - (first - begin), np.nan), values])
        return np.where(own, np.lib.stride_tricks.sliding_window_view(padded, TRAILING)[: last - first], np.nan)

    def known(name: str) -> np.ndarray:
        column = batch.column(name).slice(begin, last - begin)
        if not column.null_count:
            return reach
        padded = np.concatenate([np.zeros(TRAILING - (first - begin), bool), column.is_valid().to_numpy(zero_copy_only=False)])
        return (own & np.lib.stride_tricks.sliding_window_view(padded, TRAILING)[: last - first]).sum(1)

    out = {"top": np.fmax.reduce(windows("high"), 1), "bottom": np.fmin.reduce(windows("low"), 1)}
    for name in MIDDLES:
        values, n = np.sort(windows(name), 1), known(name)  # what is missing sorts last
        out[f"n_{name}"], out[f"m_{name}"] = n, _middle(values, n)
        if name in DEVIATIONS:
            off = np.sort(np.abs(values - out[f"m_{name}"][:, None]), 1)
            at = np.arange(len(n))
            out[f"d_{name}"] = (off[at, np.maximum((n + 1) // 2 - 1, 0)] + off[at, np.minimum(n // 2, TRAILING - 1)]) / 2
    return out


def with_history(rows: DataFrame) -> DataFrame:
    """rows with i, a row's number in its symbol, and what _behind() says of the TRAILING rows before it.

    A symbol's rows are one sorted stream, by numpy and with the last TRAILING rows kept between batches: a median that
    moves with the row would sort its window anew for each row and column in Spark's window functions."""
    more = ["top", "bottom", *(f"{p}_{c}" for c in MIDDLES for p in ("n", "m")), *(f"d_{c}" for c in DEVIATIONS)]
    types = {c: "int" if c.startswith("n_") else "double" for c in more}
    rows = rows.withColumn("i", F.row_number().over(by_day()))  # and so whole symbols in a task, in order of days
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} {t}" for c, t in types.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            first = kept.num_rows if kept is not None else 0
            held = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0] if first and batch.num_rows else batch
            if not batch.num_rows:
                continue
            for at in range(first, held.num_rows, _ROWS):
                end = min(at + _ROWS, held.num_rows)
                found = _behind(held, at, end)
                columns = [pa.array(found[c].astype(np.int32 if t == "int" else np.float64)) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays([*held.slice(at, end - at).columns, *columns], [*batch.schema.names, *more])
            kept = held.slice(max(held.num_rows - TRAILING, 0))

    return rows.repartition("symbol").sortWithinPartitions("symbol", "day").mapInArrow(run, schema)


def multiple(column: str) -> Column:
    """The value over the median of the bars before; null with too short a history or a median of 0."""
    return F.when(F.col(f"n_{column}") >= LEAST_HISTORY, ratio(F.col(column), F.col(f"m_{column}")))


def robust_z(column: str) -> Column:
    """0.6745 (x - median) / MAD over the bars before; 0 for a MAD of 0 at the median itself, else null there."""
    middle, mad = F.col(f"m_{column}"), F.when(F.col(f"n_{column}") >= LEAST_HISTORY, F.col(f"d_{column}"))
    return F.when(mad != 0, F.lit(0.6745) * (F.col(column) - middle) / F.nullif(mad, F.lit(0.0))).when((mad == 0) & (F.col(column) == middle), 0.0)


def features(series: DataFrame) -> DataFrame:
    """features_of the bars that have a predecessor and a positive volume, others count in no history."""
    return features_of(series.withColumn("was", F.lag("close").over(by_day())).where("was > 0 and volume > 0"))


def features_of(rows: DataFrame) -> DataFrame:
    """symbol, day and the ten features of usable rows with the close before them as `was`; null means unavailable,
    `status` says why."""
    rows = rows.select(
        "symbol", "day", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), F.col("n").cast("double").alias("trades"), (F.col("close") * F.col("volume")).alias("value"),
        ((F.col("close") - F.col("was")) / F.col("was") * 100).alias("daily_return"), ((F.col("open") - F.col("was")) / F.col("was") * 100).alias("opening_gap"), ((F.col("high") - F.col("low")) / F.col("was") * 100).alias("intraday_range"),
    ).withColumn("move", F.abs("daily_return"))
    rows = with_history(rows)
    enough = F.col("i") > LEAST_HISTORY
    breakout = F.when(~enough, F.lit(None)).when((F.col("close") > F.col("top")) & ~F.isnan("top"), "HIGH").when((F.col("close") < F.col("bottom")) & ~F.isnan("bottom"), "LOW").otherwise("NONE")
    return rows.select(
        "symbol", "day", "daily_return", "opening_gap", "intraday_range", multiple("volume").alias("volume_multiple"), multiple("trades").alias("trades_multiple"), multiple("value").alias("value_multiple"),
        robust_z("daily_return").alias("return_z"), robust_z("volume").alias("volume_z"), multiple("move").alias("expansion"), breakout.alias("breakout"), F.when(enough, "AVAILABLE").otherwise("INSUFFICIENT_HISTORY").alias("status"),
    )


def components() -> dict[str, tuple[Column, tuple]]:
    """The value of each feature of a row of features and its thresholds with points, by the feature's name in reports."""
    fixed = lambda c: F.round(c, 9)  # noqa: E731  thresholds are met exactly or not at all
    steps = {
        "daily_return_pct": (F.abs("daily_return"), RETURN_STEPS), "opening_gap_pct": (F.abs("opening_gap"), GAP_STEPS), "intraday_range_pct": (F.col("intraday_range"), RANGE_STEPS),
        "volume_multiple": (F.col("volume_multiple"), MULTIPLE_STEPS), "trade_count_multiple": (F.col("trades_multiple"), MULTIPLE_STEPS), "traded_value_multiple": (F.col("value_multiple"), MULTIPLE_STEPS),
        "robust_return_z": (F.abs("return_z"), Z_STEPS), "robust_volume_z": (F.abs("volume_z"), Z_STEPS), "volatility_expansion": (F.col("expansion"), EXPANSION_STEPS),
    }
    return {name: (fixed(value), points) for name, (value, points) in steps.items()}


def with_points(rows: DataFrame) -> DataFrame:
    """rows of features with the points of each in points_ and its name in reports; each value is rounded once."""
    values = components()
    rows = rows.withColumns({f"_{name}": value for name, (value, _) in values.items()})
    points = {name: severity(F.col(f"_{name}"), *steps) for name, (_, steps) in values.items()} | {"recent_high_low_breakout": F.when(F.col("breakout").isin("HIGH", "LOW"), 1).otherwise(0)}
    return rows.withColumns({f"points_{name}": p for name, p in points.items()}).drop(*(f"_{name}" for name in values))


def scored(rows: DataFrame) -> DataFrame:
    """rows of features with points, score and label."""
    label = F.when(F.col("status") != "AVAILABLE", F.col("status")).when(F.col("score") >= HIGH, "HIGH_ATTENTION").when(F.col("score") >= WATCH, "WATCH").otherwise("NORMAL")
    rows = with_points(rows)
    return rows.withColumn("score", reduce(add, (F.col(c) for c in rows.columns if c.startswith("points_")))).withColumn("label", label)


def anomaly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(bars(spark, sf_dir))
    return rows.select("symbol", "day", *(r6(c).alias(c) for c in rows.columns[2:11]), "breakout", "status")


def anomaly_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 bars of highest score, by score, day and symbol."""
    rows = scored(features(bars(spark, sf_dir))).where("status = 'AVAILABLE'")
    return rows.orderBy(F.desc("score"), "day", "symbol").limit(20).select("symbol", "day", "score", "label")


def anomaly_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(features(bars(spark, sf_dir))).groupBy("symbol", "label").agg(F.count("*").alias("bars"), F.sum("score").alias("points"))


def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day: symbols up, down and unchanged, median return, and whether most advance."""
    rows = bars(spark, sf_dir).select("day", (ratio(F.col("close"), F.lag("close").over(by_day())) - 1).alias("ret")).where("ret is not null")
    out = rows.groupBy("day").agg(F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.col("ret") < 0).alias("down"), F.count_if(F.col("ret") == 0).alias("unchanged"), r6(F.median("ret")).alias("median_return"), F.count("*").alias("n"))
    return out.select("day", "up", "down", "unchanged", "median_return", F.when(F.col("n") < 3, "too_few").when(F.col("up") > F.col("down"), "advancing").when(F.col("up") < F.col("down"), "declining").otherwise("mixed").alias("label"))


def sector_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' trade by nation as sectors: members, share above the overall median, median; three members at least."""
    supplier, nation, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "lineitem"))
    value = line.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("value"))
    rows = value.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey").join(nation.select("n_nationkey", "n_name"), "n_nationkey")
    middle = value.agg(F.median("value"))
    return rows.groupBy(F.col("n_name").alias("sector")).agg(F.count("*").alias("members"), r6(F.avg((F.col("value") > middle.scalar()).cast("double"))).alias("share_above"), r6(F.median("value")).alias("median_value")).where("members >= 3")


def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point in time: what was known of each customer's nation by an order's date, by tier of the evidence.

    Evidence is available from the later of publication and observation, so that nothing later is used."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("code"), F.greatest(F.to_date("ts"), F.date_add(F.to_date("ts"), (F.col("event_id") % 3).cast("int"))).alias("available"), F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("event_id") % 5 + 1).cast("int")).alias("tier"))
    since = events.groupBy("code").agg(*(F.min(F.when(F.col("tier") == t, F.col("available"))).alias(t) for t in "ABCDE"))
    days = events.select("available").distinct().agg(F.array_sort(F.collect_list("available")))  # as many as there are days
    known = since.withColumn("as_of", F.explode(days.scalar())).where(F.least(*"ABCDE") <= F.col("as_of"))
    any_of = lambda *tiers: F.coalesce(F.least(*tiers) if len(tiers) > 1 else F.col(tiers[0]), F.lit("9999-12-31").cast("date")) <= F.col("as_of")
    status = F.when(any_of("A", "B"), "OFFICIAL_EVENT_PRESENT").when(any_of("C", "D"), "CORROBORATING_EVENT_PRESENT").when(any_of("E"), "RUMOUR_ONLY_INVESTIGATE").otherwise("NO_EXPLANATION_FOUND")
    return known.select("code", "as_of", status.alias("status"))


QUERIES = {f.__name__: f for f in (anomaly_features, anomaly_attention, anomaly_labels, market_breadth, sector_breadth, event_context)}

_MULT = lambda c: f"CASE WHEN count({c}) OVER p >= {LEAST_HISTORY} THEN {c} / nullif(quantile_cont({c}, 0.5) OVER p, 0) END"
_PRIOR_CLOSE = f"{BARS_SQL}, l AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS was FROM bars)"
_FEATURES_OF = f"""u AS (SELECT symbol, day, open, high, low, close, CAST(volume AS DOUBLE) AS volume, CAST(n AS DOUBLE) AS trades, close * volume AS value, (close - was) / was * 100 AS daily_return, (open - was) / was * 100 AS opening_gap, (high - low) / was * 100 AS intraday_range, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM l WHERE was > 0 AND volume > 0),
m AS (SELECT *, abs(daily_return) AS move FROM u),
k AS (SELECT *, count(*) OVER p AS history, {_MULT('volume')} AS volume_multiple, {_MULT('trades')} AS trades_multiple, {_MULT('value')} AS value_multiple, {_MULT('move')} AS expansion,
  quantile_cont(daily_return, 0.5) OVER p AS med_r, quantile_cont(volume, 0.5) OVER p AS med_v, max(high) OVER p AS top, min(low) OVER p AS bottom FROM m WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {TRAILING} PRECEDING AND 1 PRECEDING)),
mad AS (SELECT a.symbol, a.day, median(abs(b.daily_return - a.med_r)) AS mad_r, median(abs(b.volume - a.med_v)) AS mad_v FROM k a JOIN k b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - {TRAILING} AND a.rn - 1 GROUP BY ALL),
f AS (SELECT k.symbol, k.day, daily_return, opening_gap, intraday_range, volume_multiple, trades_multiple, value_multiple,
  CASE WHEN history < {LEAST_HISTORY} THEN NULL WHEN mad_r <> 0 THEN 0.6745 * (daily_return - med_r) / mad_r WHEN daily_return = med_r THEN 0.0 END AS return_z,
  CASE WHEN history < {LEAST_HISTORY} THEN NULL WHEN mad_v <> 0 THEN 0.6745 * (volume - med_v) / mad_v WHEN volume = med_v THEN 0.0 END AS volume_z, expansion,
  CASE WHEN history < {LEAST_HISTORY} THEN NULL WHEN close > top THEN 'HIGH' WHEN close < bottom THEN 'LOW' ELSE 'NONE' END AS breakout, CASE WHEN history >= {LEAST_HISTORY} THEN 'AVAILABLE' ELSE 'INSUFFICIENT_HISTORY' END AS status FROM k LEFT JOIN mad ON k.symbol = mad.symbol AND k.day = mad.day)"""
_FEATURES = f"WITH {_PRIOR_CLOSE}, {_FEATURES_OF}"
_R9 = lambda c: f"round({c}, 9)"
_COMPONENTS = {
    "daily_return_pct": severity_sql(_R9("abs(daily_return)"), *RETURN_STEPS), "opening_gap_pct": severity_sql(_R9("abs(opening_gap)"), *GAP_STEPS), "intraday_range_pct": severity_sql(_R9("intraday_range"), *RANGE_STEPS),
    "volume_multiple": severity_sql(_R9("volume_multiple"), *MULTIPLE_STEPS), "trade_count_multiple": severity_sql(_R9("trades_multiple"), *MULTIPLE_STEPS), "traded_value_multiple": severity_sql(_R9("value_multiple"), *MULTIPLE_STEPS),
    "robust_return_z": severity_sql(_R9("abs(return_z)"), *Z_STEPS), "robust_volume_z": severity_sql(_R9("abs(volume_z)"), *Z_STEPS), "volatility_expansion": severity_sql(_R9("expansion"), *EXPANSION_STEPS),
    "recent_high_low_breakout": "CASE WHEN breakout IN ('HIGH', 'LOW') THEN 1 ELSE 0 END",
}
_SCORE = " + ".join(_COMPONENTS.values())
_LABEL = f"CASE WHEN status <> 'AVAILABLE' THEN status WHEN score >= {HIGH} THEN 'HIGH_ATTENTION' WHEN score >= {WATCH} THEN 'WATCH' ELSE 'NORMAL' END"
_SCORED = f"{_FEATURES}, s AS (SELECT *, {_SCORE} AS score FROM f)"
ORACLE = {
    "anomaly_features": f"{_FEATURES} SELECT symbol, day, " + ", ".join(f"round({c}, 6) AS {c}" for c in "daily_return opening_gap intraday_range volume_multiple trades_multiple value_multiple return_z volume_z expansion".split()) + ", breakout, status FROM f",
    "anomaly_attention": f"{_SCORED} SELECT symbol, day, score, {_LABEL} AS label FROM s WHERE status = 'AVAILABLE' ORDER BY score DESC, day, symbol LIMIT 20",
    "anomaly_labels": f"{_SCORED} SELECT symbol, {_LABEL} AS label, count(*) AS bars, CAST(sum(score) AS BIGINT) AS points FROM s GROUP BY ALL",
    "market_breadth": f"""WITH {BARS_SQL}, r AS (SELECT day, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS ret FROM bars), b AS (SELECT day, count(*) FILTER (ret > 0) AS up, count(*) FILTER (ret < 0) AS down, count(*) FILTER (ret = 0) AS unchanged, round(median(ret), 6) AS median_return, count(*) AS n FROM r WHERE ret IS NOT NULL GROUP BY day)
      SELECT day, up, down, unchanged, median_return, CASE WHEN n < 3 THEN 'too_few' WHEN up > down THEN 'advancing' WHEN up < down THEN 'declining' ELSE 'mixed' END AS label FROM b""",
    "sector_breadth": """WITH v AS (SELECT l_suppkey, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1) SELECT n_name AS sector, count(*) AS members, round(avg(CAST(value > (SELECT median(value) FROM v) AS DOUBLE)), 6) AS share_above, round(median(value), 6) AS median_value
      FROM v JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name HAVING count(*) >= 3""",
    "event_context": """WITH e AS (SELECT user_id % 50 AS code, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS available, substr('ABCDE', CAST(event_id % 5 + 1 AS INT), 1) AS tier FROM events), f AS (SELECT code, tier, min(available) AS since FROM e GROUP BY ALL),
      k AS (SELECT code, as_of, string_agg(DISTINCT tier, '') AS tiers FROM f JOIN (SELECT DISTINCT available AS as_of FROM e) d ON since <= as_of GROUP BY ALL)
      SELECT code, as_of, CASE WHEN tiers LIKE '%A%' OR tiers LIKE '%B%' THEN 'OFFICIAL_EVENT_PRESENT' WHEN tiers LIKE '%C%' OR tiers LIKE '%D%' THEN 'CORROBORATING_EVENT_PRESENT' WHEN tiers LIKE '%E%' THEN 'RUMOUR_ONLY_INVESTIGATE' ELSE 'NO_EXPLANATION_FOUND' END AS status FROM k""",
}
