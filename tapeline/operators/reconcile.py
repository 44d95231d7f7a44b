"""Two sources of one market: classes of agreement, duplicates, pairs, corporate actions and the rows to keep.

Prices of sources are never averaged, and grains (adjusted, unadjusted) are never pooled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import r6, ratio, relative_difference
from tapeline.sources.bars import BARS_SQL, SOURCES_SQL, bars, observations

FIELDS = ("open", "high", "low", "close", "volume")
TOLERANCE, ACTION = 0.001, 0.20
# Points that a ledger row of each class costs.
PENALTIES = {"material_conflict": 30, "missing_primary": 20, "missing_secondary": 20, "invalid_ohlc": 30, "duplicate": 15, "corporate_action_suspected": 10}
# Price ratios that a split makes, and how near they must come.
SPLITS, NEAR = (2, 3, 4, 5, 10), 0.03


def valid(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return (c("low") <= F.least(c("open"), c("close"))) & (c("high") >= F.greatest(c("open"), c("close")))


def compared_sources(rows: DataFrame, primary: str = "A", secondary: str = "B") -> DataFrame:
    """symbol, day, class of each key that either source has. One aggregation per source before the outer join."""
    side = lambda name, short: rows.where(F.col("source") == name).groupBy("symbol", "day").agg(F.count("*").alias(f"{short}_n"), F.min(F.struct(*FIELDS)).alias(short))
    both = side(primary, "p").join(side(secondary, "s"), ["symbol", "day"], "full_outer")
    differences = [F.round(relative_difference(F.col(f"p.{f}").cast("double"), F.col(f"s.{f}").cast("double")), 12) for f in FIELDS]
    equal, within = F.lit(True), F.lit(True)
    for d in differences:
        equal, within = equal & (F.coalesce(d, F.lit(0.0)) == 0), within & (F.coalesce(d, F.lit(0.0)) <= TOLERANCE)
    kind = (
        F.when(F.col("p").isNull(), "missing_primary").when(F.col("s").isNull(), "missing_secondary").when((F.col("p_n") > 1) | (F.col("s_n") > 1), "duplicate").when(~valid("p.") | ~valid("s."), "invalid_ohlc")
        .when(equal, "exact_match").when(within, "within_tolerance").when(differences[3] >= ACTION, "corporate_action_suspected").otherwise("material_conflict")
    )
    return both.select("symbol", "day", kind.alias("class"))


def compare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_sources(observations(spark, sf_dir))


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 less the mean penalty, for each symbol, for each month and overall: one pass by grouping sets."""
    penalty = F.lit(0)
    for kind, points in PENALTIES.items():
        penalty = F.when(F.col("class") == kind, points).otherwise(penalty)
    ledger = compared_sources(observations(spark, sf_dir)).select("symbol", F.trunc("day", "MM").alias("month"), penalty.alias("penalty"))
    sums = ledger.groupingSets([[F.col("symbol")], [F.col("month")], []], "symbol", "month").agg(F.sum("penalty").alias("total"), F.count("*").alias("n"))
    return sums.select("symbol", "month", F.greatest(F.lit(0), 100 - F.floor(F.col("total") / F.col("n"))).cast("long").alias("score"))


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in one source alone and in both, by symbol: anti joins and a semi join of distinct keys."""
    rows = observations(spark, sf_dir)
    a, b = (rows.where(F.col("source") == s).select("symbol", "day").distinct() for s in "AB")
    parts = [a.join(b, ["symbol", "day"], "left_anti").withColumn("side", F.lit("left_only")), b.join(a, ["symbol", "day"], "left_anti").withColumn("side", F.lit("right_only")), a.intersect(b).withColumn("side", F.lit("both"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("symbol", "side").agg(F.count("*").alias("keys"))


def fingerprint() -> Column:
    """Digest of a row's values as text, so that equal means textually equal; nulls differ from empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.format_number(F.col(f).cast("double"), 6), F.lit("null")) for f in FIELDS)), 256)


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several rows and what kind of repetition they are."""
    rows = observations(spark, sf_dir).withColumn("fp", fingerprint()).withColumn("prices", F.concat_ws("|", *(F.format_number(F.col(f), 6) for f in FIELDS[:4])))
    groups = rows.groupBy("symbol", "day").agg(F.count("*").alias("rows"), F.count_distinct("fp").alias("fps"), F.count_distinct("grain").alias("grains"), F.count_distinct("prices").alias("prices"), F.count_distinct("volume").alias("volumes"), F.min("row_id").alias("first_id")).where("rows > 1")
    kind = (
        F.when(F.col("grains") > 1, "adjusted_unadjusted_duplicate").when(F.col("fps") == 1, "duplicate_exact").when((F.col("prices") == 1) & (F.col("volumes") > 1), "same_price_different_volume").when(F.col("prices") > 1, "conflicting_ohlc").otherwise("unresolved_conflict")
    )
    return groups.select("symbol", "day", "rows", "fps", "first_id", kind.alias("kind"))


def collapsed(rows: DataFrame) -> DataFrame:
    """One row for each key, grain and fingerprint, that of least row_id, with the ids that it stands for."""
    by = Window.partitionBy("symbol", "day", "grain", "fp")
    rows = rows.withColumn("fp", fingerprint()).withColumn("k", F.row_number().over(by.orderBy("row_id"))).withColumn("stands_for", F.count("*").over(by))
    return rows.where("k = 1").drop("k")


def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(observations(spark, sf_dir)).select("symbol", "day", "grain", "row_id", "stands_for")


def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unordered pair of differing rows of one key, after equal ones are one: differences and tolerance.

    Representatives keep the pairs of a key to those of its distinct values in each source."""
    by = ["symbol", "day", "source", "grain", "fp"]
    rows = observations(spark, sf_dir).withColumn("fp", fingerprint()).groupBy(*by).agg(F.min("row_id").alias("row_id"), *(F.min(f).alias(f) for f in FIELDS))
    a, b = (rows.select("symbol", "day", *(F.col(c).alias(f"{c}_{x}") for c in (*by[2:], "row_id", *FIELDS))) for x in "ab")
    pairs = a.join(b, ["symbol", "day"]).where("row_id_a < row_id_b and not (source_a = source_b and grain_a = grain_b)")
    worst = F.greatest(*(F.round(relative_difference(F.col(f"{f}_a").cast("double"), F.col(f"{f}_b").cast("double")), 12) for f in FIELDS))
    return pairs.select("symbol", "day", "row_id_a", "row_id_b", (F.col("fp_a") == F.col("fp_b")).alias("exact"), r6(F.abs(F.col("close_a") - F.col("close_b"))).alias("close_difference"), r6(worst).alias("worst"), F.when(worst <= TOLERANCE, "within_tolerance").otherwise("outside_tolerance").alias("result"))


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key and grain: rejected if values conflict, else accepted, with the row to use and its sources."""
    rows = observations(spark, sf_dir).withColumn("fp", fingerprint())
    groups = rows.groupBy("symbol", "day", "grain").agg(F.count("*").alias("rows"), F.count_distinct("fp").alias("fps"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(F.struct("row_id", "close")).alias("chosen"))
    status = F.when(F.col("fps") > 1, "rejected_conflict").when(F.size("sources") > 1, "accepted_candidate").when(F.col("rows") > 1, "accepted_exact_deduplicated").otherwise("accepted_single_source_low_confidence")
    taken = F.col("fps") == 1
    return groups.select("symbol", "day", "grain", status.alias("status"), F.concat_ws(",", "sources").alias("sources"), F.when(taken, F.col("chosen.row_id")).alias("row_id"), r6(F.when(taken, F.col("chosen.close"))).alias("close"))


def action_class(previous: Column, current: Column, gap: Column) -> Column:
    """What a move between two closes looks like; bounds on ratios are met on twelve places."""
    change = F.round(F.abs(current / previous - 1), 12)
    size = F.round(F.greatest(previous, current) / F.least(previous, current), 12)
    split = F.lit(False)
    for k in SPLITS:
        split = split | (F.abs(size - k) <= NEAR)
    return F.when(change < ACTION, "ordinary_market_movement").when(gap > 10, "possible_suspension_resumption").when(split, "probable_split").when((size >= 1.2) & (size < 2), "probable_bonus_share_adjustment").otherwise("unresolved")


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring closes of one source and grain that move by a fifth or more, with their class."""
    window = Window.partitionBy("source", "symbol", "grain").orderBy("day")
    first = observations(spark, sf_dir).groupBy("source", "symbol", "grain", "day").agg(F.min(F.struct("row_id", "close")).alias("x")).select("source", "symbol", "grain", "day", F.col("x.close").alias("close"))
    rows = first.withColumn("was", F.lag("close").over(window)).withColumn("gap", F.datediff("day", F.lag("day").over(window))).where("was > 0 and close > 0")
    rows = rows.withColumn("kind", action_class(F.col("was"), F.col("close"), F.col("gap")))
    return rows.where("kind <> 'ordinary_market_movement'").select("source", "symbol", "grain", "day", "gap", r6(ratio(F.col("close"), F.col("was"))).alias("ratio"), "kind")


def volume_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second source's volumes are in other units: median ratio, the nearest of 1, 10, 100, 1000, and the
    share of ratios within 2 % of it."""
    rows = observations(spark, sf_dir).groupBy("symbol", "day").agg(F.min(F.when(F.col("source") == "A", F.col("volume"))).alias("a"), F.min(F.when(F.col("source") == "B", F.col("volume"))).alias("b")).where("a > 0 and b > a")
    ratios = rows.select("symbol", (F.col("b") / F.col("a")).alias("ratio"))
    middle = ratios.groupBy("symbol").agg(F.median("ratio").alias("middle"))
    unit = F.array_min(F.transform(F.array(*(F.lit(k) for k in (1, 10, 100, 1000))), lambda k: F.struct(F.abs(F.col("middle") - k).alias("distance"), k.alias("unit")))).getField("unit")
    return ratios.join(middle.withColumn("unit", unit), "symbol").groupBy("symbol", "unit").agg(F.count("*").alias("days"), r6(F.first("middle")).alias("median_ratio"), r6(F.avg((F.abs(F.col("ratio") / F.col("unit") - 1) <= 0.02).cast("double"))).alias("stable_share"))


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of each source, symbol and grain: rows, days, range, invalid rows, median close."""
    return observations(spark, sf_dir).groupBy("source", "symbol", "grain").agg(
        F.count("*").alias("rows"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(~valid()).alias("invalid"), r6(F.median("close")).alias("median_close"), F.sum("volume").alias("volume"),
    )


def source_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources ranked for each symbol by coverage less invalid rows; ties go to the name."""
    profile = source_profile(spark, sf_dir)
    score = F.least(F.col("rows") / 2500, F.lit(1.0)) * 25 - F.col("invalid") / F.col("rows") * 20
    ranked = profile.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "source", "grain")))
    return ranked.select("symbol", "source", "grain", "score", "rank")


def tiered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row to use for each key and grain, held back if sources disagree; tier 1 where two sources agree."""
    rows = observations(spark, sf_dir).where(valid())
    spread = lambda f: F.max(f) - F.min(f)
    groups = rows.groupBy("symbol", "day", "grain").agg(F.count_distinct("source").alias("sources"), F.min(F.struct("source", "row_id")).alias("chosen"), F.max(F.lit(0)).alias("zero"), (spread("close") / F.max("close")).alias("price_spread"), (spread("volume") / F.max("volume")).alias("volume_spread"))
    held = (F.round("price_spread", 12) > TOLERANCE) | (F.round("volume_spread", 12) > TOLERANCE)
    return groups.select("symbol", "day", "grain", F.when(held, "hold").when(F.col("sources") > 1, "tier_1").when(F.col("chosen.source") == "A", "tier_2").otherwise("tier_3").alias("tier"), F.when(~held, F.col("chosen.row_id")).alias("row_id"))


def date_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that not every source has, with the sources present and missing."""
    rows = observations(spark, sf_dir)
    every = F.array(F.lit("A"), F.lit("B"))
    keys = rows.groupBy("symbol", "day").agg(F.array_sort(F.collect_set("source")).alias("present")).where(F.size("present") < 2)
    return keys.select("symbol", "day", F.concat_ws(",", "present").alias("present"), F.concat_ws(",", F.array_except(every, "present")).alias("missing"))


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For closes that moved by half or more: rows of the symbol within seven days. The range becomes weeks to join
    on, so that a large table needs no nested loop."""
    rows = bars(spark, sf_dir).select("symbol", "day", "close")
    window = Window.partitionBy("symbol").orderBy("day")
    moved = rows.withColumn("was", F.lag("close").over(window)).where("abs(close / was - 1) >= 0.5").select("symbol", F.col("day").alias("at"))
    week = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 7)
    near = moved.withColumn("week", F.explode(F.array(*((F.floor(F.datediff("at", F.lit("1970-01-01").cast("date")) / 7) + k) for k in (-1, 0, 1))))).join(rows.withColumn("week", week), ["symbol", "week"]).where("abs(datediff(day, at)) <= 7")
    return near.groupBy("symbol", "at").agg(F.count("*").alias("rows"), r6(F.min("close")).alias("lowest"), r6(F.max("close")).alias("highest"))


def factor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the ratio of the sources' closes moves by more than 1 % against the day before."""
    rows = observations(spark, sf_dir).groupBy("symbol", "day").agg(F.min(F.when(F.col("source") == "A", F.col("close"))).alias("a"), F.min(F.when(F.col("source") == "B", F.col("close"))).alias("b")).where("a > 0 and b > 0")
    rows = rows.withColumn("factor", F.round(F.col("b") / F.col("a"), 9)).withColumn("was", F.lag("factor").over(Window.partitionBy("symbol").orderBy("day")))
    return rows.where(F.abs(F.col("factor") / F.col("was") - 1) > 0.01).select("symbol", "day", r6("was").alias("was"), r6("factor").alias("factor"))


QUERIES = {f.__name__: f for f in (compare_sources, source_quality, missing_keys, duplicate_groups, collapse_duplicates, source_pairs, canonical_rows, corporate_actions, volume_units, source_profile, source_hierarchy, tiered_rows, date_disagreement, neighbourhood, factor_changes)}

WITH = f"WITH {BARS_SQL}, {SOURCES_SQL}"
_REL = lambda f, a="p", b="s": f"round(abs({a}.{f} - {b}.{f}) / greatest(abs({a}.{f}), abs({b}.{f}), 0.0001), 12)"
_VALID = lambda p: f"({p}low <= least({p}open, {p}close) AND {p}high >= greatest({p}open, {p}close))"
_SIDE = lambda s: f"(SELECT symbol, day, count(*) AS n, first(open ORDER BY open, high, low, close, volume) AS open, first(high ORDER BY open, high, low, close, volume) AS high, first(low ORDER BY open, high, low, close, volume) AS low, first(close ORDER BY open, high, low, close, volume) AS close, CAST(first(volume ORDER BY open, high, low, close, volume) AS DOUBLE) AS volume FROM observations WHERE source = '{s}' GROUP BY ALL)"
_LEDGER = f"""{WITH}, ledger AS (SELECT coalesce(p.symbol, s.symbol) AS symbol, coalesce(p.day, s.day) AS day, CASE WHEN p.n IS NULL THEN 'missing_primary' WHEN s.n IS NULL THEN 'missing_secondary' WHEN p.n > 1 OR s.n > 1 THEN 'duplicate' WHEN NOT {_VALID('p.')} OR NOT {_VALID('s.')} THEN 'invalid_ohlc'
  WHEN {' AND '.join(f'{_REL(f)} = 0' for f in FIELDS)} THEN 'exact_match' WHEN {' AND '.join(f'{_REL(f)} <= {TOLERANCE}' for f in FIELDS)} THEN 'within_tolerance' WHEN {_REL('close')} >= {ACTION} THEN 'corporate_action_suspected' ELSE 'material_conflict' END AS class
  FROM {_SIDE('A')} p FULL JOIN {_SIDE('B')} s ON p.symbol = s.symbol AND p.day = s.day)"""
_FP = "concat_ws('|', " + ", ".join(f"CAST(round({f}, 6) AS VARCHAR)" for f in FIELDS) + ")"
_FPS = f"{WITH}, o AS (SELECT *, {_FP} AS fp, concat_ws('|', " + ", ".join(f"CAST(round({f}, 6) AS VARCHAR)" for f in FIELDS[:4]) + ") AS prices FROM observations)"
_ACTION = f"""CASE WHEN round(abs(close / was - 1), 12) < {ACTION} THEN 'ordinary_market_movement' WHEN gap > 10 THEN 'possible_suspension_resumption' WHEN {' OR '.join(f'abs(round(greatest(was, close) / least(was, close), 12) - {k}) <= {NEAR}' for k in SPLITS)} THEN 'probable_split'
  WHEN round(greatest(was, close) / least(was, close), 12) >= 1.2 AND round(greatest(was, close) / least(was, close), 12) < 2 THEN 'probable_bonus_share_adjustment' ELSE 'unresolved' END"""
_PROFILE = f"SELECT source, symbol, grain, count(*) AS rows, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (NOT {_VALID('')}) AS invalid, round(median(close), 6) AS median_close, CAST(sum(volume) AS BIGINT) AS volume FROM observations GROUP BY source, symbol, grain"
ORACLE = {
    "compare_sources": f"{_LEDGER} SELECT symbol, day, class FROM ledger",
    "source_quality": f"{_LEDGER} SELECT symbol, CAST(month AS DATE) AS month, greatest(0, 100 - CAST(floor(sum(penalty) / count(*)) AS BIGINT)) AS score FROM (SELECT symbol, date_trunc('month', day) AS month, CASE class {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in PENALTIES.items())} ELSE 0 END AS penalty FROM ledger) GROUP BY GROUPING SETS ((symbol), (month), ())",
    "missing_keys": f"""{WITH}, a AS (SELECT DISTINCT symbol, day FROM observations WHERE source = 'A'), b AS (SELECT DISTINCT symbol, day FROM observations WHERE source = 'B')
      SELECT symbol, side, count(*) AS keys FROM (SELECT *, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) GROUP BY ALL""",
    "duplicate_groups": f"""{_FPS}, g AS (SELECT symbol, day, count(*) AS rows, count(DISTINCT fp) AS fps, count(DISTINCT grain) AS grains, count(DISTINCT prices) AS prices, count(DISTINCT volume) AS volumes, min(row_id) AS first_id FROM o GROUP BY symbol, day HAVING count(*) > 1)
      SELECT symbol, day, rows, fps, first_id, CASE WHEN grains > 1 THEN 'adjusted_unadjusted_duplicate' WHEN fps = 1 THEN 'duplicate_exact' WHEN prices = 1 AND volumes > 1 THEN 'same_price_different_volume' WHEN prices > 1 THEN 'conflicting_ohlc' ELSE 'unresolved_conflict' END AS kind FROM g""",
    "collapse_duplicates": f"{_FPS} SELECT symbol, day, grain, min(row_id) AS row_id, count(*) AS stands_for FROM o GROUP BY symbol, day, grain, fp",
    "source_pairs": f"""{_FPS}, r AS (SELECT symbol, day, source, grain, fp, min(row_id) AS row_id, {', '.join(f'CAST(min({f}) AS DOUBLE) AS {f}' for f in FIELDS)} FROM o GROUP BY symbol, day, source, grain, fp),
      q AS (SELECT a.symbol, a.day, a.row_id AS row_id_a, b.row_id AS row_id_b, a.fp = b.fp AS exact, round(abs(a.close - b.close), 6) AS close_difference, greatest({', '.join(_REL(f, 'a', 'b') for f in FIELDS)}) AS w FROM r a JOIN r b ON a.symbol = b.symbol AND a.day = b.day AND a.row_id < b.row_id AND NOT (a.source = b.source AND a.grain = b.grain))
      SELECT symbol, day, row_id_a, row_id_b, exact, close_difference, round(w, 6) AS worst, CASE WHEN w <= {TOLERANCE} THEN 'within_tolerance' ELSE 'outside_tolerance' END AS result FROM q""",
    "canonical_rows": f"""{_FPS}, g AS (SELECT symbol, day, grain, count(*) AS rows, count(DISTINCT fp) AS fps, count(DISTINCT source) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(row_id) AS row_id, first(close ORDER BY row_id) AS close FROM o GROUP BY symbol, day, grain)
      SELECT symbol, day, grain, CASE WHEN fps > 1 THEN 'rejected_conflict' WHEN n > 1 THEN 'accepted_candidate' WHEN rows > 1 THEN 'accepted_exact_deduplicated' ELSE 'accepted_single_source_low_confidence' END AS status, sources, CASE WHEN fps = 1 THEN row_id END AS row_id, round(CASE WHEN fps = 1 THEN close END, 6) AS close FROM g""",
    "corporate_actions": f"""{WITH}, f AS (SELECT source, symbol, grain, day, first(close ORDER BY row_id) AS close FROM observations GROUP BY ALL), l AS (SELECT *, lag(close) OVER w AS was, date_diff('day', lag(day) OVER w, day) AS gap FROM f WINDOW w AS (PARTITION BY source, symbol, grain ORDER BY day)),
      k AS (SELECT *, {_ACTION} AS kind FROM l WHERE was > 0 AND close > 0) SELECT source, symbol, grain, day, gap, round(close / was, 6) AS ratio, kind FROM k WHERE kind <> 'ordinary_market_movement'""",
    "volume_units": f"""{WITH}, v AS (SELECT symbol, day, min(volume) FILTER (source = 'A') AS a, min(volume) FILTER (source = 'B') AS b FROM observations GROUP BY symbol, day), r AS (SELECT symbol, b / a AS ratio FROM v WHERE a > 0 AND b > a), m AS (SELECT symbol, median(ratio) AS middle FROM r GROUP BY symbol),
      u AS (SELECT symbol, middle, first(unit ORDER BY abs(middle - unit), unit) AS unit FROM m CROSS JOIN (VALUES (1), (10), (100), (1000)) AS t(unit) GROUP BY ALL)
      SELECT r.symbol, unit, count(*) AS days, round(first(middle), 6) AS median_ratio, round(avg(CAST(abs(ratio / unit - 1) <= 0.02 AS DOUBLE)), 6) AS stable_share FROM r JOIN u ON r.symbol = u.symbol GROUP BY r.symbol, unit""",
    "source_profile": f"{WITH} {_PROFILE}",
    "source_hierarchy": f"{WITH}, p AS ({_PROFILE}), s AS (SELECT *, round(least(rows / 2500, 1.0) * 25 - invalid / rows * 20, 6) AS score FROM p) SELECT symbol, source, grain, score, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, source, grain) AS rank FROM s",
    "tiered_rows": f"""{WITH}, g AS (SELECT symbol, day, grain, count(DISTINCT source) AS sources, first(source ORDER BY source, row_id) AS source, first(row_id ORDER BY source, row_id) AS row_id, (max(close) - min(close)) / max(close) AS ps, (max(volume) - min(volume)) / max(volume) AS vs FROM observations WHERE {_VALID('')} GROUP BY symbol, day, grain), h AS (SELECT *, round(ps, 12) > {TOLERANCE} OR round(vs, 12) > {TOLERANCE} AS held FROM g)
      SELECT symbol, day, grain, CASE WHEN held THEN 'hold' WHEN sources > 1 THEN 'tier_1' WHEN source = 'A' THEN 'tier_2' ELSE 'tier_3' END AS tier, CASE WHEN NOT held THEN row_id END AS row_id FROM h""",
    "date_disagreement": f"{WITH} SELECT symbol, day, min(source) AS present, CASE min(source) WHEN 'A' THEN 'B' ELSE 'A' END AS missing FROM observations GROUP BY symbol, day HAVING count(DISTINCT source) = 1",
    "neighbourhood": f"WITH {BARS_SQL}, l AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS was FROM bars) SELECT a.symbol, a.day AS at, count(*) AS rows, round(min(b.close), 6) AS lowest, round(max(b.close), 6) AS highest FROM l a JOIN bars b ON a.symbol = b.symbol AND abs(date_diff('day', a.day, b.day)) <= 7 WHERE abs(a.close / a.was - 1) >= 0.5 GROUP BY a.symbol, a.day",
    "factor_changes": f"""{WITH}, v AS (SELECT symbol, day, round(min(close) FILTER (source = 'B') / min(close) FILTER (source = 'A'), 9) AS factor FROM observations GROUP BY symbol, day), l AS (SELECT *, lag(factor) OVER (PARTITION BY symbol ORDER BY day) AS was FROM v WHERE factor > 0)
      SELECT symbol, day, round(was, 6) AS was, round(factor, 6) AS factor FROM l WHERE abs(factor / was - 1) > 0.01""",
}
