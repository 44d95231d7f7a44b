"""The daily report of unusual activity: a record for every instrument and session with its identity, data status, score,
label, reasons and known events, and the report's parts: the market, sectors, features and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import by_day, codes, codes_sql, r6
from tapeline.operators.anomaly import _COMPONENTS, _FEATURES_OF, _SCORE, HIGH, WATCH, features_of, scored
from tapeline.sources.bars import BARS_SQL, bars, table

# Statuses of instruments, reasons for rows that can't be used and for labels, and the report's bounds.
VERIFIED, UNVERIFIED, NON_EQUITY = "VERIFIED_EQUITY", "UNVERIFIED_INSTRUMENT", "NON_EQUITY"
ZERO, INCONSISTENT, NONPOSITIVE, MALFORMED = "source_reports_zero_activity", "inconsistent_activity_fields", "nonpositive_price_on_active_row", "malformed_ohlc_or_ltp"
NOT_VERIFIED, NOT_EQUITY, NOT_ACTIVE, SHORT = "ordinary_equity_status_not_verified", "verified_non_equity_not_watchlist_eligible", "verified_equity_listing_status_not_active", "trailing_feature_history_below_minimum"
PROFILE_FIELDS = "company_name,sector,instrument_type,market_category,listing_status,observed_at"
RAW_ANOMALIES, LEAST_MEMBERS, STRONG, FEEBLE = 20, 3, 0.75, 0.25
#: Columns of features by the names that reports give them.
FEATURES = {
    "daily_return_pct": "daily_return", "opening_gap_pct": "opening_gap", "intraday_range_pct": "intraday_range", "volume_multiple": "volume_multiple", "trade_count_multiple": "trades_multiple",
    "traded_value_multiple": "value_multiple", "robust_return_z": "return_z", "robust_volume_z": "volume_z", "volatility_expansion": "expansion", "recent_high_low_breakout": "breakout",
}
#: Features that need no history.
IMMEDIATE = ("daily_return_pct", "opening_gap_pct", "intraday_range_pct")


def with_data_status(rows: DataFrame) -> DataFrame:
    """rows of (open, high, low, close, was, volume, n, value) with data_status and the reason why a row can't be used. A
    null price counts as not positive, a null activity as 0."""
    none = [F.coalesce(F.col(c), F.lit(0)) == 0 for c in ("volume", "n", "value")]
    prices = F.least(*(F.coalesce(F.col(c), F.lit(0.0)) for c in ("open", "high", "low", "close", "was")))
    reason = (
        F.when(none[0] & none[1] & none[2], ZERO).when(none[0] | none[1] | none[2], INCONSISTENT).when(prices <= 0, NONPOSITIVE)
        .when((F.col("low") > F.least("open", "close")) | (F.greatest("open", "close") > F.col("high")), MALFORMED)
    )
    return rows.withColumn("reason", reason).withColumn("data_status", F.when(F.col("reason").isNull(), "USABLE").when(F.col("reason") == ZERO, "ZERO_ACTIVITY").otherwise("DATA_ISSUE"))


def records(day_ends: DataFrame, master: DataFrame, events: DataFrame) -> DataFrame:
    """A record for each row of day_ends (symbol, day, open, high, low, close, was, volume, n, value): features, points,
    identity, label, eligibility for the watch list, reasons, and what events had made known by the end of the day.

    master: symbol, name, sector, kind, listing, one row for each symbol; who is not in it is unverified. events: symbol,
    available, tier (A to E), contradicts; nothing that became available later is used, and none changes a score. Rows
    that can't be used have no features and count in no history."""
    rows = with_data_status(day_ends)
    fine = scored(features_of(rows.where("reason IS NULL"))).withColumn("data_status", F.lit("USABLE"))
    poor = rows.where("reason IS NOT NULL").select("symbol", "day", "data_status", "reason", F.lit("UNAVAILABLE").alias("status"), F.lit(0).alias("score"))
    every = fine.drop("label").unionByName(poor, allowMissingColumns=True)
    tiers = {t: F.min(F.when(F.col("tier") == t, F.col("available"))) for t in "ABCDE"}
    known = events.groupBy("symbol").agg(*(v.alias(f"since_{t}") for t, v in tiers.items()), F.min(F.when(F.col("contradicts"), F.col("available"))).alias("since_contradicted"))
    about = master.withColumn("listed", F.lit(True)).join(known, "symbol", "full")
    found = every.join(about, "symbol", "left").withColumn("verification", F.when(F.col("listed").isNull(), UNVERIFIED).otherwise(F.coalesce("kind", F.lit(UNVERIFIED))))
    return found.withColumns(_judged(F.col("verification"), F.col("status"))).drop(*(f"points_{name}" for name in _COMPONENTS))


def _judged(kind: Column, status: Column) -> dict[str, Column]:
    """Label, eligibility, reasons and event status of a record; of the reasons against a row the first counts."""
    against = (
        F.when(kind == UNVERIFIED, NOT_VERIFIED).when(kind == NON_EQUITY, NOT_EQUITY).when(~F.col("listing").eqNullSafe("ACTIVE"), NOT_ACTIVE)
        .when(F.col("reason").isNotNull(), F.col("reason")).when(status == "INSUFFICIENT_HISTORY", SHORT)
    )
    label = F.when(kind == NON_EQUITY, "NORMAL").when(against == SHORT, "INSUFFICIENT_HISTORY").when(against.isNotNull(), "DATA_ISSUE").when(F.col("score") >= HIGH, "HIGH_ATTENTION").when(F.col("score") >= WATCH, "WATCH").otherwise("NORMAL")
    points = [(p > 0, F.concat(F.lit(f"{name}:"), p.cast("string"), F.when(p == 1, "_point").otherwise("_points"))) for name in _COMPONENTS for p in [F.col(f"points_{name}")]]
    present = codes(*((F.col(c).isNotNull(), name) for name, c in FEATURES.items()))
    seen = lambda tier: F.coalesce(F.col(f"since_{tier}") <= F.col("day"), F.lit(False))
    event = F.when(seen("A") | seen("B"), "OFFICIAL_EVENT_PRESENT").when(seen("C") | seen("D"), "CORROBORATING_EVENT_PRESENT").when(seen("E"), "RUMOUR_ONLY_INVESTIGATE").otherwise("NO_EXPLANATION_FOUND")
    return {
        "label": label, "eligible": against.isNull(), "why": F.concat_ws(",", F.coalesce(against, present), *(F.when(c, text) for c, text in points)), "event_status": event,
        "contradicted": F.coalesce(F.col("since_contradicted") <= F.col("day"), F.lit(False)),
    }


def market(found: DataFrame) -> DataFrame:
    """The market of each day: instruments by identity and data status, how many rose and fell, medians."""
    verified, ret, status = F.col("verification") == VERIFIED, F.col("daily_return"), F.col("data_status")
    n = lambda c, name: F.count_if(c).alias(name)
    return found.groupBy("day").agg(
        F.count("*").alias("observed"), n(verified, "verified"), n(F.col("verification") == UNVERIFIED, "unverified"), n(F.col("verification") == NON_EQUITY, "non_equities"),
        n(status == "USABLE", "usable"), n(status == "ZERO_ACTIVITY", "zero_activity"), n(status == "DATA_ISSUE", "data_issues"), n(verified & (status == "USABLE"), "usable_verified"), n(verified & (status == "ZERO_ACTIVITY"), "zero_verified"),
        n(ret > 0, "up"), n(ret < 0, "down"), n(ret == 0, "unchanged"), r6(F.median("daily_return")).alias("median_return"), r6(F.median("volume_multiple")).alias("median_volume_multiple"),
        n(verified & (ret > 0), "verified_up"), n(verified & (ret < 0), "verified_down"), n(verified & (ret == 0), "verified_unchanged"),
        *(n(F.col("label") == x, f"labelled_{x.lower()}") for x in ("HIGH_ATTENTION", "WATCH", "NORMAL", "DATA_ISSUE", "INSUFFICIENT_HISTORY")),
    )


def sectors(found: DataFrame) -> DataFrame:
    """Sectors of three verified equities or more with a return on the day: share that rose, median, and what that says."""
    rows = found.where((F.col("verification") == VERIFIED) & F.col("daily_return").isNotNull() & (F.col("sector") != ""))
    out = rows.groupBy("day", "sector").agg(F.count("*").alias("members"), F.avg((F.col("daily_return") > 0).cast("double")).alias("share"), F.median("daily_return").alias("middle")).where(F.col("members") >= LEAST_MEMBERS)
    label = F.when((F.col("share") >= STRONG) & (F.col("middle") > 0), "BROAD_STRENGTH").when((F.col("share") <= FEEBLE) & (F.col("middle") < 0), "BROAD_WEAKNESS").otherwise("MIXED")
    return out.select("day", "sector", "members", r6("share").alias("advancing_share"), r6("middle").alias("median_return"), label.alias("label"))


def feature_statuses(found: DataFrame) -> DataFrame:
    """How many records of a day have a feature, have it not, or have too short a history for it."""
    short = F.col("status") == "INSUFFICIENT_HISTORY"
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("feature"), F.col(c).isNotNull().alias("has"), (F.lit(False) if name in IMMEDIATE else short).alias("short")) for name, c in FEATURES.items())))
    rows = found.select("day", each.alias("x")).select("day", "x.*").groupBy("day", "feature")
    return rows.agg(F.count_if("has").alias("available"), F.count_if(~F.col("has") & ~F.col("short")).alias("unavailable"), F.count_if(~F.col("has") & F.col("short")).alias("insufficient_history"))


def rankings(found: DataFrame) -> DataFrame:
    """Each day's watch list, whole, and its first 20 anomalies of unverified instruments, by score and symbol; the latter
    with the fields that a profile must give. An eligible row below the bound of WATCH is on neither."""
    kind = F.when(F.col("eligible") & F.col("label").isin("WATCH", "HIGH_ATTENTION"), "verified_watchlist").when((F.col("verification") == UNVERIFIED) & (F.col("score") > 0), "unverified_raw_anomalies")
    rows = found.withColumn("ranking", kind).where("ranking IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("day", "ranking").orderBy(F.desc("score"), "symbol"))
    raw = F.col("ranking") == "unverified_raw_anomalies"
    rows = rows.withColumn("place", place).where(~raw | (F.col("place") <= RAW_ANOMALIES))
    return rows.select("day", "ranking", "place", "symbol", F.coalesce("name", F.lit("")).alias("name"), "score", "label", "event_status", F.when(raw, PROFILE_FIELDS).alias("missing_fields"))


def day_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each supplier and day with the close before; of 23 rows one has no activity, one has trades without
    volume, and one has a low above its high."""
    rows = bars(spark, sf_dir, "l_suppkey").withColumn("was", F.lag("close").over(by_day())).where("was IS NOT NULL")
    code = (F.unix_date("day") + 7 * F.substring("symbol", 2, 20).cast("long")) % 23
    rows = rows.withColumn("code", code).withColumn("value", F.col("close") * F.col("volume"))
    zero = lambda c, *faults: F.when(F.col("code").isin(*faults), 0).otherwise(F.col(c)).alias(c)
    return rows.select("symbol", "day", "open", "high", F.when(F.col("code") == 2, F.col("high") + 1).otherwise(F.col("low")).alias("low"), "close", "was", zero("volume", 0, 1), zero("n", 0), zero("value", 0))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master: suppliers by nation; of ten one is missing, one no equity, and one not active."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sector"))
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 10 > 0").join(F.broadcast(nation), "s_nationkey")  # 25 nations
    key = F.col("s_suppkey") % 10
    return rows.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name"), "sector", F.when(key == 1, NON_EQUITY).otherwise(VERIFIED).alias("kind"), F.when(key == 2, "SUSPENDED").otherwise("ACTIVE").alias("listing"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events about suppliers, 10,000 days back, known from the later of publication and observation."""
    day = F.date_sub(F.to_date("ts"), 10000)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), (F.col("user_id") % 60).cast("string")).alias("symbol"), F.greatest(day, F.date_add(day, (F.col("event_id") % 3).cast("int"))).alias("available"),
        F.when(F.col("user_id") % 3 == 0, "E").when(F.col("user_id") % 3 == 1, F.when(F.col("event_id") % 2 == 0, "D").otherwise("E")).otherwise(F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("event_id") % 5 + 1).cast("int"))).alias("tier"), (F.col("event_id") % 97 == 0).alias("contradicts"),
    )


def daily_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(day_ends(spark, sf_dir), instruments(spark, sf_dir), notices(spark, sf_dir))


def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of every day's report."""
    return daily_records(spark, sf_dir).select("symbol", "day", "verification", "data_status", "score", "label", "eligible", "why", "event_status", "contradicted")


def report_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(daily_records(spark, sf_dir))


def report_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors(daily_records(spark, sf_dir))


def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_statuses(daily_records(spark, sf_dir))


def report_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings(daily_records(spark, sf_dir))


QUERIES = {f.__name__: f for f in (report_records, report_market, report_sectors, report_features, report_rankings)}

_POINTS = ", ".join(f"CASE WHEN ({p}) > 0 THEN '{name}:' || ({p}) || CASE WHEN ({p}) = 1 THEN '_point' ELSE '_points' END END" for name, p in _COMPONENTS.items())
_PRESENT = codes_sql(*((f"{c} IS NOT NULL", name) for name, c in FEATURES.items()))
_SEEN = lambda tiers: f"EXISTS (SELECT 1 FROM g WHERE g.symbol = x.symbol AND tier IN {tiers} AND since <= x.day)"
_RECORDS = f"""WITH {BARS_SQL.replace("l_suppkey % 5", "l_suppkey")}, o AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS was, (day - DATE '1970-01-01' + 7 * CAST(substr(symbol, 2) AS BIGINT)) % 23 AS code FROM bars),
e AS (SELECT symbol, day, open, high, CASE code WHEN 2 THEN high + 1 ELSE low END AS low, close, was, CASE WHEN code < 2 THEN 0 ELSE volume END AS volume, CASE code WHEN 0 THEN 0 ELSE n END AS n, CASE code WHEN 0 THEN 0 ELSE close * volume END AS value FROM o WHERE was IS NOT NULL),
d AS (SELECT *, CASE WHEN volume = 0 AND n = 0 AND value = 0 THEN '{ZERO}' WHEN volume = 0 OR n = 0 OR value = 0 THEN '{INCONSISTENT}' WHEN least(open, high, low, close, was) <= 0 THEN '{NONPOSITIVE}' WHEN low > least(open, close) OR greatest(open, close) > high THEN '{MALFORMED}' END AS reason FROM e),
l AS (SELECT * FROM d WHERE reason IS NULL), {_FEATURES_OF},
a AS (SELECT d.symbol, d.day, d.reason, f.* EXCLUDE (symbol, day, status), coalesce(f.status, 'UNAVAILABLE') AS status FROM d LEFT JOIN f ON d.symbol = f.symbol AND d.day = f.day),
s AS (SELECT *, {_SCORE} AS score FROM a),
t AS (SELECT user_id % 60 AS code, CAST(ts AS DATE) - 10000 + CAST(event_id % 3 AS INT) AS available, CASE user_id % 3 WHEN 0 THEN 'E' WHEN 1 THEN CASE event_id % 2 WHEN 0 THEN 'D' ELSE 'E' END ELSE substr('ABCDE', CAST(event_id % 5 + 1 AS INT), 1) END AS tier, event_id % 97 = 0 AS contradicts FROM events),
g AS (SELECT 'S' || code AS symbol, tier, min(available) AS since FROM t GROUP BY ALL), h AS (SELECT 'S' || code AS symbol, min(available) AS since FROM t WHERE contradicts GROUP BY ALL),
x AS (SELECT s.*, s_name AS name, n_name AS sector, CASE WHEN s_suppkey IS NULL THEN '{UNVERIFIED}' WHEN s_suppkey % 10 = 1 THEN '{NON_EQUITY}' ELSE '{VERIFIED}' END AS verification,
  CASE WHEN s_suppkey IS NULL THEN '{NOT_VERIFIED}' WHEN s_suppkey % 10 = 1 THEN '{NOT_EQUITY}' WHEN s_suppkey % 10 = 2 THEN '{NOT_ACTIVE}' WHEN reason IS NOT NULL THEN reason WHEN status = 'INSUFFICIENT_HISTORY' THEN '{SHORT}' END AS against,
  CASE reason WHEN '{ZERO}' THEN 'ZERO_ACTIVITY' ELSE CASE WHEN reason IS NULL THEN 'USABLE' ELSE 'DATA_ISSUE' END END AS data_status
  FROM s LEFT JOIN (SELECT * FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 > 0) ON s.symbol = 'S' || s_suppkey),
r AS (SELECT *, against IS NULL AS eligible, CASE WHEN verification = '{NON_EQUITY}' THEN 'NORMAL' WHEN against = '{SHORT}' THEN 'INSUFFICIENT_HISTORY' WHEN against IS NOT NULL THEN 'DATA_ISSUE' WHEN score >= {HIGH} THEN 'HIGH_ATTENTION' WHEN score >= {WATCH} THEN 'WATCH' ELSE 'NORMAL' END AS label,
  concat_ws(',', coalesce(against, {_PRESENT}), {_POINTS}) AS why,
  CASE WHEN {_SEEN("('A', 'B')")} THEN 'OFFICIAL_EVENT_PRESENT' WHEN {_SEEN("('C', 'D')")} THEN 'CORROBORATING_EVENT_PRESENT' WHEN {_SEEN("('E')")} THEN 'RUMOUR_ONLY_INVESTIGATE' ELSE 'NO_EXPLANATION_FOUND' END AS event_status,
  EXISTS (SELECT 1 FROM h WHERE h.symbol = x.symbol AND since <= x.day) AS contradicted FROM x)"""
_COUNT = lambda c, name: f"count(*) FILTER ({c}) AS {name}"
_V = f"verification = '{VERIFIED}'"
_EACH = " UNION ALL ".join(f"SELECT day, '{name}' AS feature, {c} IS NOT NULL AS has, {'false' if name in IMMEDIATE else 'status = ' + repr('INSUFFICIENT_HISTORY')} AS short FROM r" for name, c in FEATURES.items())
ORACLE = {
    "report_records": f"{_RECORDS} SELECT symbol, day, verification, data_status, score, label, eligible, why, event_status, contradicted FROM r",
    "report_market": f"{_RECORDS} SELECT day, count(*) AS observed, "
    + ", ".join([
        _COUNT(_V, "verified"), _COUNT(f"verification = '{UNVERIFIED}'", "unverified"), _COUNT(f"verification = '{NON_EQUITY}'", "non_equities"), _COUNT("data_status = 'USABLE'", "usable"), _COUNT("data_status = 'ZERO_ACTIVITY'", "zero_activity"),
        _COUNT("data_status = 'DATA_ISSUE'", "data_issues"), _COUNT(f"{_V} AND data_status = 'USABLE'", "usable_verified"), _COUNT(f"{_V} AND data_status = 'ZERO_ACTIVITY'", "zero_verified"),
        _COUNT("daily_return > 0", "up"), _COUNT("daily_return < 0", "down"), _COUNT("daily_return = 0", "unchanged"), "round(median(daily_return), 6) AS median_return", "round(median(volume_multiple), 6) AS median_volume_multiple",
        _COUNT(f"{_V} AND daily_return > 0", "verified_up"), _COUNT(f"{_V} AND daily_return < 0", "verified_down"), _COUNT(f"{_V} AND daily_return = 0", "verified_unchanged"),
        *(_COUNT(f"label = '{x}'", f"labelled_{x.lower()}") for x in ("HIGH_ATTENTION", "WATCH", "NORMAL", "DATA_ISSUE", "INSUFFICIENT_HISTORY")),
    ])
    + " FROM r GROUP BY day",
    "report_sectors": f"""{_RECORDS}, b AS (SELECT day, sector, count(*) AS members, avg(CAST(daily_return > 0 AS DOUBLE)) AS share, median(daily_return) AS middle FROM r WHERE {_V} AND daily_return IS NOT NULL GROUP BY day, sector HAVING count(*) >= {LEAST_MEMBERS})
SELECT day, sector, members, round(share, 6) AS advancing_share, round(middle, 6) AS median_return, CASE WHEN share >= {STRONG} AND middle > 0 THEN 'BROAD_STRENGTH' WHEN share <= {FEEBLE} AND middle < 0 THEN 'BROAD_WEAKNESS' ELSE 'MIXED' END AS label FROM b""",
    "report_features": f"{_RECORDS} SELECT day, feature, count(*) FILTER (has) AS available, count(*) FILTER (NOT has AND NOT short) AS unavailable, count(*) FILTER (NOT has AND short) AS insufficient_history FROM ({_EACH}) GROUP BY day, feature",
    "report_rankings": f"""{_RECORDS}, ranked AS (SELECT *, CASE WHEN eligible AND label IN ('WATCH', 'HIGH_ATTENTION') THEN 'verified_watchlist' WHEN verification = '{UNVERIFIED}' AND score > 0 THEN 'unverified_raw_anomalies' END AS ranking FROM r),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, ranking ORDER BY score DESC, symbol) AS INT) AS place FROM ranked WHERE ranking IS NOT NULL)
SELECT day, ranking, place, symbol, coalesce(name, '') AS name, score, label, event_status, CASE WHEN ranking <> 'verified_watchlist' THEN '{PROFILE_FIELDS}' END AS missing_fields FROM placed WHERE ranking = 'verified_watchlist' OR place <= {RAW_ANOMALIES}""",
}
