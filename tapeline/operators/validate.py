"""Raw text rows to typed bars: date and number parsing, symbol classes, and every way in which a row is unfit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.columns import codes, codes_sql, r6
from tapeline.sources.bars import BARS_SQL, bars, table

# Accepted date forms in the order they are tried.
DATE_FORMS = ("y-M-d", "d-M-y", "yyyyMMdd", "d/M/y")
WEEKEND = (4, 5)


def trading_date(raw: Column, low: str = "1990-01-01", high: str = "2100-01-01") -> Column:
    day = F.coalesce(*(F.try_to_timestamp(F.trim(raw), F.lit(f)).cast("date") for f in DATE_FORMS))
    return F.when(day.between(F.lit(low).cast("date"), F.lit(high).cast("date")), day)


def number(raw: Column) -> Column:
    """A decimal with thousand separators; null for anything that is no finite number."""
    return F.regexp_replace(F.trim(raw), ",", "").try_cast("decimal(38,10)")


def classified(raw: DataFrame, weekend: tuple[int, int] = WEEKEND) -> DataFrame:
    """raw (symbol, day, open, high, low, close, volume as text) with typed columns, categories and warnings.

    A row is accepted when it has no category; nulls count as blank. Several structural faults together also mark
    suspected corruption of the source."""
    rows = raw.select("*", trading_date(F.col("day")).alias("date_"), *(number(F.coalesce(c, F.lit(""))).alias(f"{c}_") for c in ("open", "high", "low", "close", "volume")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    prices = [F.col(f"{c}_") for c in ("open", "high", "low", "close")]
    any_of = lambda test: F.coalesce(F.greatest(*(F.coalesce(test(p), F.lit(False)) for p in prices)), F.lit(False))
    bad_number = F.greatest(*(~blank(c) & F.col(f"{c}_").isNull() for c in ("open", "high", "low", "close", "volume")))
    outside = lambda c: F.coalesce(~F.col(c).between(F.col("low_"), F.col("high_")), F.lit(False))
    inverted = F.coalesce(F.col("high_") < F.col("low_"), F.lit(False))
    structural = sum((x.cast("int") for x in (inverted, outside("open_"), outside("close_"), bad_number)), F.lit(0))
    kinds = codes(
        (outside("close_"), "close_outside_range"), (inverted, "high_below_low"), (F.col("date_").isNull(), "impossible_date"), *((blank(c), f"missing_{c}") for c in ("close", "high", "low", "open")),
        (any_of(lambda p: p < 0), "negative_price"), (F.coalesce(F.col("volume_") < 0, F.lit(False)), "negative_volume"), (bad_number, "non_numeric_value"), (outside("open_"), "open_outside_range"),
        (structural >= 2, "suspected_source_corruption"), (blank("symbol"), "symbol_missing"), (any_of(lambda p: p == 0), "zero_price"),
    )
    warnings = codes((F.weekday("date_").isin(*weekend), "non_trading_day_observed"), (F.col("volume_") == 0, "zero_volume"))
    return rows.withColumn("categories", kinds).withColumn("warnings", warnings).withColumn("accepted", F.col("categories") == "")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as text with planted faults, by a number made of the date."""
    k = (F.year("day") * 372 + F.month("day") * 31 + F.dayofmonth("day")) % 29
    money = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    rows = bars(spark, sf_dir).withColumn("k", k)
    return rows.select(
        F.when(F.col("k") == 1, " ").otherwise(F.col("symbol")).alias("symbol"), F.when(F.col("k") == 2, "2024-13-45").otherwise(F.date_format("day", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("k") == 3, "").when(F.col("k") == 4, "n/a").otherwise(money("open")).alias("open"), F.when(F.col("k") == 5, F.concat(F.lit("-"), money("high"))).otherwise(money("high")).alias("high"), money("low").alias("low"),
        F.when(F.col("k") == 6, "0").when(F.col("k") == 4, "999999999").otherwise(money("close")).alias("close"), F.when(F.col("k") == 7, "-5").when(F.col("k") == 8, "0").when(F.col("k") == 9, "1,000").otherwise(F.col("volume").cast("string")).alias("volume"), "k",
    )


def validity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their categories and warnings."""
    return classified(raw_rows(spark, sf_dir)).groupBy("categories", "warnings", "accepted").agg(F.count("*").alias("rows"), r6(F.sum(F.col("volume_").cast("double"))).alias("volume"))


def validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each category."""
    rows = classified(raw_rows(spark, sf_dir)).where("categories <> ''")
    return rows.select(F.explode(F.split("categories", ",")).alias("category"), "k").groupBy("category").agg(F.count("*").alias("rows"), F.count_distinct("k").alias("causes"))


def symbol_class(raw: Column) -> Column:
    """reason and class of a raw symbol: missing, spaced, malformed, or a fund, bond or equity."""
    text = F.upper(F.trim(raw))
    reason = F.when(text == "", "missing_symbol").when(text.rlike(r"\s"), "whitespace_removed_candidate").when(~text.rlike(r"^[A-Z0-9&()._-]+$"), "malformed_symbol").otherwise("case_or_identity_normalization")
    plain = reason == "case_or_identity_normalization"
    kind = F.when(plain & (text.endswith("MF") | text.contains("MUTUAL")), "fund").when(plain & text.contains("BOND"), "bond").when(plain, "equity").otherwise("unknown")
    return F.struct(F.regexp_replace(text, r"\s+", "").alias("symbol"), reason.alias("reason"), kind.alias("kind"))


def symbol_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as raw symbols: how each maps."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(""))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("mf"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("bond-"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("x*"), F.col("p_partkey").cast("string"))).alias("raw"))
    return part.select("p_partkey", symbol_class(F.col("raw")).alias("x")).select("p_partkey", "x.symbol", "x.reason", "x.kind")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each symbol that lie in its membership and outside its suspensions: an equi-join on few intervals."""
    spans = spark.createDataFrame([(f"S{k}", f"199{2 + k % 3}-01-01", f"199{6 + k % 2}-12-31", f"199{4 + k % 2}-03-01", f"199{4 + k % 2}-05-31") for k in range(5)], "symbol string, since string, until string, off string, back string")
    rows = bars(spark, sf_dir).join(F.broadcast(spans), "symbol")  # a row for each symbol
    inside = F.col("day").between(F.col("since").cast("date"), F.col("until").cast("date")) & ~F.col("day").between(F.col("off").cast("date"), F.col("back").cast("date"))
    return rows.groupBy("symbol").agg(F.count_if(inside).alias("eligible"), F.count_if(~inside).alias("outside"))


QUERIES = {f.__name__: f for f in (validity_classes, validity_counts, symbol_mapping, membership)}
_M = lambda c: f"CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR)"
_RAW = f"""WITH {BARS_SQL}, k AS (SELECT *, (year(day) * 372 + month(day) * 31 + day(day)) % 29 AS k FROM bars), raw AS (SELECT CASE WHEN k = 1 THEN ' ' ELSE symbol END AS symbol, CASE WHEN k = 2 THEN '2024-13-45' ELSE CAST(day AS VARCHAR) END AS day,
  CASE WHEN k = 3 THEN '' WHEN k = 4 THEN 'n/a' ELSE {_M('open')} END AS open, CASE WHEN k = 5 THEN '-' || {_M('high')} ELSE {_M('high')} END AS high, {_M('low')} AS low, CASE WHEN k = 6 THEN '0' WHEN k = 4 THEN '999999999' ELSE {_M('close')} END AS close, CASE WHEN k = 7 THEN '-5' WHEN k = 8 THEN '0' WHEN k = 9 THEN '1,000' ELSE CAST(volume AS VARCHAR) END AS volume, k FROM k),
t AS (SELECT *, try_cast(day AS DATE) AS d, {', '.join(f"try_cast(replace(trim({c}), ',', '') AS DECIMAL(28,10)) AS {c}_" for c in ('open', 'high', 'low', 'close', 'volume'))} FROM raw),
f AS (SELECT *, coalesce(high_ < low_, false) AS inverted, coalesce(NOT open_ BETWEEN low_ AND high_, false) AS oo, coalesce(NOT close_ BETWEEN low_ AND high_, false) AS co, {' OR '.join(f"(trim({c}) <> '' AND {c}_ IS NULL)" for c in ('open', 'high', 'low', 'close', 'volume'))} AS nn FROM t),
c AS (SELECT *, {codes_sql(('co', 'close_outside_range'), ('inverted', 'high_below_low'), ('d IS NULL', 'impossible_date'), *((f"trim({x}) = ''", f'missing_{x}') for x in ('close', 'high', 'low', 'open')), ('open_ < 0 OR high_ < 0 OR low_ < 0 OR close_ < 0', 'negative_price'), ('volume_ < 0', 'negative_volume'), ('nn', 'non_numeric_value'), ('oo', 'open_outside_range'), ('CAST(inverted AS INT) + CAST(oo AS INT) + CAST(co AS INT) + CAST(nn AS INT) >= 2', 'suspected_source_corruption'), ("trim(symbol) = ''", 'symbol_missing'), ('open_ = 0 OR high_ = 0 OR low_ = 0 OR close_ = 0', 'zero_price'))} AS categories,
  {codes_sql(('isodow(d) IN (5, 6)', 'non_trading_day_observed'), ('volume_ = 0', 'zero_volume'))} AS warnings FROM f)"""
ORACLE = {
    "validity_classes": f"{_RAW} SELECT categories, warnings, categories = '' AS accepted, count(*) AS rows, round(sum(CAST(volume_ AS DOUBLE)), 6) AS volume FROM c GROUP BY ALL",
    "validity_counts": f"{_RAW}, e AS (SELECT unnest(string_split(categories, ',')) AS category, k FROM c WHERE categories <> '') SELECT category, count(*) AS rows, count(DISTINCT k) AS causes FROM e GROUP BY category",
    "symbol_mapping": r"""WITH r AS (SELECT p_partkey, upper(trim(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'p' || p_partkey || 'mf' WHEN 2 THEN 'bond-' || p_partkey ELSE 'x*' || p_partkey END)) AS t FROM part),
      m AS (SELECT p_partkey, regexp_replace(t, '\s+', '', 'g') AS symbol, t, CASE WHEN t = '' THEN 'missing_symbol' WHEN regexp_matches(t, '\s') THEN 'whitespace_removed_candidate' WHEN NOT regexp_full_match(t, '[A-Z0-9&()._-]+') THEN 'malformed_symbol' ELSE 'case_or_identity_normalization' END AS reason FROM r)
      SELECT p_partkey, symbol, reason, CASE WHEN reason <> 'case_or_identity_normalization' THEN 'unknown' WHEN t LIKE '%MF' OR t LIKE '%MUTUAL%' THEN 'fund' WHEN t LIKE '%BOND%' THEN 'bond' ELSE 'equity' END AS kind FROM m""",
    "membership": f"""WITH {BARS_SQL}, k AS (SELECT *, CAST(substr(symbol, 2) AS INT) AS k FROM bars), i AS (SELECT symbol, day BETWEEN make_date(1992 + k % 3, 1, 1) AND make_date(1996 + k % 2, 12, 31) AND NOT day BETWEEN make_date(1994 + k % 2, 3, 1) AND make_date(1994 + k % 2, 5, 31) AS inside FROM k)
      SELECT symbol, count(*) FILTER (inside) AS eligible, count(*) FILTER (NOT inside) AS outside FROM i GROUP BY symbol""",
}
